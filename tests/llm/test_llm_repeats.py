"""Substring dedup: suffix automaton against substring search, removal against plain Python."""

import hashlib
import random

from plain import documents, prose, words

from docketry.llm import substring_dedup as s


def brute(docs, window=13):
    """(doc_id, text) pairs -> doc_id, n_words, n_removed, digest."""
    first, out = {}, []
    for key, text in docs:
        w = words(text)
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            if key is not None:
                first[g] = min(key, first.get(g, key))
    for key, text in docs:
        w, gone = words(text), set()
        for i in range(len(w) - window + 1):
            if key is not None and first[tuple(w[i : i + window])] < key:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((key, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_automaton_knows_the_first_document_of_every_window():
    rng = random.Random(4)
    for _ in range(60):
        strings = [[rng.randrange(3) for _ in range(rng.randrange(1, 25))] for _ in range(6)]
        automaton = s.SuffixAutomaton()
        for d, x in enumerate(strings):
            automaton.add(x, d)
        for x in strings:
            got = automaton.matches(x, 4)
            for end in range(len(x)):
                part = x[end - 3 : end + 1]
                held = [d for d, y in enumerate(strings) if any(y[i : i + 4] == part for i in range(len(y) - 3))] if end >= 3 else []
                assert got[end] == (held[0] if held else -1)


def rows():
    rng = random.Random(6)
    passage = [prose(rng, n, 5000) for n in (13, 14, 55, 80)]
    loop = " ".join(["again and again"] * 12)
    out = [(0, None), (1, ""), (2, "one two"), (3, prose(rng, 12)), (4, loop), (9, loop + " more")]
    for i in range(30):
        parts = [prose(rng, rng.randrange(0, 30), 5000), rng.choice(passage), prose(rng, rng.randrange(0, 30), 5000)]
        cut = rng.choice(passage).split()
        parts.append(" ".join(cut[rng.randrange(len(cut)) :]))
        out.append((20 + i * 3, rng.choice(["\n", " ", "\t\x0b "]).join(p for p in parts if p)))
    copy = out[-1][1]
    return [*out, (7, copy), (8, copy), (8, copy), (None, copy), (None, passage[3]), (1 << 40, passage[2]), (500, prose(rng, 15000, 5000))]


def test_removal_equals_plain_python(spark):
    given = rows()
    docs = documents(spark, given).withColumnsRenamed({"lang": "key", "source": "id"})
    got = s.remove_repeats(docs, shard_bytes=1 << 10, with_text=True).collect()
    assert sorted((tuple(r[:4]) for r in got), key=str) == brute(given)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert any(r.n_removed for r in got)


def test_hot_anchors_change_the_routes_and_not_the_result(spark):
    rng = random.Random(12)
    line = prose(rng, 12, 5000)  # shorter than a window: every match needs its surroundings
    given = [(i, f"{prose(rng, 9, 6)} {line} {prose(rng, 9, 6)}") for i in range(60)] + [(100 + k, t) for k, t in rows()[:15] if k is not None]
    docs = documents(spark, given)
    hot = s.hot_anchors(docs.selectExpr("doc_id AS id", "text"), 13, least=20)
    assert 0 < len(hot) < 100
    for least in (20, 10**9):
        got = s.remove_repeats(docs, hot_least=least).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(given)


def test_other_windows_and_an_empty_table(spark):
    given = rows()[:20]
    got = s.remove_repeats(documents(spark, given), window=5).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(given, 5)
    assert s.remove_repeats(documents(spark, given).limit(0)).count() == 0
