"""Min-max hashing: links and components against all pairs; star contraction; awkward tables."""

import random

import numpy as np
import pyarrow as pa
from plain import documents, prose, words

from docketry.llm import minmax_dedup as m
from docketry.llm.components import components


def shingles(text, n):
    w = words("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(texts, n, percent=80):
    sets = [shingles(t, n) for t in texts]
    top = list(range(len(texts)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def family(rng, base, copies, share):
    """Copies of a text with random words replaced."""
    out = []
    for _ in range(copies):
        w = base.split(" ")
        for _ in range(rng.randrange(int(len(w) * share) + 1)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def texts():
    rng = random.Random(8)
    out = [None, "", "one", "ONE", "one two", "Two words", "É é", "é é", "x " * 3000]
    for share in (0.04, 0.1, 0.16):
        out += family(rng, prose(rng, 120), 25, share)
    out += [prose(rng, rng.randrange(5, 200)) for _ in range(60)]
    return out + out[9:12] * 2


def test_components_equal_all_pairs(spark):
    given = texts()
    for n in (2, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in m.near_duplicates(documents(spark, given), shingle=n).collect()}
        want = brute(given, n)
        assert got == {i: (*w, w[1] == i) for i, w in enumerate(want)}


def test_signature_values_agree_as_often_as_the_sets_are_similar():
    rng = random.Random(1)
    a = prose(rng, 2000, 10**6)
    b = " ".join(a.split()[:1500] + prose(rng, 500, 10**6).split())
    block = next(iter(m.W.blocks(pa.array([a, b]))))
    sets, first = m.shingle_sets(block.data, block.at, 1)
    keys = m.band_keys(sets, first, 400, 1)
    truth = len(shingles(a, 1) & shingles(b, 1)) / len(shingles(a, 1) | shingles(b, 1))
    assert abs((keys[0] == keys[1]).mean() - truth) < 0.08
    assert len(np.unique(keys[0])) > 390


def test_dropping_keeps_the_smallest_and_all_columns(spark):
    rng = random.Random(2)
    same = prose(rng, 50)
    docs = documents(spark, [(5, same), (3, same), (None, same), (9, prose(rng, 50)), (3, same)]).withColumnsRenamed({"lang": "id", "source": "kept"})
    out = m.drop_near_duplicates(docs)
    assert out.schema == docs.schema
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in out.collect()) == [-1, 3, 3, 9]
    assert m.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (200, 201)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 200: 200, 201: 200}


def test_texts_of_one_id_are_one_document(spark):
    rng = random.Random(11)
    a, b, c = (prose(rng, 60) for _ in range(3))
    given = [(5, a), (5, b), (5, ""), (7, a + " x"), (8, b + " y"), (9, c), (9, b.upper()), (12, c + " z"), (13, prose(rng, 60))]
    got = sorted((r.doc_id, r.n_shingles > 0, r.component_id, r.kept) for r in m.near_duplicates(documents(spark, given)).collect())
    assert got == sorted([(5, True, 5, True)] * 2 + [(5, False, 5, True)] + [(k, True, 5, False) for k in (7, 8, 9, 9, 12)] + [(13, True, 13, True)])
    many = [(1, prose(rng, 30)) for _ in range(60)]
    more = [(100 + i, t + " q") for i, (_, t) in enumerate(many)]
    assert {r.component_id for r in m.near_duplicates(documents(spark, many + more)).collect()} == {1}


def test_buckets_with_several_leaders(spark):
    """Texts a little under the threshold: many buckets, few links, small blocks."""
    rng = random.Random(12)
    given = [t for share in (0.07, 0.12) for base in (prose(rng, 90), prose(rng, 90)) for t in family(rng, base, 60, share)]
    old, m.BLOCK_ROWS = m.BLOCK_ROWS, 7
    try:
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in m.near_duplicates(documents(spark, given), shingle=2).collect()}
    finally:
        m.BLOCK_ROWS = old
    assert got == dict(enumerate(brute(given, 2)))
