"""Mixing: targets by plain water filling, dependent rounding, the reduction tree, the mixture."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from plain import documents, words

from docketry.llm import pivotal_mix as p


def targets(sizes):
    """Shares by weight, what is over 3 times a source's size shared again until none is."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    full, left, rest = {}, set(order), sum(sizes.values())
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * sizes[s]]
        if not over:
            return {**full, **share}
        for s in over:
            full[s] = 3 * sizes[s]
            rest -= full[s]
            left.remove(s)


def rows():
    rng = random.Random(3)
    out = []
    for i in range(900):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b", "é", "Z", None, "tiny" if i < 8 else "c"])
        out.append((i, " ".join("w" for _ in range(rng.choice([0, 1, 7, 30, 31, 200]))), source))
    return [*out, (5000, None, "a"), (5001, "", "only empty"), (7, "again again", "a"), (7, "again again", "a")]


def test_targets_equal_water_filling(spark):
    given = rows()
    sizes = Counter()
    for _, t, s in given:
        sizes[s] += len(words(t))
    got = {r.source: (r.source_size, r.target) for r in p.source_targets(p.with_size(documents(spark, given))).collect()}
    want = targets(sizes)
    assert {s: n for s, (n, _) in got.items()} == dict(sizes)
    assert all(got[s][1] == pytest.approx(want[s]) for s in want)
    assert sum(t for _, t in got.values()) == pytest.approx(sum(sizes.values()))


def test_mix_meets_targets_through_a_tree(spark):
    given = rows()
    docs = documents(spark, given)
    out = p.mix_rows(docs, chunk=20).collect()
    taken, target, largest = Counter(), {}, Counter()
    for r in out:
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 3
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], 3 * r.size)
    assert len(out) == len(given)
    assert all(abs(taken[s] - target[s]) <= max(1, largest[s]) for s in target)
    again = {(r.doc_id, r.source, r.size): r.taken for r in p.mix_rows(docs.repartition(7), chunk=20).collect()}
    assert again == {(r.doc_id, r.source, r.size): r.taken for r in out}


def test_rounding_keeps_words_and_is_fair():
    rng = np.random.default_rng(1)
    mass, prob = np.array([5, 9, 2, 14, 7, 3, 8], float), np.array([0.2, 0.5, 0.7, 0.35, 0.9, 0.0, 1.0])
    total = np.zeros(7)
    for _ in range(3000):
        unit = rng.integers(-(1 << 62), 1 << 62, 7)
        out = p._round_chunk(pa.table({"unit": unit, "mass": mass, "p": prob})).column("p").to_numpy()
        assert abs((out * mass).sum() - (prob * mass).sum()) < 1e-9 and ((out > 0) & (out < 1)).sum() <= 1
        total += out
    assert abs(total / 3000 - prob).max() < 0.03


def test_mixture_repeats_rows_with_their_columns(spark):
    given = rows()
    docs = documents(spark, given).withColumnsRenamed({"lang": "copies", "n_chars": "row"})
    out = p.mix_documents(docs, chunk=50)
    assert out.schema == docs.schema
    times = defaultdict(set)
    for r in p.mix_rows(docs, chunk=50).collect():
        times[r.doc_id, r.source].add(r.copies)
    rowed = Counter((k, s) for k, _, s in given)
    want = {key: next(iter(c)) * rowed[key] for key, c in times.items() if max(c)}
    assert Counter((r.doc_id, r.source) for r in out.collect()) == want
    assert p.mix_documents(docs.limit(0)).count() == 0 and p.mix_rows(docs.limit(0)).count() == 0
