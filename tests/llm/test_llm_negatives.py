"""Hard negatives: certain intervals and whole results against all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.llm import hard_negatives as hn

VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize(("size", "bits"), [(1, 64), (7, 100), (64, 1024), (100, 64)])
def test_intervals_hold_every_score(size, bits):
    rng = np.random.default_rng(size)
    v = rng.integers(-300, 300, (400, size))
    v[:5], v[5] = v[5:6], 0  # repeats, and a zero vector
    turns = hn.Rotations(size, bits)
    code, c, y2, rest = turns.codes(v)
    codes = np.ascontiguousarray(code.T)
    for q in [*v[:20].astype(float), np.zeros(size)]:
        low, high = hn.interval(q, turns, codes, np.bitwise_count(codes).sum(axis=0, dtype=np.int64), c, y2, rest)
        scores = v @ q
        assert (low <= scores).all() and (scores <= high).all()


def test_intervals_leave_out_most_rows_of_far_scores():
    rng = np.random.default_rng(1)
    v = np.floor(256 * rng.standard_normal((4000, 64)) / 8).astype(np.int64)
    turns = hn.Rotations(64)
    code, c, y2, rest = turns.codes(v)
    codes = np.ascontiguousarray(code.T)
    low, high = hn.interval(v[0].astype(float), turns, codes, np.bitwise_count(codes).sum(axis=0, dtype=np.int64), c, y2, rest)
    assert (high >= 0.3 * (v[0] @ v[0])).mean() < 0.5


def brute(rows, n=5, m=5):
    kept = []
    for i, (key, x, label) in enumerate(rows):
        if key is None or x is None or label is None or any(e is None or not math.isfinite(e) for e in x):
            continue
        kept.append((key, i, (label + 1) % 10 if key % 7 == 0 else label, [math.floor(256 * float(np.float32(e))) for e in x]))
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=False))
    out = []
    for a in kept:
        if a[0] % 100:
            continue
        scored = sorted((-dot(a[3], b[3]), b[0], b[1], b[2]) for b in kept if b[1] != a[1])
        for p in [s for s in scored if s[3] == a[2]][:n]:
            fit = [s for s in scored if s[3] != a[2] and 80 * -p[0] <= 100 * -s[0] <= 100 * -p[0]][:m]
            out += [(a[0], p[1], k + 1, s[1], -p[0], -s[0]) for k, s in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, schema=VECTORS):
    df = spark.createDataFrame(rows, schema)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, hn.mine_hard_negatives(df, F.col("vec_id") % 100 == 0, label=label).collect()))


def test_equals_all_pairs(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(k, [rng.gauss(0, 0.2) for _ in range(12)], rng.randrange(3)) for k in range(420)]
    rows += [(500, rows[0][1], 0), (600, rows[0][1], 1), *[(700 + k, rows[100][1], rows[100][2]) for k in range(40)]]  # copies
    rows += [(None, rows[0][1], 0), (801, None, 0), (802, rows[0][1], None), (803, [None, 1.0], 0), (804, [float("nan")] * 12, 0), (900, [float("inf")] * 12, 1)]
    rows += [(810, [], 0), (811, [0.5], 1), (812, [0.0] * 12, 2)]
    monkeypatch.setattr(hn, "ANCHOR_BLOCK", 3)
    got = mined(spark, rows)
    assert got == brute(rows) and len(got) > 50


def test_repeated_ids_are_rows_of_their_own(spark):
    rng = random.Random(5)
    rows = [(k, [rng.gauss(0, 0.3) for _ in range(6)], k % 2) for k in range(1, 60)]
    rows += [(100, rows[0][1], 1), (100, rows[0][1], 1), (100, rows[7][1], 0)]
    assert mined(spark, rows) == brute(rows)


def test_extra_columns_clashing_names_and_empty_tables(spark):
    df = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2)], VECTORS).selectExpr("*", "1 AS mark", "'x' AS v", "2 AS code")
    got = hn.mine_hard_negatives(df, F.col("vec_id") % 100 == 0)
    assert list(map(tuple, got.collect())) == [(0, 1, 1, 2, 65536, 58880)]
    assert hn.mine_hard_negatives(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []
