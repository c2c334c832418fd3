import random

import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from docketry.functions.names import slugify
from docketry.operators.ordering import dense_index, latest_wins, position_in_key, running_max
from docketry.operators.percentiles import exact_percentiles
from docketry.operators import slugs
from docketry.operators.slugs import assign_slugs


def skewed(spark, n=3000):
    """A third of the rows share one key; some keys are NULL."""
    rnd = random.Random(5)
    data = [(i, None if i % 50 == 0 else ("hot" if rnd.random() < 0.35 else f"k{rnd.randrange(40)}"),
             round(rnd.random() * 5000, 2)) for i in range(n)]
    return data, spark.createDataFrame(data, "i int, k string, v double").repartition(7)


def test_dense_index(spark):
    data, df = skewed(spark)
    got = dense_index(df, [F.desc("v"), F.asc("i")], "n").select("i", "n").collect()
    want = {r[0]: p for p, r in enumerate(sorted(data, key=lambda r: (-r[2], r[0])), 1)}
    assert {r.i: r.n for r in got} == want


def test_position_and_running_max_split_a_hot_key(spark):
    data, df = skewed(spark)
    placed = position_in_key(df, ["k"], [F.asc("v"), F.asc("i")], "p").where("k is not null")
    got = {r.i: (r.p, r.top) for r in running_max(placed.withColumn("w", F.col("i") % 97), ["k"], "p", "w", "top", chunk=64).collect()}
    want = {}
    for key in {r[1] for r in data if r[1]}:
        top = -1
        for p, r in enumerate(sorted((r for r in data if r[1] == key), key=lambda r: (r[2], r[0]))):
            top = max(top, r[0] % 97)
            want[r[0]] = (p, top)
    assert got == want


def test_latest_wins_does_not_depend_on_partitioning(spark):
    data = [(1, 1, "a"), (1, 2, "b"), (1, 2, "c"), (2, None, "d")]
    df = spark.createDataFrame(data, "k int, q int, x string")
    first = rows(latest_wins(df, ["k"], [F.desc_nulls_last("q")]))
    assert len(first) == 2 and first[1] == (2, None, "d")
    assert rows(latest_wins(df.repartition(3, "x"), ["k"], [F.desc_nulls_last("q")])) == first


def test_group_limit_prunes_below_the_shuffle(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    plan = latest_wins(df, ["k"], [F.desc("id")])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_percentiles_equal_numpy(spark):
    data, df = skewed(spark)
    wanted = {"p25": 0.25, "p50": 0.5, "p90": 0.9}
    got = exact_percentiles(df, ["k"], F.col("v"), wanted, "n", band=250.0, digits=None).collect()
    groups = {}
    for _, k, v in data:
        groups.setdefault(k, []).append(v)
    assert {r.k: r.n for r in got} == {k: len(v) for k, v in groups.items()}
    for r in got:
        want = np.percentile(groups[r.k], [25, 50, 90])
        assert np.allclose([r.p25, r.p50, r.p90], want)


def greedy(entities, used=()):
    """The sequential rule: the first free choice in rank order, then numbers."""
    seen, out = set(used), {}
    for rank, choices, stem in sorted(entities):
        slug = next((c for c in choices if c and c not in seen), None)
        n = 2
        while slug is None:
            if f"{stem}-{n}" not in seen:
                slug = f"{stem}-{n}"
            n += 1
        seen.add(slug)
        out[rank] = slug
    return out


def test_slugs_equal_the_sequential_rule(spark):
    """Few names, so that choices collide across names too: 'a' in 'va' against 'a va', and
    numbers against names that end in a number and against id tails."""
    rnd = random.Random(11)
    names = ["a", "a va", "a 2", "a 3", "a va 2", "b", "a ny", "b 2 2", "a 4"]
    data = []
    for rank in range(1, 121):
        name = rnd.choice(names + ["a"] * 6)
        state = rnd.choice(["va", "ny", None])
        tail = rnd.choice([None, None, "2", "3", "0007", "5"])
        data.append((rank, name, state, tail))
    df = spark.createDataFrame(data, "rank int, name string, state string, tail string")
    stem = slugify(F.col("name"))
    choices = [
        stem,
        F.concat_ws("-", stem, F.coalesce("state", F.lit("xx"))),
        F.when(F.col("tail").isNotNull(), F.concat_ws("-", stem, "tail")),
    ]
    used = spark.createDataFrame([("a-5",), ("b",)], "slug string")
    got = {r["rank"]: r.slug for r in assign_slugs(df, "rank", choices, stem, used).collect()}
    plain = []
    for rank, name, state, tail in data:
        s = name.replace(" ", "-")
        plain.append((rank, [s, f"{s}-{state or 'xx'}", f"{s}-{tail}" if tail else None], s))
    assert got == greedy(plain, ["a-5", "b"])
    assert len(set(got.values())) == len(data)


def test_numbers_taken_before_cost_no_rounds(spark, monkeypatch):
    """10,000 taken numbers with holes, a hot stem, and numbers that others hold by name."""
    taken = [n for n in range(2, 10_002) if n % 1000]
    used = [f"a-{n}" for n in taken] + ["a", "a-1", "a-007", "a-2-5", "b-3", "a-" + "9" * 30, "a-3"]
    data = [(r, "a" if r % 3 else "b") for r in range(1, 91)] + [(91, "a 10005"), (92, "a 10"), (5000, "a")]
    df = spark.createDataFrame(data, "rank int, name string")
    stem = slugify(F.col("name"))
    rounds, advance = [], slugs._advance
    monkeypatch.setattr(slugs, "_advance", lambda *a: rounds.append(1) or advance(*a))
    got = {r["rank"]: r.slug for r in assign_slugs(df, "rank", [stem], stem, spark.createDataFrame([(u,) for u in used], "s string")).collect()}
    plain = [(r, [n.replace(" ", "-")], n.replace(" ", "-")) for r, n in data]
    assert got == greedy(plain, used)
    assert [got[1], got[13], got[14], got[16]] == ["a-1000", "a-9000", "a-10000", "a-10002"] and len(rounds) <= 4
