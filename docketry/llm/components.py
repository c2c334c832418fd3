"""Connected components of an edge table, as Spark jobs that cut their lineage each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.session import cut_lineage


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of `edges` (u, v).

    Alternating star contraction: neighbours are hung on the smallest of them, first the larger
    ones, then the smaller. Minimums are combined before the shuffle and joined back, so a hub
    never collects its neighbours in one task. Ends when a round changes nothing.
    """
    now = cut_lineage(edges.where(F.col("u") != F.col("v")).select("u", "v").distinct())
    seen = None
    while True:
        both = _both_ways(now)
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v"))
        base = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(base, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(base.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()
        now = cut_lineage(small)
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first())
        if state == seen:
            break
        # Every node has one parent and no parent is a child: the stars are finished.
        if state[0] == state[2] and not now.alias("a").join(now.alias("b"), F.col("a.v") == F.col("b.u"), "left_semi").take(1):
            break
        seen = state
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
