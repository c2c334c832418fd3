"""Exact interpolated percentiles that do not hold a group's values in one task.

The built-in `percentile` merges a map of all distinct values of a group on one executor.
Here rows are counted per (key, value), which spreads a hot key by its values; a histogram
of value bands per key then says in which band each wanted rank falls, and only the values
of those bands are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.session import cut_lineage


def exact_percentiles(
    df: DataFrame,
    keys: list[str],
    value: Column,
    wanted: dict[str, float],
    count: str,
    band: float,
    digits: int | None = 0,
) -> DataFrame:
    """Per key: row count and percentiles of the non-NULL `value`s, linearly interpolated.

    `wanted` maps output column to fraction. `band` is the width of a histogram band; the
    value range over `band` bounds the histogram rows of a key, and the distinct values
    inside one band bound what a task ranks.
    """
    # Written once: the histogram and the ranked values both read the counts, never the rows.
    counted = cut_lineage(
        df.select(*keys, value.alias("_v"))
        .where(F.col("_v").isNotNull())
        .groupBy(*keys, "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return percentiles_of_counts(counted, keys, wanted, count, band, digits)


def percentiles_of_counts(
    counted: DataFrame, keys: list[str], wanted: dict[str, float], count: str, band: float, digits: int | None = 0
) -> DataFrame:
    """`exact_percentiles` of values already counted: one row (keys, _v, _n) per key and value. It is
    read twice, so it should be a written table."""
    counted = counted.withColumn("_band", F.floor(F.col("_v") / band))
    bands = counted.groupBy(*keys, "_band").agg(F.sum("_n").alias("_in"))
    by_key = Window.partitionBy(*keys)
    upto = by_key.orderBy("_band").rowsBetween(Window.unboundedPreceding, 0)
    ladder = bands.select(
        *keys,
        "_band",
        "_in",
        (F.sum("_in").over(upto) - F.col("_in")).alias("_below"),
        F.sum("_in").over(by_key).alias("_all"),
    )
    # A percentile sits between two neighbouring ranks, which may fall in two bands.
    spots = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), _rank(q, side).alias("rank"))
            for i, q in enumerate(wanted.values())
            for side in (0, 1)
        ]
    )
    hits = (
        ladder.withColumn("_spot", F.explode(spots))
        .where(
            (F.col("_spot.rank") >= F.col("_below"))
            & (F.col("_spot.rank") < F.col("_below") + F.col("_in"))
        )
        .groupBy(*keys, "_band", "_below", "_all")
        .agg(F.collect_list("_spot").alias("_spots"))  # at most two per wanted percentile
    )
    same = [F.col("v." + k).eqNullSafe(F.col("h." + k)) for k in keys]
    in_band = Window.partitionBy(*keys, "_band").orderBy("_v")
    ranked = (
        counted.alias("v")
        .join(hits.alias("h"), [*same, F.col("v._band") == F.col("h._band")])
        .select(*["v." + k for k in keys], "v._band", "_v", "_n", "_below", "_all", "_spots")
        .withColumn("_end", F.col("_below") + F.sum("_n").over(in_band.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_spot", F.explode("_spots"))
        .where(
            (F.col("_spot.rank") < F.col("_end"))
            & (F.col("_spot.rank") >= F.col("_end") - F.col("_n"))
        )
    )

    def at(i: int, side: int) -> Column:
        here = (F.col("_spot.i") == i) & (F.col("_spot.side") == side)
        return F.max(F.when(here, F.col("_v")))

    out = []
    for i, (name, q) in enumerate(wanted.items()):
        place = (F.max("_all") - 1) * F.lit(float(q))
        low, high = at(i, 0), at(i, 1)
        mid = low + (high - low) * (place - F.floor(place))
        out.append((mid if digits is None else F.round(mid, digits)).alias(name))
    return ranked.groupBy(*keys).agg(F.max("_all").cast("int").alias(count), *out)


def _rank(q: float, side: int) -> Column:
    place = (F.col("_all") - 1) * F.lit(float(q))
    return (F.ceil(place) if side else F.floor(place)).cast("bigint")
