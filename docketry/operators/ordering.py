"""Orders and positions that hold up when one key owns a third of the rows.

A window that numbers rows sends each group to one task. `best_per_key` keeps such windows
only where a row limit prunes the group before the shuffle; full numberings go through a
range-partitioned sort, which splits a hot group over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.session import cut_lineage

_ROW_BITS = 33  # bits monotonically_increasing_id gives to the row inside a partition


def best_per_key(
    df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str | None = None
) -> DataFrame:
    """The first `n` rows of every key in a total order.

    Spark plans the rank filter as a group limit below the shuffle, so a task ships at most
    `n` rows of a key however many it read.
    """
    name = rank or "_rank"
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def dense_index(df: DataFrame, order: list[Column], name: str, start: int = 1) -> DataFrame:
    """Number all rows start, start+1, ... in a total order, without a one-task window.

    A global sort spreads the rows over range partitions; a row's number is its place in the
    partition plus the sizes of the partitions before. The sorted rows are checkpointed
    first: both reads below must see the same partitions.
    """
    marked = cut_lineage(df.orderBy(*order).withColumn("_mark", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_mark"), _ROW_BITS).cast("int")
    place = F.col("_mark") - F.shiftleft(part.cast("bigint"), _ROW_BITS)
    sizes = marked.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the sort, so the window and the broadcast are bounded by
    # the partition count, not by the data.
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    return (
        marked.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, place + F.col("_offset") + F.lit(start))
        .drop("_part", "_offset", "_mark")
    )


def position_in_key(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Position 0, 1, ... of every row inside its key; a hot key is numbered by many tasks."""
    indexed = dense_index(df, [F.col(k).asc_nulls_first() for k in keys] + order, "_index")
    first = indexed.groupBy(*keys).agg(F.min("_index").alias("_first"))
    same = [F.col("r." + k).eqNullSafe(F.col("k." + k)) for k in keys]
    return (
        indexed.alias("r")
        .join(first.alias("k"), same)
        .select(
            *["r." + c for c in df.columns],
            (F.col("_index") - F.col("_first")).alias(name),
        )
    )


def running_max(
    df: DataFrame, keys: list[str], position: str, value: str, name: str, chunk: int = 100_000
) -> DataFrame:
    """Largest `value` among the rows of the key at or before `position`.

    Two levels: inside chunks of positions, and over the one-row summaries of the chunks
    before, so no task holds more than a chunk or a key's list of chunks.
    """
    cut = df.withColumn("_chunk", F.floor(F.col(position) / chunk))
    tops = cut.groupBy(*keys, "_chunk").agg(F.max(value).alias("_top"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*keys, "_chunk", F.max("_top").over(earlier).alias("_before"))
    inside = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy(position)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        cut.join(tops, [*keys, "_chunk"])
        .withColumn(name, F.greatest(F.max(value).over(inside), F.col("_before")))
        .drop("_chunk", "_before")
    )


def latest_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in `order`, with the rest of the row as the final tie-break,
    so equal inputs give equal results on any partitioning."""
    rest = [F.xxhash64(*[F.col(c) for c in df.columns]).desc()]
    return best_per_key(df, keys, order + rest)
