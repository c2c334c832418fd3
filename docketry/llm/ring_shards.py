"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has CELLS cells. Every shard owns `virtual` of them as virtual nodes, and a key belongs
to the first virtual node at or after its cell. Shards hold at most their quota, floor or
ceiling of rows / shards, so counts differ by one at most; what overflows a full shard goes on
clockwise to the next virtual node whose shard has room. Own keys come before overflow, so a
key moves only if its own shard is full.

Where everything goes follows from counts alone: rows are numbered once along the ring by a
distributed sort, every arc is then a range of numbers, and the walk moves ranges, not rows.
Its input is one count per virtual node and its output a few ranges per virtual node, both
bounded by shards x virtual whatever the data. A key that holds a third of all rows is a range
like any other and is cut where its shard is full. Slots come from the same ranges.

Null keys share one place on the ring. Repeated rows each get a slot of their own. An empty
table gives an empty result. Extra columns pass through; `shard` and `slot` are replaced.
"""

from __future__ import annotations

import json
from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.llm.frames import col, packed
from docketry.operators.ordering import dense_index

CELL_BITS = 16
LEAST, MOST = -(1 << 63), (1 << 63) - 1
VIRTUAL = 64


def ring(spark: SparkSession, shards: int, virtual: int = VIRTUAL) -> DataFrame:
    """(arc, owner): the virtual nodes in ring order; `arc` is where the arc ends, a 64-bit hash.

    A place that several nodes hash to goes to the smallest shard number.
    """
    owner, copy = (F.col("id") % shards).cast("int"), F.floor(F.col("id") / shards)
    place = F.xxhash64(F.lit("node"), owner, copy)  # the same whatever `shards`
    nodes = spark.range(shards * virtual, numPartitions=1).select(owner.alias("owner"), place.alias("arc"))
    return nodes.groupBy("arc").agg(F.min("owner").alias("owner"))


def _cell(place: Column) -> Column:
    """The ring in CELLS equal parts: where a place is looked up."""
    return (F.shiftright(place, 64 - CELL_BITS) + (1 << (CELL_BITS - 1))).cast("int")


def arcs_by_cell(nodes: DataFrame) -> DataFrame:
    """(_cell, _low, _high, _arc): the ranges of places of every arc, in each cell that they touch.
    Cells plus nodes bound its rows."""
    before = Window.orderBy("arc")  # the nodes of a ring, whatever the data
    first, last = F.min("arc").over(Window.partitionBy()), F.max("arc").over(Window.partitionBy())
    ends = nodes.select("arc", F.lag("arc").over(before).alias("prior"), first.alias("first"), last.alias("last"))
    low = F.when(F.col("prior").isNull(), F.lit(LEAST)).otherwise(F.col("prior") + 1)
    own = ends.select(low.alias("_low"), F.col("arc").alias("_high"), F.col("arc").alias("_arc"))
    # Past the last node the ring goes on at the first.
    rest = ends.where((F.col("arc") == F.col("last")) & (F.col("last") < F.lit(MOST))).select((F.col("last") + 1).alias("_low"), F.lit(MOST).alias("_high"), F.col("first").alias("_arc"))
    return own.unionByName(rest).select("*", F.explode(F.sequence(_cell(F.col("_low")), _cell(F.col("_high")))).alias("_cell"))


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table from the driver, read by the JVM alone."""
    names = [c.split()[0] for c in schema.split(",")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>")))


def walk(counts: list[tuple[int, int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Ranges (arc, from, to, shard, slot of from) for arcs (arc, owner, rows) in ring order."""
    total = sum(n for _, _, n in counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    out, over = [], []

    def place(arc: int, low: int, high: int, shard: int) -> int:
        n = min(high - low, room[shard] - used[shard])
        if n:
            out.append((arc, low, low + n, shard, used[shard]))
            used[shard] += n
        return low + n

    for arc, owner, n in counts:
        over.append((arc, place(arc, 0, n, owner), n))
    carried: deque[tuple[int, int, int]] = deque()
    for lap in range(2):
        for (arc, owner, _), (_, low, high) in zip(counts, over, strict=True):
            if lap == 0 and low < high:
                carried.append((arc, low, high))
            while carried and used[owner] < room[owner]:
                a, lo, hi = carried.popleft()
                lo = place(a, lo, hi, owner)
                if lo < hi:
                    carried.appendleft((a, lo, hi))
    return out


def shard_rows(df: DataFrame, key: str, shards: int, virtual: int = VIRTUAL, order: list[str] | None = None) -> DataFrame:
    """`df` with `shard` (0 to shards - 1) and `slot` (0, 1, ... within the shard).

    `order` names columns that break ties between rows of one key.
    """
    spark = df.sparkSession
    kept = df.drop("shard", "slot")
    nodes = ring(spark, shards, virtual)
    held = sorted((r.arc, r.owner) for r in nodes.collect())  # shards x virtual nodes
    arcs = arcs_by_cell(nodes)
    marked = packed(kept, _place=F.xxhash64(F.lit("key"), col(key))).withColumn("_cell", _cell(F.col("_place")))
    marked = marked.join(F.broadcast(arcs), "_cell").where("_place >= _low AND _place <= _high").drop("_low", "_high", "_cell")
    ties = [F.col("row").getField(c).asc_nulls_first() for c in [key, *(order or [])]]
    indexed = dense_index(marked, [F.col("_arc"), F.col("_place"), *ties], "_at", start=0)
    sums = {r["_arc"]: (r["first"], r["n"]) for r in indexed.groupBy("_arc").agg(F.min("_at").alias("first"), F.count("*").alias("n")).collect()}
    counts = [(arc, owner, sums.get(arc, (0, 0))[1]) for arc, owner in held]
    ranges = [(arc, sums[arc][0] + low, sums[arc][0] + high, shard, slot) for arc, low, high, shard, slot in walk(counts, shards)]
    if not ranges:
        return kept.withColumns({"shard": F.lit(None).cast("int"), "slot": F.lit(None).cast("long")})
    plan = _rows(spark, ranges, "_arc long, _low long, _high long, shard int, _slot long")
    found = indexed.join(F.broadcast(plan), "_arc").where("_at >= _low AND _at < _high")
    return found.select("row.*", "shard", (F.col("_at") - F.col("_low") + F.col("_slot")).alias("slot"))
