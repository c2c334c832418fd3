"""Mixing sources to target weights by pivotal dependent rounding.

Sources in code-point order, null last, weigh 1, 2, 3, 1, 2, 3, ... and share all words. A
target stops at `most` times its source's words; what is over is shared again by weight. Both
follow from one level: target = min(most * words, level * weight).

A document is taken `floor(r)` times for sure, r = target / words of its source, and once more
with the fractional part as its probability. The fractional parts are rounded dependently:
two documents of a source trade probability so that the expected words of the pair stay the
same, until one is 0 or 1. Every task rounds a bounded chunk of one source and hands on the
one document left between 0 and 1; these meet in chunks of the next level, a reduction tree,
until one document per source is left and goes to the nearer side. So each source misses its
target by half a document at most, and a third of all rows in one source are many chunks.

All draws come from hashes of ids and the seed, so reruns agree. Null and empty texts have no
words: they are taken floor(r) times, which adds nothing. A null id is an id like any other.
Rows that share id and source are rounded as one unit of their joint size and all get its
copies. Extra columns stay as they are in `mix_documents`; an empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm import words as W
from docketry.llm.frames import col, packed
from docketry.session import cut_lineage

WEIGHTS = (1, 2, 3)
MOST = 3
CHUNK = 5_000  # documents that one task rounds
SEED = 11


def with_size(docs: DataFrame, text: str = "text", size: str = "size") -> DataFrame:
    """`docs` with the number of words of `text`; the text itself is left out."""
    names = [c for c in docs.columns if c not in (text, size)]
    schema = docs.select(*[col(c) for c in names]).schema.add(size, "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.diff(W.find_words(b.data, b.at).first) for b in W.blocks(batch.column(len(names)))]
            sizes = pa.array(np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sizes], [*names, size])

    return docs.select(*[col(c) for c in names], col(text)).mapInArrow(count, schema)


def source_targets(sized: DataFrame, source: str = "source", size: str = "size", weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: source, source_size, target.

    Sources are ordered by the level that fills them, most * words / weight. Sharing the rest
    among those not yet full gives a level per place; it rises until they can take it all and
    falls after, so the highest is the level sought. The windows see one row per source.
    """
    name = col(source)
    sums = sized.groupBy(name.alias("source")).agg(F.sum(size).alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").cast("binary").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights)).cast("int"))
    full = most * F.col("source_size")
    ranked = sums.withColumn("w", weight).withColumn("fill", full / F.col("w"))
    order = Window.orderBy("fill", "w", F.col("source").cast("binary"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    rest = F.sum("source_size").over(every) - F.coalesce(F.sum(full).over(before), F.lit(0))
    open_weight = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    levels = ranked.withColumn("level", rest / open_weight)
    return levels.withColumn("top", F.max("level").over(every)).select(
        "source", "source_size", F.coalesce(F.least(full.cast("double"), F.col("top") * F.col("w")), F.lit(0.0)).alias("target")
    )


def _round_chunk(rows: pa.Table) -> pa.Table:
    """Pivotal rounding of one chunk: columns unit, mass, p; at most one p stays between 0 and 1."""
    unit = rows.column("unit").to_numpy().view(np.uint64)
    # Falling mass: partners are alike in size, and what stays fractional at the end is small.
    order = np.lexsort((unit, -rows.column("mass").to_numpy()))
    mass, p = rows.column("mass").to_numpy()[order].astype(float), rows.column("p").to_numpy()[order].copy()
    draw = (W.mix(unit[order] ^ np.uint64(SEED)) >> np.uint64(11)) / float(1 << 53)
    held = -1
    for i in np.flatnonzero((p > 0) & (p < 1) & (mass > 0)):
        if held < 0:
            held = i
            continue
        # Words move from one to the other; up: most that `held` can gain, down: most it can lose.
        a, b = mass[held], mass[i]
        up = min((1 - p[held]) * a, p[i] * b)
        down = min(p[held] * a, (1 - p[i]) * b)
        gain = draw[i] < down / (up + down)
        step = up if gain else -down
        held_full, other_full = (step == (1 - p[held]) * a, step == p[i] * b) if gain else (-step == p[held] * a, -step == (1 - p[i]) * b)
        p[held] = (1.0 if gain else 0.0) if held_full else p[held] + step / a
        p[i] = (0.0 if gain else 1.0) if other_full else p[i] - step / b
        if held_full:
            held = -1 if other_full else i
    idle = (mass == 0) & (p > 0)
    p[idle] = 0.0  # nothing to take
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return rows.set_column(rows.schema.get_field_index("p"), "p", pa.array(p[back]))


def _tree(units: DataFrame, chunk: int) -> DataFrame:
    """units (source, unit, mass, p, ...) with every p 0 or 1."""
    done, level = None, 0
    rest = units
    while True:
        sizes = rest.groupBy("source").agg(F.ceil(F.count("*") / chunk).cast("long").alias("chunks"))
        last = sizes.agg(F.max("chunks")).first()[0] or 1
        keyed = rest.alias("r").join(sizes.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).select("r.*", "s.chunks")
        keyed = keyed.withColumn("chunk", F.pmod(F.xxhash64("unit", F.lit(SEED + level)), "chunks"))
        schema = keyed.schema
        out = cut_lineage(keyed.groupBy("source", "chunk").applyInArrow(_round_chunk, schema).drop("chunk", "chunks"))
        inner = "p > 0 AND p < 1"
        settled = out.where(f"NOT ({inner})")
        done = settled if done is None else done.unionByName(settled)
        rest = out.where(inner)
        if last == 1:
            break
        level += 1
    return done.unionByName(rest.withColumn("p", (F.col("p") >= 0.5).cast("double")))


def mix_copies(sized: DataFrame, doc_id: str = "doc_id", source: str = "source", size: str = "size", weights: tuple = WEIGHTS, most: int = MOST, chunk: int = CHUNK) -> DataFrame:
    """Per id and source: doc_id, source, source_size, target, copies (of each such row)."""
    names = [col(doc_id).alias("doc_id"), col(source).alias("source"), col(size).alias("size")]
    sized = sized.select(*names)
    targets = cut_lineage(source_targets(sized, "source", "size", weights, most))
    units = sized.groupBy("doc_id", "source").agg(F.sum("size").alias("mass"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = units.alias("u").join(targets.alias("t"), F.col("u.source").eqNullSafe(F.col("t.source"))).select("u.*", "t.source_size", "t.target")
    units = units.withColumns({"sure": F.floor(rate).cast("long"), "p": rate - F.floor(rate), "unit": F.xxhash64("doc_id", "source")})
    rounded = _tree(units, chunk)
    return rounded.select("doc_id", "source", "source_size", "target", (F.col("sure") + F.col("p").cast("long")).alias("copies"))


def mix_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """Per row of `docs`: doc_id, source, size, source_size, target, copies, taken."""
    plain = docs.select(col(doc_id).alias("doc_id"), col(source).alias("source"), col(text).alias("text"))
    sized = cut_lineage(with_size(plain))
    copies = mix_copies(sized, **options)
    same = F.col("s.doc_id").eqNullSafe(F.col("c.doc_id")) & F.col("s.source").eqNullSafe(F.col("c.source"))
    joined = sized.alias("s").join(copies.alias("c"), same).select("s.*", "c.source_size", "c.target", "c.copies")
    return joined.withColumn("taken", F.col("size") * F.col("copies"))


def mix_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mixture itself: each row of `docs` as often as it is taken, with its columns."""
    plain = docs.select(col(doc_id).alias("doc_id"), col(source).alias("source"), col(text).alias("text"))
    copies = mix_copies(cut_lineage(with_size(plain)), **options).where("copies > 0")
    same = F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & F.col("d.source").eqNullSafe(F.col("c.source"))
    joined = packed(docs, doc_id=doc_id, source=source).alias("d").join(copies.alias("c"), same)
    return joined.select("d.row", F.explode(F.sequence(F.lit(1), F.col("c.copies").cast("int")))).select("row.*")
