"""Hard negatives from one-bit codes with exact integer scores.

Vectors are taken as integers, floor(scale * x), and scored by their inner product. Every vector
o is turned by several random rotations and only the signs are kept: its code. Summing the
rotations' rows with these signs gives the code's vector y; stored beside the code are the
alignment c = <o, y> / |y|^2, |y|^2 and the length of the residual o - c y.

For an anchor q, the turned q is rounded to `planes` bits a place, and <q, y> is estimated from
popcounts of code AND bit plane; what rounding can change is summed exactly per anchor. As
<o, q> = c <q, y> + <o - c y, q - <q, y> y / |y|^2>, Cauchy-Schwarz bounds the score from both
sides with certainty. Rows whose interval cannot matter are dropped unscored, all others get
their integer score, so results are exact.

Anchors and rows are dealt into blocks by a hash of a row number, and every block of anchors meets
every block of rows in a task of its own: memory is two blocks, a frequent label, vector or id
makes no block larger, and a task passes on only the best few per anchor. Two rounds: positives
(best rows of the same label), then negatives inside each positive's score window.

A row takes no part if its id, label or vector is null, or if a component is null, not finite or
beyond +-2^25 after scaling (scores would not fit 64 bits). Vectors of unequal lengths
are compared as if the shorter went on with zeros. Rows with one id are rows of their own (two
anchors, if the id makes anchors); ties go to the smaller id, then the smaller row number. Anchors
without positives, and positives without negatives, return nothing. Empty tables return no rows.
Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.frames import col
from docketry.operators.ordering import best_per_key
from docketry.session import cut_lineage

BITS = 1024  # of a code at least; whole rotations
PLANES = 6  # bits a place of a rounded anchor
ANCHOR_BLOCK, ROW_BLOCK = 4096, 32768  # rows of a block, about
LARGEST = 1 << 25
ROW = "mark long, vec_id long, label long, v binary, code binary, c double, y2 double, rest double"


class Rotations:
    """Random rotations of `size` places, one below the other."""

    def __init__(self, size: int, bits: int = BITS, seed: int = 12):
        rng = np.random.default_rng([seed, size])
        turns = []
        for _ in range(max(1, math.ceil(bits / max(size, 1)))):
            q, r = np.linalg.qr(rng.standard_normal((size, size)))
            turns.append(q.T * np.sign(np.diagonal(r))[:, None])
        self.rows = np.concatenate(turns)  # (places of a code, size)
        self.words = -(-len(self.rows) // 64)

    def codes(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes of integer vectors (n, words), with c, |y|^2 and the residual's length."""
        v = v.astype(np.float64)
        up = v @ self.rows.T >= 0
        y = np.where(up, 1.0, -1.0) @ self.rows
        y2 = np.einsum("ij,ij->i", y, y)
        c = np.einsum("ij,ij->i", v, y) / np.maximum(y2, 1e-300)
        rest = np.linalg.norm(v - c[:, None] * y, axis=1)
        bits = np.zeros((len(v), 64 * self.words), bool)
        bits[:, : len(self.rows)] = up
        return np.packbits(bits, axis=1, bitorder="little").view("<u8"), c, y2, rest


def interval(q: np.ndarray, turns: Rotations, codes: np.ndarray, ones: np.ndarray, c: np.ndarray, y2: np.ndarray, rest: np.ndarray, planes: int = PLANES) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the scores of all rows with the anchor q. `codes` is (words, rows), `ones` each code's popcount."""
    turned = turns.rows @ q
    low = turned.min(initial=0.0)
    step = max(turned.max(initial=0.0) - low, 1e-9) / ((1 << planes) - 1)
    level = np.rint((turned - low) / step).astype(np.int64)
    slack = np.abs(turned - (low + step * level)).sum()
    bits = np.zeros((planes, 64 * turns.words), bool)
    bits[:, : len(level)] = (level >> np.arange(planes)[:, None]) & 1
    plane = np.packbits(bits, axis=1, bitorder="little").view("<u8")
    up = np.zeros(codes.shape[1], np.int64)  # levels under the code's ones
    for p in range(planes):
        many = np.zeros(codes.shape[1], np.uint32)
        for w in range(turns.words):
            many += np.bitwise_count(codes[w] & plane[p, w])
        up += many.astype(np.int64) << p
    dot = low * (2 * ones - len(level)) + step * (2 * up - level.sum())
    q_rest = np.sqrt(np.maximum(q @ q - np.maximum(np.abs(dot) - slack, 0) ** 2 / np.maximum(y2, 1e-300), 0))
    middle = c * dot
    wide = np.abs(c) * slack + rest * q_rest
    wide += 1e-9 * (np.abs(middle) + wide) + 1e-6  # of the arithmetic itself
    return middle - wide, middle + wide


def integer_rows(vectors: DataFrame, vec_id: str, label: Column, vector: str, scale: int = 256) -> DataFrame:
    """(vec_id, label, v): the rows that take part, v as array<bigint>."""
    x = col(vector)
    given = vectors.select(col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform(x, lambda e: e.cast("double")).alias("x"))
    fit = F.forall("x", lambda e: F.coalesce((F.abs(e) <= LARGEST / scale) & ~F.isnan(e), F.lit(False)))
    kept = given.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & fit)
    return kept.select("vec_id", "label", F.transform("x", lambda e: F.floor(e * scale)).alias("v"))


def encode(rows: DataFrame, size: int, bits: int = BITS) -> DataFrame:
    """Vectors of `size` places as bytes, with code, alignment, |y|^2 and residual."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = Rotations(size, bits)
        for batch in batches:
            lists = batch.column("v")
            v = np.zeros((batch.num_rows, size), np.int32)
            many = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            v[np.repeat(np.arange(len(many)), many), place] = lists.flatten().to_numpy(zero_copy_only=False)
            code, c, y2, rest = turns.codes(v)
            packed = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (v, code)]
            numbers = [pa.array(a) for a in (c, y2, rest)]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in ("mark", "vec_id", "label")], *packed, *numbers], ["mark", "vec_id", "label", "v", "code", "c", "y2", "rest"])

    return rows.mapInArrow(run, ROW)


class Block:
    """Rows of a block as arrays, in order of id and mark."""

    def __init__(self, frame: pd.DataFrame, turns: Rotations):
        frame = frame.sort_values(["vec_id", "mark"])
        self.mark, self.vec_id, self.label = (frame[n].to_numpy(np.int64) for n in ("mark", "vec_id", "label"))
        self.c, self.y2, self.rest = (frame[n].to_numpy(np.float64) for n in ("c", "y2", "rest"))
        self.v = np.frombuffer(b"".join(frame["v"]), "<i4").reshape(len(frame), -1)
        self.codes = np.ascontiguousarray(np.frombuffer(b"".join(frame["code"]), "<u8").reshape(len(frame), turns.words).T)
        self.ones = np.bitwise_count(self.codes).sum(axis=0, dtype=np.int64)

    def bounds(self, q: np.ndarray, turns: Rotations) -> tuple[np.ndarray, np.ndarray]:
        return interval(q.astype(np.float64), turns, self.codes, self.ones, self.c, self.y2, self.rest)

    def scores(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.v[at].astype(np.int64) @ q


def best(scores: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Places among `at` of the n highest scores, ties by place (which follows id and mark)."""
    return np.lexsort((at, -scores))[:n]


def nearest(block: Block, mark: int, label: int, q: np.ndarray, turns: Rotations, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor's n best other rows of its label in the block, and their scores."""
    same = np.flatnonzero((block.label == label) & (block.mark != mark))
    if len(same) > n:
        low, high = block.bounds(q, turns)
        ahead = same[np.argpartition(-(low + high)[same], n - 1)[:n]]
        same = same[high[same] >= block.scores(q, ahead).min()]  # n rows reach that score
    scores = block.scores(q, same)
    first = best(scores, same, n)
    return same[first], scores[first]


def inside(block: Block, label: int, q: np.ndarray, turns: Rotations, limits: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per (low, high) in `limits`, the n best rows of other labels with low <= score <= high."""
    other = np.flatnonzero(block.label != label)
    low, high = block.bounds(q, turns)
    other = other[(high[other] >= limits[:, 0].min()) & (low[other] <= limits[:, 1].max())]
    scores = block.scores(q, other)
    out = []
    for least, most in limits:
        fit = np.flatnonzero((scores >= least) & (scores <= most))
        first = fit[best(scores[fit], other[fit], n)]
        out.append((other[first], scores[first]))
    return out


def meet(anchors: DataFrame, rows: DataFrame, blocks: tuple[int, int], task: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Every block of anchors with every block of rows."""
    a, r = blocks

    def dealt(df: DataFrame, own: str, own_n: int, other: str, other_n: int) -> DataFrame:
        block = F.pmod(F.xxhash64("mark"), F.lit(own_n)).alias(own)
        return df.select("*", block, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other_n - 1).cast("long"))).alias(other)).groupBy("a", "r")

    return dealt(anchors, "a", a, "r", r).cogroup(dealt(rows, "r", r, "a", a)).applyInPandas(task, schema)


def mine_hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: Column | None = None,
    n_positives: int = 5,
    n_negatives: int = 5,
    share: tuple[int, int] = (80, 100),
    scale: int = 256,
    bits: int = BITS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor
    (a condition on `vec_id`) and each of its best rows of the same label, the best rows of other
    labels with share[0] * positive <= share[1] * negative <= share[1] * positive."""
    numbered = integer_rows(vectors, vec_id, col("label") if label is None else label, vector, scale).withColumn("mark", F.monotonically_increasing_id())
    numbered = cut_lineage(numbered)  # marks must not change
    many, size, n_anchors = numbered.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0)), F.count_if(anchors)).first()
    rows = cut_lineage(encode(numbered, size, bits))
    chosen = rows.where(anchors)
    # Blocks are no larger than these sizes, and enough to keep the cores of a small cluster busy.
    tasks = vectors.sparkSession.sparkContext.defaultParallelism
    blocks = (max(1, math.ceil(n_anchors / ANCHOR_BLOCK)), max(math.ceil(many / ROW_BLOCK), 4 * tasks))
    found, told = ["mark", "vec_id", "label", "v", "p_mark", "p_id", "p_score"], "mark long, vec_id long, label long, v binary, p_mark long, p_id long, p_score long"

    def positives(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=found)
        turns = Rotations(size, bits)
        block, out = Block(right, turns), []
        for mark, key, own, v in zip(left["mark"], left["vec_id"], left["label"], left["v"], strict=True):
            at, scores = nearest(block, mark, own, np.frombuffer(v, "<i4").astype(np.int64), turns, n_positives)
            out += [(mark, key, own, v, m, i, s) for m, i, s in zip(block.mark[at], block.vec_id[at], scores, strict=True)]
        return pd.DataFrame(out, columns=found)

    offers = meet(chosen.select("mark", "vec_id", "label", "v"), rows, blocks, positives, told)
    order = [F.col("p_score").desc(), F.col("p_id"), F.col("p_mark")]
    pairs = cut_lineage(best_per_key(offers, ["mark"], order, n_positives))
    asked = pairs.groupBy("mark").agg(
        F.first("vec_id").alias("vec_id"), F.first("label").alias("label"), F.first("v").alias("v"), F.collect_list("p_score").alias("scores"), F.collect_list("p_mark").alias("p_marks"), F.collect_list("p_id").alias("p_ids")
    )  # n_positives a list
    ended = ["mark", "anchor_id", "p_mark", "positive_id", "positive_score", "negative_id", "n_mark", "negative_score"]

    def negatives(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=ended)
        turns = Rotations(size, bits)
        block, out = Block(right, turns), []
        for mark, key, own, v, scores, marks, ids in left[["mark", "vec_id", "label", "v", "scores", "p_marks", "p_ids"]].itertuples(index=False):
            top = np.asarray(scores, np.int64)
            limits = np.stack([-(-share[0] * top // share[1]), top], axis=1)  # the least is rounded up
            hits = inside(block, own, np.frombuffer(v, "<i4").astype(np.int64), turns, limits, n_negatives)
            for p, p_id, p_score, (at, s) in zip(marks, ids, scores, hits, strict=True):
                out += [(mark, key, p, p_id, p_score, *n) for n in zip(block.vec_id[at], block.mark[at], s, strict=True)]
        return pd.DataFrame(out, columns=ended)

    shape = ", ".join(f"{c} long" for c in ended)
    hits = meet(asked, rows, blocks, negatives, shape)
    order = [F.col("negative_score").desc(), F.col("negative_id"), F.col("n_mark")]
    ranked = best_per_key(hits, ["mark", "p_mark"], order, n_negatives, rank="rank")
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
