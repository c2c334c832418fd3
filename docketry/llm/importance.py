"""Target-distribution importance resampling over hashed word features.

A document's features are its runs of up to `longest` words, lower-cased (A-Z) and joined by one
space; a feature's bucket is the CRC-32 of its bytes modulo `buckets`. Smoothed bucket
frequencies of the target texts against those of all documents give each bucket a gain; a
document's weight is the floored mean gain of its features, and a Gumbel number from a hash of
its id is added, so that the highest scores are a draw without replacement by weight.

The CRCs of a block are computed on its distinct features only. Those of one length lie in a
two-dimensional byte array, whose columns update all registers at once; the buckets are scattered
back to the features. A feature longer than `PIECE` bytes is cut: what exceeds whole pieces goes
first, its pieces are rows of one more array, and the registers are joined piece by piece, since
the register after a piece is the old one advanced by as many zero bytes, plus the piece's own.

Bucket counts are summed in tasks, then over tasks; the driver sees `buckets` numbers a side.
Ranks come from a range sort of (score, id) rows.

Null and empty texts have no features: weight 0, never drawn when `least_words` is 1 or more. Equal
texts score alike but for the number of their id. Rows with one id are ranked each by itself, in
any order among themselves; a null id is hashed as an empty one and comes last in a tie. Texts may
have any length. Empty tables count nothing, and all gains are 0. Extra columns are carried whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.frames import col
from docketry.llm.words import NOT_ALNUM, Words, blocks, distinct_ranges, find_words, gather, gram_places, lower_ascii
from docketry.operators.ordering import dense_index

BUCKETS = 10_000
LEAST_WORDS = 20
SHARE = 10  # per cent of the documents with enough words
SEED = "2024"
PIECE = 64  # bytes; columns of the widest array

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)


def _update(state: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Registers after the bytes of their rows, column by column."""
    for column in rows.T:
        state = _CRC[(state ^ column) & 255] ^ (state >> 8)
    return state


# What each byte of a register becomes after PIECE zero bytes.
_AHEAD = [_update(np.arange(256, dtype=np.uint32) << np.uint32(8 * k), np.zeros((256, PIECE), np.uint8)) for k in range(4)]


def _advance(state: np.ndarray) -> np.ndarray:
    return _AHEAD[0][state & 255] ^ _AHEAD[1][(state >> 8) & 255] ^ _AHEAD[2][(state >> 16) & 255] ^ _AHEAD[3][state >> 24]


def crc32_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of each byte range."""
    state = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    pieces, head = np.divmod(ends - starts, PIECE)
    order = np.argsort(head, kind="stable")
    edge = np.searchsorted(head[order], np.arange(PIECE + 1))
    for length in range(1, PIECE):
        same = order[edge[length] : edge[length + 1]]
        if len(same):
            state[same] = _update(state[same], data[starts[same][:, None] + np.arange(length)])
    cut = np.flatnonzero(pieces)
    if len(cut):
        cut = cut[np.argsort(-pieces[cut], kind="stable")]  # the longest first: those still going are in front
        many = pieces[cut]
        first = np.cumsum(many) - many
        at = np.repeat(starts[cut] + head[cut] - PIECE * first, many) + PIECE * np.arange(many.sum())
        own = _update(np.zeros(len(at), np.uint32), data[at[:, None] + np.arange(PIECE)])
        for step in range(many[0]):
            live = np.searchsorted(-many, -step, "left")
            state[cut[:live]] = _advance(state[cut[:live]]) ^ own[first[:live] + step]
    return ~state


def feature_buckets(low: np.ndarray, words: Words, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every run of `n` words of one text, in order, and how many each text has."""
    spaced, at = gather(np.append(low, np.uint8(32)), words.starts, words.ends + 1)
    spaced = spaced.copy()
    spaced[at[1:] - 1] = 32
    places, count = gram_places(words, n)
    held, offsets, which = distinct_ranges(spaced, at[places], at[places + n] - 1)
    return (crc32_ranges(held, offsets[:-1], offsets[1:]) % np.uint32(buckets)).astype(np.int64)[which], count


def _blocks(column: pa.Array) -> Iterator[tuple[slice, np.ndarray, Words]]:
    for block in blocks(column):
        low = lower_ascii(block.data)
        yield block.rows, low, find_words(low, block.at, NOT_ALNUM)


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = 1) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, low, words in _blocks(batch.column(0)):
                for n in range(1, longest + 1):
                    total += np.bincount(feature_buckets(low, words, n, buckets)[0], minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    parts = texts.select(col(text).alias("text")).mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # `buckets` rows at most
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed target and source frequencies, floored."""
    buckets, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    pairs = zip(source.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets)))) for s, t in pairs], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text: str = "text", longest: int = 1, **carried) -> DataFrame:
    """The `carried` columns with n_words, n_features and weight."""
    buckets, kept = len(gain), list(carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for rows, low, words in _blocks(batch.column("text")):
                size = rows.stop - rows.start
                n_words[rows] = np.diff(words.first)
                total = np.zeros(size, np.int64)
                for n in range(1, longest + 1):
                    which, count = feature_buckets(low, words, n, buckets)
                    sums = np.concatenate([[0], np.cumsum(gain[which])])
                    end = np.cumsum(count)
                    total += sums[end] - sums[end - count]
                    n_features[rows] += count
                weight[rows] = total // np.maximum(n_features[rows], 1)
            numbers = [pa.array(x) for x in (n_words, n_features, weight)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *numbers], [*kept, "n_words", "n_features", "weight"])

    given = docs.select(*[c.alias(name) for name, c in carried.items()], col(text).alias("text"))
    shape = given.drop("text").schema
    for name in ("n_words", "n_features", "weight"):
        shape = shape.add(name, "long")
    return given.mapInArrow(run, shape)


def rank_documents(
    docs: DataFrame,
    target: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    buckets: int = BUCKETS,
    longest: int = 1,
    share: int = SHARE,
    least_words: int = LEAST_WORDS,
    seed: str = SEED,
    carry: bool = False,
) -> DataFrame:
    """Per row of `docs`: doc_id, n_features, weight, score, rank (null: not drawn); with `carry`
    also `row`, all its columns."""
    gain = gains(bucket_counts(docs, text, buckets, longest), bucket_counts(target, target_text, buckets, longest))
    whole = {"row": F.struct(*[col(c) for c in docs.columns])} if carry else {}
    weighed = weigh(docs, gain, text, longest, doc_id=col(doc_id).cast("long"), **whole)
    told = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(told.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = weighed.select("*", (F.col("weight") + gumbel).alias("score"), (F.col("n_words") >= least_words).alias("may"))
    order = [F.col("may").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    placed = dense_index(scored, order, "place")
    drawn = share * placed.agg(F.count_if("may")).first()[0] // 100
    return placed.select(
        "doc_id", "n_features", "weight", "score", F.when(F.col("may") & (F.col("place") <= drawn), F.col("place")).alias("rank"), *whole
    )


def resample(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The drawn rows of `docs`, with all their columns and nothing else."""
    return rank_documents(docs, target, carry=True, **settings).where(F.col("rank").isNotNull()).select("row.*")
