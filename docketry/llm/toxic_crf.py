"""Toxicity by a linear-chain conditional random field over tokens.

Token labels come from document labels: over a bounded sample of labelled documents, features of
tokens (the word, its first and last bytes, hashed to 2^18) are counted by documents that have
them, toxic and not. A feature whose share of toxic documents is surely high (Wilson bound) marks its
tokens; in toxic documents marked tokens are labelled toxic, all others plain. Near copies in the
sample count once (one smallest shingle hash), so that a copied text's own words mark nothing.

On two thirds of the sample a chain of two states is fitted: emission weights per feature and
state changes, by gradients that tasks add up over whole documents. On the last third a logistic
function from three sums over a document's forward-backward marginals (expected toxic tokens, the
surest token, their share) to its label is fitted. Every document is then scored by it, and runs
of tokens whose marginal is a half or more are its offending spans, in code points.

The chains of a block of texts are one long chain: at the first token of a text the step matrix
has equal rows, which forgets what was before. The long chain is folded into rows of equal length,
and all rows advance side by side, so a single very long text costs no more than many short ones.

Only the sample, a bounded number of documents, is used to fit; every document is scored
whole. Null and empty texts have no tokens and get the score that the function gives for none. Repeated
rows are scored each by itself. Labels of one id are merged, toxic if any row is; null ids
and null labels are not learned from. Without toxic or without plain labels the score is the
share of toxic ones (0.5 without any). Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.frames import col
from docketry.llm.words import NOT_ALNUM, Words, blocks, distinct_ranges, find_words, gram_hashes, gram_places, hash_ranges, lower_ascii, mix
from docketry.session import cut_lineage

SAMPLE = 12_000  # labelled documents that all fitting uses
ROUNDS = 20  # gradient steps
WIDTH = 18  # log2 of the number of feature weights
HEADS, TAILS = (3, 4, 5, 6, 7, 8), (3, 4, 5)  # bytes of a word's first and last parts
SURE = 0.45  # share of toxic documents that a marking feature has at least, with certainty Z
Z = 2.0
ROW = 512  # tokens of a row of the folded chain
SPAN = 0.5  # marginal from which a token belongs to a span
THRESHOLD = 0.7


@dataclass
class Chain:
    """Weights: per feature (the last is unused: absent features), per state change, per first state."""

    emit: np.ndarray = field(default_factory=lambda: np.zeros((1 << WIDTH) + 1))
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))


@dataclass
class Tokens:
    """Tokens of a block: `kind` numbers distinct words, `features` are theirs."""

    rows: slice
    data: np.ndarray
    at: np.ndarray
    words: Words
    kind: np.ndarray
    features: np.ndarray


def word_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashed features of words side by side: (words, 1 + heads + tails)."""
    starts, ends = offsets[:-1], offsets[1:]
    out = np.empty((len(starts), 1 + len(HEADS) + len(TAILS)), np.int64)
    parts = [(starts, ends, ends >= starts)]
    parts += [(starts, np.minimum(starts + k, ends), ends - starts > k) for k in HEADS]
    parts += [(np.maximum(ends - k, starts), ends, ends - starts > k) for k in TAILS]
    for i, (a, b, there) in enumerate(parts):
        hashed = mix(hash_ranges(data, a, b) + np.uint64(i)) >> np.uint64(64 - WIDTH)
        out[:, i] = np.where(there, hashed.astype(np.int64), 1 << WIDTH)
    return out


def token_blocks(column: pa.Array) -> Iterator[Tokens]:
    for block in blocks(column):
        words = find_words(lower_ascii(block.data), block.at, NOT_ALNUM)
        held, offsets, kind = distinct_ranges(block.data, words.starts, words.ends)
        strings = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(held)])
        lower = pc.utf8_lower(strings)
        _, where, chars = lower.buffers()
        offsets = np.frombuffer(where, np.int64)[: len(lower) + 1] if len(lower) else np.zeros(1, np.int64)
        held = np.frombuffer(chars, np.uint8) if chars is not None else np.zeros(0, np.uint8)
        yield Tokens(block.rows, block.data, block.at, words, kind, word_features(held, offsets))


def steps(scores: np.ndarray, first: np.ndarray, chain: Chain) -> np.ndarray:
    """The step matrices (4, tokens): from state i to j at 2 i + j, a text's first token from either."""
    odds = np.exp(np.clip(scores, -30, 30))
    a, s = np.exp(chain.step), np.exp(chain.start)
    m = np.empty((4, len(scores)))
    for i in range(2):
        m[2 * i] = a[i, 0]
        m[2 * i + 1] = a[i, 1] * odds
        m[2 * i, first] = s[0]
        m[2 * i + 1, first] = s[1] * odds[first]
    return m


def marginals(m: np.ndarray, length: int = ROW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per token: forward and backward messages (2, tokens), scaled, and the probability of state 1."""
    n = m.shape[1]
    rows = -(-n // length)
    grid = np.zeros((4, rows * length))
    grid[0], grid[3] = 1.0, 1.0  # the fill changes nothing
    grid[:, :n] = m
    grid = np.ascontiguousarray(grid.reshape(4, rows, length).transpose(0, 2, 1))  # (4, place, row)
    p = np.zeros((4, rows))
    p[0], p[3] = 1.0, 1.0
    for g in grid.swapaxes(0, 1):  # each row's product
        p = np.stack([p[0] * g[0] + p[1] * g[2], p[0] * g[1] + p[1] * g[3], p[2] * g[0] + p[3] * g[2], p[2] * g[1] + p[3] * g[3]])
        p /= p.sum(axis=0)
    into, out = np.full((2, rows), 0.5), np.full((2, rows), 0.5)
    for r in range(1, rows):
        x, y = into[:, r - 1]
        u, v = x * p[0, r - 1] + y * p[2, r - 1], x * p[1, r - 1] + y * p[3, r - 1]
        into[:, r] = u / (u + v), v / (u + v)
    for r in range(rows - 2, -1, -1):
        x, y = out[:, r + 1]
        u, v = p[0, r + 1] * x + p[1, r + 1] * y, p[2, r + 1] * x + p[3, r + 1] * y
        out[:, r] = u / (u + v), v / (u + v)
    ahead, back = np.empty((2, length, rows)), np.empty((2, length, rows))
    x, y = into
    for i in range(length):
        g = grid[:, i]
        u, v = x * g[0] + y * g[2], x * g[1] + y * g[3]
        x, y = u / (u + v), v / (u + v)
        ahead[:, i] = x, y
    x, y = out
    for i in range(length - 1, -1, -1):
        back[:, i] = x, y
        g = grid[:, i]
        u, v = g[0] * x + g[1] * y, g[2] * x + g[3] * y
        x, y = u / (u + v), v / (u + v)
    ahead, back = (a.transpose(0, 2, 1).reshape(2, -1)[:, :n] for a in (ahead, back))
    both = ahead * back
    return ahead, back, both[1] / both.sum(axis=0)


def firsts(words: Words) -> np.ndarray:
    """The first token of every text that has any."""
    return words.first[:-1][np.diff(words.first) > 0]


def tag(tokens: Tokens, chain: Chain) -> np.ndarray:
    scores = chain.emit[tokens.features].sum(axis=1)[tokens.kind]
    return marginals(steps(scores, firsts(tokens.words), chain))[2] if len(scores) else np.zeros(0)


def gradient(tokens: Tokens, labels: np.ndarray, chain: Chain) -> Chain:
    """Expected less labelled counts of every feature, state change and first state."""
    first = firsts(tokens.words)
    m = steps(chain.emit[tokens.features].sum(axis=1)[tokens.kind], first, chain)
    ahead, back, p = marginals(m)
    per_word = np.bincount(tokens.kind, p - labels, len(tokens.features))
    emit = np.bincount(tokens.features.ravel(), np.repeat(per_word, tokens.features.shape[1]), (1 << WIDTH) + 1)
    emit[-1] = 0
    inner = np.ones(len(p), bool)
    inner[first] = False
    later = np.flatnonzero(inner)
    pairs = np.stack([ahead[i, later - 1] * m[2 * i + j, later] * back[j, later] for i in range(2) for j in range(2)])
    expected = (pairs / pairs.sum(axis=0)).sum(axis=1)
    seen = np.bincount(2 * labels[later - 1] + labels[later], minlength=4)
    start = np.array([(1 - p[first]).sum() - (labels[first] == 0).sum(), p[first].sum() - (labels[first] == 1).sum()])
    return Chain(emit, (expected - seen).reshape(2, 2), start)


def held_out(doc_id: Column) -> Column:
    """Ids whose labels are not learned: crc32 of the id as text is 1 modulo 3; null ids too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, sample: int) -> DataFrame:
    """(text, toxic, part) of `sample` labelled documents chosen by a hash of the id, near copies once."""
    told = labels.where(col(label).isNotNull()).groupBy(col(doc_id).cast("long").alias("doc_id")).agg(F.max(col(label).cast("int")).alias("toxic"))
    known = docs.select(col(doc_id).cast("long").alias("doc_id")).distinct().join(told, "doc_id").where(~held_out(F.col("doc_id")))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(13)), "doc_id").limit(sample)
    texts = docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).alias("text")).join(F.broadcast(chosen), "doc_id")  # `sample` ids

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = np.zeros(batch.num_rows, np.uint64)
            for block in blocks(batch.column("text")):
                words = find_words(lower_ascii(block.data), block.at)
                h = hash_ranges(block.data, words.starts, words.ends)
                n = min(5, max(1, int(np.diff(words.first).max(initial=0))))
                for k in (1, n):  # texts under n words are judged by their words
                    places, count = gram_places(words, k)
                    there = np.flatnonzero(count)
                    if len(there):
                        least[np.arange(block.rows.start, block.rows.stop)[there]] = np.minimum.reduceat(gram_hashes(h, k)[places], (np.cumsum(count) - count)[there])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "text", "toxic")], pa.array(least.view(np.int64))], ["doc_id", "text", "toxic", "sign"])

    signed = texts.mapInArrow(sign, "doc_id long, text string, toxic int, sign long")
    one = signed.groupBy("sign").agg(F.min_by(F.struct("doc_id", "text", "toxic"), F.struct("doc_id", F.xxhash64("text"))).alias("d"))
    return one.select("d.text", "d.toxic", F.pmod(F.xxhash64("d.doc_id", F.lit(31)), F.lit(3)).cast("int").alias("part"))


def _added(parts: DataFrame, size: int) -> np.ndarray:
    """Sums by index of what the tasks found; at most `size` rows reach the driver."""
    out = np.zeros(size)
    rows = parts.groupBy("i").agg(F.sum("x").alias("x")).toArrow()
    out[rows.column("i").to_numpy()] = rows.column("x").to_numpy()
    return out


def _sparse(x: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(x)
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(x[at])], ["i", "x"])


def marking_features(sample: DataFrame) -> np.ndarray:
    """Which features mark toxic tokens (absent features do not)."""
    size = (1 << WIDTH) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * size)
        for batch in batches:
            toxic = batch.column("toxic").to_numpy()
            for t in token_blocks(batch.column("text")):
                kinds = max(len(t.features), 1)
                doc, kind = np.divmod(np.unique(t.words.doc * kinds + t.kind), kinds)
                pairs = np.unique((doc[:, None] * size + t.features[kind]).ravel()) if len(doc) else np.zeros(0, np.int64)
                total += np.bincount(pairs % size + size * toxic[t.rows][pairs // size], minlength=2 * size)
        yield _sparse(total)

    plain, toxic = _added(sample.select("text", "toxic").mapInArrow(count, "i long, x double"), 2 * size).reshape(2, -1)
    n = np.maximum(plain + toxic, 1)
    share = toxic / n
    least = (share + Z * Z / (2 * n) - Z * np.sqrt(share * (1 - share) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)
    marks = least >= SURE
    marks[-1] = False
    return marks


def fit_chain(sample: DataFrame, marks: np.ndarray, rounds: int = ROUNDS) -> Chain:
    """Weights after `rounds` steps (Adam) along the summed gradients."""
    size = (1 << WIDTH) + 1
    chain = Chain()
    chain.step[:, 1] = chain.start[1] = -4.0
    values = np.concatenate([chain.emit, chain.step.ravel(), chain.start])
    mean, spread = np.zeros_like(values), np.zeros_like(values)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 6)
        for batch in batches:
            toxic = batch.column("toxic").to_numpy()
            for t in token_blocks(batch.column("text")):
                if not len(t.kind):
                    continue
                labels = marks[t.features].any(axis=1)[t.kind] & (toxic[t.rows][t.words.doc] > 0)
                g = gradient(t, labels.astype(np.int64), chain)
                total += np.concatenate([g.emit, g.step.ravel(), g.start])
        yield _sparse(total)

    for turn in range(1, rounds + 1):
        slope = _added(sample.select("text", "toxic").mapInArrow(added, "i long, x double"), size + 6) + 0.05 * values * (values != 0)
        mean = 0.8 * mean + 0.2 * slope
        spread = 0.95 * spread + 0.05 * slope**2
        values = values - 0.6 * (mean / (1 - 0.8**turn)) / (np.sqrt(spread / (1 - 0.95**turn)) + 1e-6)
        chain = Chain(values[:size], values[size : size + 4].reshape(2, 2), values[size + 4 :])
    return chain


def sums(p: np.ndarray, words: Words) -> np.ndarray:
    """Per text: 1, log(1 + expected toxic tokens), the surest token, their share of the tokens."""
    n = np.diff(words.first)
    total = np.concatenate([[0.0], np.cumsum(p)])
    expected = np.maximum(total[words.first[1:]] - total[words.first[:-1]], 0)
    top = np.zeros(len(n))
    if len(p):
        top[n > 0] = np.maximum.reduceat(p, words.first[:-1][n > 0])
    return np.stack([np.ones(len(n)), np.log1p(expected), top, 20 * expected / np.maximum(n, 1)], axis=1)


def fit_scores(sample: DataFrame, chain: Chain) -> np.ndarray:
    """Logistic weights of `sums`, by Newton steps over one row of sums per sampled document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.concatenate([sums(tag(t, chain), t.words) for t in token_blocks(batch.column("text"))])
            yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in x.T], batch.column("toxic")], ["a", "b", "c", "d", "toxic"])

    rows = sample.select("text", "toxic").mapInArrow(run, "a double, b double, c double, d double, toxic int").toArrow()
    x = np.stack([rows.column(c).to_numpy() for c in "abcd"], axis=1)
    y = rows.column("toxic").to_numpy()
    w = np.zeros(4)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        w[0] = math.log(share / (1 - share))
        return w
    ridge = np.diag([1e-3, 0.1, 0.1, 0.1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge
        move = np.linalg.solve(hess, x.T @ (y - p) - ridge @ w)
        w += move * min(1.0, 4.0 / max(np.abs(move).max(), 1e-9))
    return w


def spans(p: np.ndarray, t: Tokens) -> list[str]:
    """Per text, start:end of the runs of toxic tokens, in code points, comma-joined."""
    out = [""] * (len(t.at) - 1)
    bad = p >= SPAN
    if not bad.any():
        return out
    doc = t.words.doc
    joined = bad[1:] & bad[:-1] & (doc[1:] == doc[:-1])
    begins = np.flatnonzero(bad & ~np.concatenate([[False], joined]))
    stops = np.flatnonzero(bad & ~np.concatenate([joined, [False]]))
    points = np.concatenate([[0], np.cumsum((t.data & 0xC0) != 0x80)])
    base = points[t.at[doc[begins]]]
    for d, a, b in zip(doc[begins].tolist(), (points[t.words.starts[begins]] - base).tolist(), (points[t.words.ends[stops]] - base).tolist(), strict=True):
        out[d] += f"{',' if out[d] else ''}{a}:{b}"
    return out


@dataclass
class Model:
    chain: Chain
    weights: np.ndarray


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    """A chain and document weights from the labels of ids that are not held out."""
    tasks = max(2, docs.sparkSession.sparkContext.defaultParallelism)
    rows = cut_lineage(labelled_sample(docs, labels, doc_id, text, label, sample).repartition(2 * tasks))
    learn, check = rows.where("part < 2"), rows.where("part = 2")
    chain = fit_chain(learn, marking_features(learn), rounds)
    return Model(chain, fit_scores(check, chain))


def score_documents(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row of `docs`: doc_id, held_out, score, predicted, n_toxic (expected tokens), spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, expected, told = np.zeros(batch.num_rows), np.zeros(batch.num_rows), []
            for t in token_blocks(batch.column("text")):
                p = tag(t, model.chain)
                x = sums(p, t.words)
                score[t.rows] = 1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30)))
                expected[t.rows] = np.expm1(x[:, 1])
                told += spans(p, t)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array(expected), pa.array(told, pa.string())], ["doc_id", "score", "n_toxic", "spans"])

    given = docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).alias("text"))
    scored = given.mapInArrow(run, "doc_id long, score double, n_toxic double, spans string")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_toxic", "spans")
