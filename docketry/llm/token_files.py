"""Token ids in files: frequency-ranked, byte-aligned variable-length coding.

Ids are replaced by their rank in the corpus, most frequent first (ties: smaller id), so common
ids take one byte. A rank takes 1 to 4 little-endian bytes; its length less one sits in two bits
of a separate control byte, four ranks to a byte, first rank in the low bits. Reading looks up a
control byte in a table of its four lengths and gathers the bytes, all in numpy.

The files are a Parquet table of blocks in ascending document order, with the rank table beside
it. A block holds whole documents: their ids and token counts, control bytes, data bytes.
Spark's writer commits it, so a lost task leaves nothing behind and any store will do.

Texts are encoded once. Byte-level BPE never merges across the start of ` word`, so a text is cut
there and each distinct piece is encoded once per worker; the result is that of the whole text.
Where the tokenizer splits by its byte-level pattern, a text is also cut between ASCII letters,
digits, punctuation and single line ends, where that pattern splits whatever stands around.
With `added_tokens` the strings of the tokenizer's added tokens stand for their ids, as in its
plain call; otherwise they are ordinary text.

Null and empty texts have only the end id. Documents are ordered by id, nulls first, then text
hash; repeated rows are repeated documents. Extra columns are not read. An empty table gives
empty files.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.llm import words as W
from docketry.llm.frames import col
from docketry.session import cut_lineage

END_ID = 0
BLOCK_TOKENS = 1 << 20
BLOCK_BYTES = 8 << 20  # text that a worker encodes at a time
CACHE_PIECES = 400_000  # pieces a worker remembers; others are encoded again
CACHE_CHARS = 64
JOINED = 100  # pieces that the tokenizer is given as one text

_GRAPHIC = (np.arange(256) > 0x20) & (np.arange(256) < 0x7F)
_TWO = (np.arange(256) >= 0xC3) & (np.arange(256) <= 0xDF)  # leads of two-byte letters; no white space among them
_LETTER = np.isin(np.arange(256), [*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"])
_DIGIT = np.isin(np.arange(256), [*b"0123456789"])
_BREAK = (np.arange(256) >= 9) & (np.arange(256) <= 13)
_POINT = _GRAPHIC & ~_LETTER & ~_DIGIT
# Kinds of a byte: 1 letter, 2 digit, 3 punctuation, 4 apostrophe, which may begin 's, 't and the like, 5 line end or tab.
_KIND = bytes(4 if chr(c) == "'" else _LETTER[c] + 2 * _DIGIT[c] + 3 * _POINT[c] + 5 * _BREAK[c] for c in range(256))
# Between these kinds the byte-level pattern splits, whatever stands around; a pair is 8 x first + second.
_APART = bytes((c >> 3, c & 7) in {*[(1, k) for k in (2, 3, 4, 5)], *[(2, k) for k in (1, 3, 4, 5)], (3, 1), (3, 2), (3, 5), (4, 5)} for c in range(256))
_LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


class Encoder:
    """A tokenizer file with remembered pieces; one per worker."""

    _held: dict[tuple[str, bool], Encoder] = {}

    def __init__(self, path: str, added_tokens: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added_tokens
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.spelled = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, number in vocabulary.items():
            self.spelled[number] = len(token)
        told = json.loads(self.tokenizer.to_str())
        before = told["pre_tokenizer"] or {}
        self.added = [x["content"].encode() for x in told["added_tokens"]]
        self.fine = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not told["normalizer"]
        # An added token that looks at its neighbours, or holds a space, may show up where pieces meet.
        self.alone = any(" " in x["content"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in told["added_tokens"])
        self.place = pa.array([], pa.large_string())
        self.ids, self.at, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    @classmethod
    def of(cls, path: str, added_tokens: bool = False) -> Encoder:
        if (path, added_tokens) not in cls._held:
            cls._held[path, added_tokens] = cls(path, added_tokens)
        return cls._held[path, added_tokens]

    def _starts(self, block: W.Block) -> np.ndarray:
        """Where the pieces of a block start."""
        data, at = block.data, block.at
        mark = np.zeros(len(data), bool)
        if self.fine and len(data) > 2:
            raw = data.tobytes()
            kind = np.frombuffer(raw.translate(_KIND), np.uint8)
            pair = kind[:-1] * np.uint8(8) + kind[1:]
            mark[1:] = np.frombuffer(pair.tobytes().translate(_APART), bool)
            # A single line end is a piece; in a longer run of white space the last one is split off.
            lone = np.flatnonzero(kind[1:-1] == 5) + 1
            mark[lone[_GRAPHIC[data[lone - 1]] & _GRAPHIC[data[lone + 1]]] + 1] = True
            for token in self.added:
                low = raw.find(token)
                while low >= 0:
                    mark[low : low + len(token) + 1] = False
                    low = raw.find(token, low + 1)
        space = np.flatnonzero(data == 32)
        space = space[(space > 1) & (space < len(data) - 1)]
        before, after = data[space - 1], data[space + 1]
        mark[space[(_GRAPHIC[before] | _TWO[data[space - 2]]) & (_GRAPHIC[after] | _TWO[after])]] = True
        mark[at[:-1][at[:-1] < at[1:]]] = True
        return np.flatnonzero(mark)

    def _join(self, pieces: pa.Array) -> tuple[np.ndarray, int]:
        """An order of the pieces, and how many of its first ones may stand side by side in a text:
        it would be cut where they meet."""
        if self.alone:
            return np.arange(len(pieces)), 0
        data, at = _bytes(pieces)
        size = np.diff(at)
        long = np.flatnonzero(size > 2)
        low, high = at[:-1][long], at[1:][long]
        fits = (data[low] == 32) & (_GRAPHIC[data[low + 1]] | _TWO[data[low + 1]]) & (_GRAPHIC[data[high - 1]] | _TWO[data[high - 2]])
        alone = np.ones(len(pieces), bool)
        alone[long[fits]] = False
        return np.argsort(alone, kind="stable"), int(fits.sum())

    def _encode(self, pieces: pa.Array, side_by_side: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and how many each has."""
        if not len(pieces):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        data, at = _bytes(pieces)
        texts = _strings(data, np.concatenate([at[:side_by_side:JOINED], at[side_by_side:]])).to_pylist()
        (got,) = self.tokenizer.encode_batch_fast([texts], is_pretokenized=True, add_special_tokens=False)
        ids = np.array(got.ids, np.uint32)
        # The fast call does not say whose an id is. Byte-level tokens spell their bytes, so pieces end
        # where the bytes of ids and pieces add up alike.
        ends, upto = np.cumsum(self.spelled[ids]), at[1:] - at[0]
        last = np.searchsorted(ends, upto)
        if len(ids) and last[-1] == len(ids) - 1 and np.array_equal(ends[last], upto):
            return ids, np.diff(last, prepend=-1)
        slow = self.tokenizer.encode(pieces.to_pylist(), is_pretokenized=True, add_special_tokens=False)
        return np.array(slow.ids, np.uint32), np.bincount(np.array(slow.word_ids, np.int64), minlength=len(pieces))

    def _remember(self, pieces: pa.Array, ids: np.ndarray, size: np.ndarray, first: np.ndarray) -> None:
        """Keep the short pieces among the new ones, while there is room."""
        free = CACHE_PIECES - len(self.place)
        if free <= 0:
            return
        short = np.flatnonzero(pc.utf8_length(pieces).to_numpy() <= CACHE_CHARS)[:free]
        n = size[short]
        at = np.cumsum(n) - n
        held = ids[np.repeat(first[short] - at, n) + np.arange(int(n.sum()))]
        self.place = pa.concat_arrays([self.place, pieces.take(pa.array(short))])
        self.at = np.concatenate([self.at, len(self.ids) + at])
        self.ids = np.concatenate([self.ids, held])
        self.size = np.concatenate([self.size, n])

    def encode(self, block: W.Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block's texts in a row, and how many each text has."""
        data, at = block.data, block.at
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(at) - 1, np.int64)
        starts = self._starts(block)
        coded = _strings(data, np.append(starts, len(data))).dictionary_encode()
        names, which = coded.dictionary, coded.indices.to_numpy()
        where = pc.fill_null(pc.index_in(names, value_set=self.place), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(where < 0)
        order, side_by_side = self._join(names.take(pa.array(new)))
        new = new[order]
        pieces = names.take(pa.array(new))
        ids, size = self._encode(pieces, side_by_side)
        where[new] = len(self.size) + np.arange(len(new))
        # This block's own arrays; only short pieces are kept beyond it.
        first = np.cumsum(size) - size
        all_ids = np.concatenate([self.ids, ids])
        all_size = np.concatenate([self.size, size])
        all_at = np.concatenate([self.at, len(self.ids) + first])
        self._remember(pieces, ids, size, first)
        n = all_size[where][which]
        ends = np.concatenate([[0], np.cumsum(n)])
        out = all_ids[np.repeat(all_at[where][which] - ends[:-1], n) + np.arange(ends[-1])]
        per_text = ends[np.searchsorted(starts, at)]
        return out, np.diff(per_text)


def _strings(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """The bytes between consecutive offsets as strings."""
    return pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def _bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of strings without nulls, and where each starts and the last ends."""
    _, where, chars = strings.buffers()
    at = np.frombuffer(where, np.int64)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, np.int64)
    return np.frombuffer(chars, np.uint8) if chars is not None else np.zeros(0, np.uint8), at


def _slots(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes of each document, and the two-bit slot of each of its ranks."""
    size = -(-n // 4)
    first = np.cumsum(n) - n
    return size, np.repeat((np.cumsum(size) - size) * 4 - first, n) + np.arange(int(n.sum()))


def pack(ranks: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes, data bytes and how many of each every document has (all n are over 0)."""
    r = ranks.astype("<u4")
    length = (1 + (r > 0xFF) + (r > 0xFFFF) + (r > 0xFFFFFF)).astype(np.uint8)
    size, slot = _slots(n)
    codes = np.zeros(int(size.sum()) * 4, np.uint8)
    codes[slot] = length - 1
    control = codes.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    data = r.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) < length[:, None]]
    return control, data, size, np.add.reduceat(length, np.cumsum(n) - n, dtype=np.int64)


def unpack(control: bytes, data: bytes, n: np.ndarray) -> np.ndarray:
    """Ranks of documents of `n` ranks each, one after the other."""
    length = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[_slots(n)[1]]
    raw = np.frombuffer(data, np.uint8)
    at = np.cumsum(length, dtype=np.int64) - length
    out = raw[at].astype(np.uint32)
    for k in range(1, int(length.max(initial=1))):
        longer = np.flatnonzero(length > k)
        out[longer] |= raw[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _cells(data: np.ndarray, size: np.ndarray) -> pa.Array:
    """Consecutive parts of `data` as binary values."""
    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    cells = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])
    return cells.cast(pa.binary())


def encode_texts(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, added_tokens: bool = False) -> DataFrame:
    """id, tie (text hash), n, ids (little-endian 32 bits, or 16 where every id fits)."""
    plain = docs.select(col(doc_id).cast("long").alias("id"), col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer, added_tokens)
        kind = np.dtype("<u2" if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
        for batch in batches:
            for block in W.blocks(batch.column(1), BLOCK_BYTES):
                ids, n = encoder.encode(block)
                full = np.insert(ids, np.cumsum(n), end_id).astype(kind)
                n = n + 1
                width = pa.array(np.full(len(n), kind.itemsize, np.int32))
                rows = batch.slice(block.rows.start, len(n))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(n), width, _cells(full, n * kind.itemsize)], ["id", "tie", "n", "width", "ids"])

    return plain.withColumn("tie", F.xxhash64("text")).mapInArrow(run, "id long, tie long, n long, width int, ids binary")


def _ids(batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray]]:
    """Rows of a batch and all their ids, in parts of bounded size."""
    width, n = batch.column("width").to_numpy(), batch.column("n").to_numpy()
    low = 0
    while low < len(n):
        high = max(low + 1, low + int(np.searchsorted(np.cumsum(n[low:]), BLOCK_TOKENS, "right")))
        raw = b"".join(batch.column("ids").slice(low, high - low).to_pylist())
        yield slice(low, high), np.frombuffer(raw, "<u2" if width[low] == 2 else "<u4")
        low = high


def rank_ids(encoded: DataFrame) -> np.ndarray:
    """All ids that occur, most frequent first. Bounded by the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for _, ids in _ids(batch):
                got = np.bincount(ids)
                if len(got) > len(total):
                    total = np.concatenate([total, np.zeros(len(got) - len(total), np.int64)])
                total[: len(got)] += got
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["token", "n"])

    counts = encoded.select("width", "n", "ids").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = sorted((-r["n"], r["token"]) for r in counts.collect())
    return np.array([t for _, t in rows], np.uint32)


def write_files(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS, added_tokens: bool = False) -> None:
    """Encode `docs` and write `path`/blocks and `path`/ranks."""
    spark = docs.sparkSession
    encoded = cut_lineage(encode_texts(docs, tokenizer, doc_id, text, end_id, added_tokens), compression="zstd")
    by_rank = rank_ids(encoded)
    ranks = pa.table({"rank": pa.array(np.arange(len(by_rank), dtype=np.int64)), "token": pa.array(by_rank.astype(np.int64))})
    spark.createDataFrame(ranks, "rank long, token long").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, ids in _ids(batch):
                part = batch.slice(rows.start, rows.stop - rows.start)
                control, data, n_control, n_data = pack(rank_of[ids], part.column("n").to_numpy())
                cells = [_cells(control, n_control), _cells(data, n_data)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("tie"), part.column("n"), *cells], ["id", "tie", "n", "control", "data"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: list[tuple] = []
        block = start = size = 0

        def close() -> pa.RecordBatch:
            ids, n, control, data = zip(*held, strict=True)
            return pa.RecordBatch.from_pydict(
                {"part": [part], "block": [block], "start": [start], "ids": [list(ids)], "n": [list(n)], "control": [b"".join(control)], "data": [b"".join(data)]},
                schema=pa.schema([("part", pa.int32()), ("block", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())]),
            )

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("id", "n", "control", "data")), strict=True):
                held.append(row)
                size += row[1]
                if size >= block_tokens:
                    yield close()
                    held, block, start, size = [], block + 1, start + size, 0
        if held:
            yield close()

    coded = encoded.mapInArrow(code, "id long, tie long, n long, control binary, data binary")
    ordered = coded.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "n", "control", "data")
    schema = "part int, block long, start long, ids array<long>, n array<long>, control binary, data binary"
    ordered.mapInArrow(gather, schema).write.parquet(f"{path}/blocks")


def read_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens and ids (little-endian 32 bits), or
    their checksum ids_crc32 if `digest`."""
    by_rank = np.array([r["token"] for r in sorted(spark.read.parquet(f"{path}/ranks").collect())], "<u4")
    blocks = spark.read.parquet(f"{path}/blocks")
    sizes = blocks.groupBy("part").agg(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)).alias("size"))
    # One row per written partition.
    before = F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    placed = blocks.join(F.broadcast(offsets), "part").select((F.col("start") + F.col("before")).alias("start"), "ids", "n", "control", "data")
    last, kind = ("ids_crc32", "long") if digest else ("ids", "binary")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                start, docs, n, control, data = (batch.column(c)[row] for c in range(5))
                n = n.values.to_numpy()
                ids = by_rank[unpack(control.as_py(), data.as_py(), n)]
                at = np.concatenate([[0], np.cumsum(n)])
                if digest:
                    told = pa.array([zlib.crc32(ids[a:b]) for a, b in zip(at, at[1:], strict=False)], pa.int64())
                else:
                    told = _cells(ids.view(np.uint8), n * 4)
                yield pa.RecordBatch.from_arrays([docs.values, pa.array(start.as_py() + at[:-1]), pa.array(n), told], ["doc_id", "start", "n_tokens", last])

    return placed.mapInArrow(decode, f"doc_id long, start long, n_tokens long, {last} {kind}")
