"""Removal of passages that an earlier document holds, by suffix automata of reference shards.

A window is `window` consecutive words of one document; a word goes if a window over it also
starts in a document with a smaller id. Windows are judged on the input.

The reference is the whole corpus, so its automaton cannot be sent to every task. Windows are
therefore routed by content. In each window the `GRAM` words with the smallest hash are its
anchor; neighbouring windows with one anchor form a segment, and equal windows have equal anchors,
so a shard of anchors holds everything its windows can match:

1. Every document announces its segments to the shard of their anchors, as hashes. A segment that
   an earlier document holds word for word is matched over its whole length. Segments that share
   an anchor but differ (a passage begins or ends inside them) are called in.
2. For each shard the called-in segments, each once and from its first document, are the reference:
   their suffix automaton is built in document order, so a state knows the first document of its
   strings. The segments are then streamed through it for matching statistics.
3. Each document joins its matches into maximal spans and drops their words.

Documents of one block that share a segment announce it once. An anchor that a large share of the
documents hold in different surroundings (the words of a common line) would be one shard's work;
such anchors are found first, and their windows are routed each by its own words. Words and
segments are compared by 64-bit hashes.

Null and empty texts have no words. A null id is neither smaller nor larger than any: such a row
is kept whole and removes nothing. Rows with one id count as one document. Extra columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm import words as W
from docketry.llm.frames import col
from docketry.session import cut_lineage

WINDOW = 13
GRAM = 6
SHARD_BYTES = 24 << 20  # text per shard of anchors; bounds what one task holds
HOT_SHARE = 0.005  # of the documents; at most (segments per document) / HOT_SHARE anchors are hot
HOT_LEAST = 500


class SuffixAutomaton:
    """Suffix automaton of several strings, added in rising order of their documents.

    `first[state]` is the first document that holds the state's strings.
    """

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.first = [0]

    def _state(self, length: int, first: int, step: dict[int, int], link: int) -> int:
        self.next.append(step)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.next) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of the longest string that ends at p followed by c; cloned if it must be."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.first[q], dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, string: list[int], document: int) -> None:
        last = 0
        for c in string:
            if c in self.next[last]:
                last = self._split(last, c)
                continue
            new = self._state(self.length[last] + 1, document, {}, 0)
            p, last = last, new
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, c)

    def matches(self, string: list[int], width: int) -> list[int]:
        """Per position, the first document of the `width` items that end there (-1: none)."""
        out, state, size = [], 0, 0
        for c in string:
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if c in self.next[state]:
                state, size = self.next[state][c], size + 1
            while size > width and self.length[self.link[state]] >= width:
                state = self.link[state]
                size = self.length[state]
            out.append(self.first[state] if size >= width else -1)
        return out


class Segments:
    """Segments of a block of texts: text, first and last window (word index), anchor word, key."""

    def __init__(self, block: W.Block, window: int, hot: np.ndarray | None = None):
        self.words = W.find_words(block.data, block.at)
        self.hashes = W.word_hashes(block.data, self.words)
        places, count = W.gram_places(self.words, window)
        if not len(places):
            self.text = self.low = self.high = self.anchor = np.zeros(0, np.int64)
            self.key = self.shard = np.zeros(0, np.uint64)
            return
        gram = min(GRAM, window)
        grams = W.gram_hashes(self.hashes, gram)
        best = grams[: len(self.hashes) - window + 1].copy()
        where = np.zeros(len(best), np.int64)
        for k in range(1, window - gram + 1):
            rival = grams[k : k + len(best)]
            better = rival < best
            best = np.where(better, rival, best)
            where[better] = k
        anchor = places + where[places]
        text = np.repeat(np.arange(len(count)), count)
        new = np.ones(len(places), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(places)) - 1
        alone = np.zeros(len(heads), bool)
        if hot is not None and len(hot):  # windows of hot anchors stand alone
            own = grams[anchor[heads]]
            alone = hot[np.minimum(np.searchsorted(hot, own), len(hot) - 1)] == own
            n = np.where(alone, tails - heads + 1, 1)
            first, alone = np.cumsum(n) - n, np.repeat(alone, n)
            step = np.arange(len(alone)) - np.repeat(first, n)
            heads, tails = np.repeat(heads, n) + step, np.repeat(tails, n)
            tails = np.where(alone, heads, tails)
        self.text, self.low, self.high, self.anchor = text[heads], places[heads], places[tails], anchor[heads]
        n = len(self.hashes)
        power = np.full(n + 1, W._M1, np.uint64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        inverse = np.full(n + 1, pow(int(W._M1), -1, 1 << 64), np.uint64)
        inverse[0] = 1
        inverse = np.multiply.accumulate(inverse)
        sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(self.hashes * power[:n])])
        whole = (sums[self.high + window] - sums[self.low]) * inverse[self.low]
        shape = ((self.high - self.low) << 8 | (self.anchor - self.low)).astype(np.uint64)
        self.key = W.mix(whole ^ W.mix(shape + W._M2))
        self.shard = grams[self.anchor]
        self.shard = np.where(alone, self.key, self.shard)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[W.Block, np.ndarray]]:
    ids = batch.column("id").to_numpy(zero_copy_only=False)
    for block in W.blocks(batch.column("text")):
        yield block, ids[block.rows]


def hot_anchors(docs: DataFrame, window: int, share: float = HOT_SHARE, least: int = HOT_LEAST) -> np.ndarray:
    """Anchors in different segments of at least `share` of the documents of some block, and
    `least` in all blocks that report them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids in _blocks(batch):
                seg = Segments(block, window)
                _, once = np.unique(seg.key, return_index=True)
                anchors, n = np.unique(seg.shard[once], return_counts=True)
                many = n >= max(2, share * len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(anchors[many].view(np.int64)), pa.array(n[many])], ["anchor", "n"])

    found = docs.mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.sort(np.array([r["anchor"] for r in found.collect()], np.int64).view(np.uint64))


_ANNOUNCE = "shard int, whole boolean, base long, anchors binary, keys binary, docs binary"
_ANSWER = "id long, key long, open boolean"


def _announce(docs: DataFrame, window: int, shards: int, hot: np.ndarray) -> DataFrame:
    """Per block and shard: anchors (32 bits), segment keys, documents (offsets from `base`)."""
    names = ["shard", "whole", "base", "anchors", "keys", "docs"]

    def pack(shard: np.ndarray, whole: bool, anchors: np.ndarray, keys: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(shard, kind="stable")
        shard, anchors, keys, ids = shard[order], anchors[order], keys[order], ids[order]
        cut = [*np.flatnonzero(np.diff(shard)) + 1, len(shard)] if len(shard) else []
        columns, low = defaultdict(list), 0
        for high in cut:
            base = int(ids[low:high].min())
            rest = ids[low:high] - base
            wide = np.uint64 if rest.max() >> 32 else np.uint32
            names_32 = b"" if whole else anchors[low:high].tobytes()
            row = (int(shard[low]), whole, base, names_32, keys[low:high].tobytes(), rest.astype(wide).tobytes())
            low = high
            for name, value in zip(names, row, strict=True):
                columns[name].append(value)
        types = [pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(columns[n], t) for n, t in zip(names, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids in _blocks(batch):
                seg = Segments(block, window, hot)
                doc = ids[seg.text]
                order = np.lexsort((doc, seg.key))
                key, doc, shard = seg.key[order], doc[order], seg.shard[order]
                head = np.ones(len(key), bool)
                head[1:] = key[1:] != key[:-1]
                least = doc[head][np.cumsum(head) - 1] if len(key) else doc
                later = np.ones(len(key), bool)  # not a repeat inside one document
                later[1:] = head[1:] | (doc[1:] != doc[:-1])
                known = later & (doc > least)
                to = (shard % np.uint64(shards)).astype(np.int32)
                top = (shard >> np.uint64(32)).astype(np.uint32)
                yield pack(to[head], False, top[head], key[head], doc[head])
                yield pack(to[known], True, top[known], key[known], doc[known])

    return docs.mapInArrow(run, _ANNOUNCE)


def _answer(group: pa.Table) -> pa.Table:
    """What a shard tells documents: segments matched over their whole length, and segments called in."""
    parts = defaultdict(list)
    for whole, base, anchors, keys, docs in zip(*(group.column(c).to_pylist() for c in ("whole", "base", "anchors", "keys", "docs")), strict=True):
        key = np.frombuffer(keys, np.uint64)
        rest = np.frombuffer(docs, np.uint64 if len(docs) == len(keys) else np.uint32).astype(np.int64)
        parts[whole, "key"].append(key)
        parts[whole, "doc"].append(rest + base)
        parts[whole, "anchor"].append(np.frombuffer(anchors, np.uint32))

    def column(whole: bool, name: str, kind: type) -> np.ndarray:
        return np.concatenate(parts[whole, name] or [np.zeros(0, kind)])

    key, doc, anchor = column(False, "key", np.uint64), column(False, "doc", np.int64), column(False, "anchor", np.uint32)
    order = np.lexsort((doc, key, anchor))
    key, doc, anchor = key[order], doc[order], anchor[order]
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    least = doc[head][np.cumsum(head) - 1] if len(key) else doc
    known = doc > least
    # Distinct segments of one anchor, each from its first document.
    k, d, a = key[head], doc[head], anchor[head]
    start = np.ones(len(a), bool)
    start[1:] = a[1:] != a[:-1]
    at = np.flatnonzero(start)
    group_no = np.cumsum(start) - 1
    low = np.minimum.reduceat(d, at)[group_no] if len(a) else d
    high = np.maximum.reduceat(d, at)[group_no] if len(a) else d
    called = low < high
    ids = np.concatenate([column(True, "doc", np.int64), doc[known], d[called]])
    keys = np.concatenate([column(True, "key", np.uint64), key[known], k[called]])
    flags = np.zeros(len(ids), bool)
    flags[len(ids) - int(called.sum()) :] = True
    return pa.table({"id": ids, "key": keys.view(np.int64), "open": flags})


def _called_in(docs: DataFrame, window: int, shards: int, hot: np.ndarray) -> DataFrame:
    """The called-in segments of documents (id, text, wanted keys) with their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("wanted")
            for block, ids in _blocks(batch):
                seg = Segments(block, window, hot)
                ask = wanted.slice(block.rows.start, len(ids))
                asked = np.concatenate([[0], np.cumsum(np.array([len(x.as_py()) for x in ask]))])
                keys = ask.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                owner = np.repeat(np.arange(len(ids), dtype=np.uint64), np.diff(asked))
                pick = np.isin(W.mix(seg.key ^ W.mix(seg.text.astype(np.uint64))), W.mix(keys ^ W.mix(owner)))
                at = np.flatnonzero(pick)
                cells = [seg.hashes[seg.low[i] : seg.high[i] + window].tobytes() for i in at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((seg.shard[at] % np.uint64(shards)).astype(np.int32)), pa.array(ids[seg.text[at]]), pa.array(seg.key[at].view(np.int64)), pa.array(cells, pa.binary())],
                    ["shard", "id", "key", "words"],
                )

    return docs.mapInArrow(run, "shard int, id long, key long, words binary")


def _stream(group: pa.Table, window: int) -> pa.Table:
    """Build a shard's automaton and stream its segments: (id, key, from, to) of matched windows."""
    rows = sorted(set(zip(group.column("id").to_pylist(), group.column("key").to_pylist(), group.column("words").to_pylist(), strict=True)))
    strings = [np.frombuffer(w, np.int64).tolist() for _, _, w in rows]
    automaton = SuffixAutomaton()
    for (doc, _, _), string in zip(rows, strings, strict=True):
        automaton.add(string, doc)
    out = []
    for (doc, key, _), string in zip(rows, strings, strict=True):
        first = automaton.matches(string, window)[window - 1 :]
        hit = np.array([0 <= f < doc if f != -1 else False for f in first] + [False])
        if hit.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[False], hit]).astype(np.int8)))
            out += [(doc, key, int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True)]
    columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
    return pa.table({n: pa.array(list(c), t) for n, c, t in zip(("id", "key", "from", "to"), columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)})


def _drop_words(docs: DataFrame, window: int, with_text: bool, hot: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) of documents with their matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids in _blocks(batch):
                seg = Segments(block, window, hot)
                words = seg.words
                given = batch.column("found").slice(block.rows.start, len(block.at) - 1)
                cover = np.zeros(len(words.starts) + 1, np.int64)
                where = np.concatenate([[0], np.cumsum(np.bincount(seg.text, minlength=len(ids)))]) if len(ids) else [0]
                for d, cell in enumerate(given):
                    if not cell.is_valid:
                        continue
                    matched = defaultdict(list)
                    for m in cell.as_py():
                        matched[m["key"]].append((m["from"], m["to"]))
                    for i in range(where[d], where[d + 1]):
                        for a, b in matched.get(int(seg.key[i].view(np.int64)), ()):
                            low = seg.low[i] + a
                            high = (seg.high[i] + 1 if b < 0 else seg.low[i] + b) + window - 1
                            cover[low] += 1
                            cover[high] -= 1
                gone = np.cumsum(cover[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(gone)])
                removed = total[words.first[1:]] - total[words.first[:-1]]
                kept = []
                raw = block.data.tobytes()
                for d in range(len(block.at) - 1):
                    spelled = raw[block.at[d] : block.at[d + 1]].split()
                    if removed[d]:
                        spelled = [w for w, g in zip(spelled, gone[words.first[d] : words.first[d + 1]].tolist(), strict=True) if not g]
                    kept.append(b" ".join(spelled))
                columns = [batch.column("id").slice(block.rows.start, len(kept)), pa.array(np.diff(words.first)), pa.array(removed)]
                columns.append(pa.array([hashlib.sha256(k).hexdigest() for k in kept]))
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    columns.append(pa.array([k.decode() for k in kept], pa.string()))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return docs.mapInArrow(run, schema)


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES, with_text: bool = False,
    hot_share: float = HOT_SHARE, hot_least: int = HOT_LEAST,
) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_removed, kept_sha256, and kept_text if asked for."""
    rows = docs.select(col(doc_id).cast("long").alias("id"), col(text).alias("text"))
    known = rows.where("id IS NOT NULL")
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(64, size // shard_bytes)
    hot = hot_anchors(known, window, hot_share, hot_least)
    answers = cut_lineage(_announce(known, window, shards, hot).groupBy("shard").applyInArrow(_answer, _ANSWER))
    wanted = answers.where("open").groupBy("id").agg(F.collect_list("key").alias("wanted"))
    called = _called_in(known.join(wanted, "id"), window, shards, hot)
    partial = called.groupBy("shard").applyInArrow(lambda g: _stream(g, window), "id long, key long, from int, to int")
    whole = answers.where("NOT open").select("id", "key", F.lit(0).alias("from"), F.lit(-1).alias("to"))
    matches = whole.unionByName(cut_lineage(partial))
    found = matches.groupBy("id").agg(F.collect_list(F.struct("key", "from", "to")).alias("found"))
    return _drop_words(rows.join(found, "id", "left").select("id", "text", "found"), window, with_text, hot)
