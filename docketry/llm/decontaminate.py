"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared in lower case with runs of white space as one space. An item of m characters
may occur with k = floor(rate * m) edits. It is split into k + 1 pieces; an occurrence leaves at
least one piece untouched, so every piece is searched exactly (all of them at once, by a keyword
automaton). Hits are verified with Myers' bit-parallel distance, first the parts of the item
around the piece with their share of the budget, then the whole item; the first part that fails
ends it.

The items are the query set: they go to the tasks in blocks of a bounded number of characters,
and each block is one pass over the documents, which are never shuffled.

An occurrence of an item of any length must begin and end where no word goes on, so that `rain` is
not found in `training`. Scripts that do not space their words have such a border at every
character. The distance is the least over such occurrences: Myers' bit vectors run forward for
the ends, and backward from each end on a border for the starts.

Null and empty texts match nothing, and neither do items without a text. Items that share an id
(or have none) count as one, with the smaller distance; `drop_contaminated` reads no ids.
Repeated rows are judged each by itself. Extra columns pass through `drop_contaminated`.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.frames import col

RATE = 0.1
BLOCK_CHARS = 1 << 20  # of items that one pass looks for

# Thai to Burmese, Khmer, kana, bopomofo and Chinese characters: written without spaces.
UNSPACED = re.compile("[\u0e00-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u312f\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(length: int, k: int) -> list[tuple[int, int]]:
    """k + 1 ranges that cover `length` characters, alike in size."""
    cut = [length * i // (k + 1) for i in range(k + 2)]
    return list(zip(cut, cut[1:], strict=False))


def letter_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        masks[c] |= 1 << i
    return dict(masks)


def best_match(masks: dict[str, int], m: int, text: str, most: int) -> tuple[int, int]:
    """(distance, end) of the best occurrence in `text`, by Myers' bit vectors; distance is
    over `most` if there is none within it."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = most + 1, -1
    for at, c in enumerate(text):
        same = masks.get(c, 0)
        diag = (((same & up) + up) ^ up) | same | down
        more = down | (full & ~(diag | up))
        less = diag & up
        if more & high:
            score += 1
        elif less & high:
            score -= 1
        more <<= 1
        up = (less << 1) | (full & ~(diag | more))
        up &= full
        down = more & diag & full
        if score < best:
            best, end = score, at + 1
    return best, end


def border(text: str, at: int) -> bool:
    """No word of `text` goes on across position `at`."""
    return not (0 < at < len(text) and all(c.isalnum() and not UNSPACED.match(c) for c in text[at - 1 : at + 1]))


def _ends(masks: dict[str, int], m: int, text: str, anchored: bool) -> Iterator[int]:
    """Myers' distance after each character: of the best part that ends there, or, if `anchored`, of
    all the text up to there."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    for c in text:
        same = masks.get(c, 0)
        diag = (((same & up) + up) ^ up) | same | down
        more = down | (full & ~(diag | up))
        less = diag & up
        if more & high:
            score += 1
        elif less & high:
            score -= 1
        more = (more << 1) | anchored
        up = ((less << 1) | (full & ~(diag | more))) & full
        down = more & diag & full
        yield score


def bordered_match(ahead: dict[str, int], back: dict[str, int], m: int, text: str, start: int, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best occurrence on word borders that begins within `most` of `start`.
    `ahead` and `back` are the masks of the item and of its reverse."""
    low, high = max(0, start - most), min(len(text), start + m + 2 * most)
    ends = [(score, end) for end, score in enumerate(_ends(ahead, m, text[low:high], False), low + 1) if score <= most and border(text, end)]
    best = None
    for score, end in sorted(ends):
        if best and score >= best[0]:
            break
        before = text[max(low, end - m - most) : end][::-1]
        for size, distance in enumerate(_ends(back, m, before, True), 1):
            if distance <= most and (best is None or (distance, end) < best) and end - size <= start + most and border(text, end - size):
                best = (distance, end)
    return best


def _paths(item: str, k: int) -> list[tuple[int, int, list[tuple[int, int, int, dict[str, int]]]]]:
    """Per piece (low, high, path): the parts of `item` around it, smallest first, as (low, high,
    budget, masks).

    A part of e + 1 pieces and budget e is halved into parts whose budgets add up to e - 1. If it
    occurs within its budget, one half occurs within its own; so some piece is untouched and
    every part around it is within budget.
    """
    cut = pieces(len(item), k)
    paths: list[list] = [[] for _ in cut]

    def halve(first: int, last: int) -> None:
        if last - first == 1:
            return
        low, high = cut[first][0], cut[last - 1][1]
        part = (low, high, last - first - 1, letter_masks(item[low:high]))
        middle = (first + last) // 2
        halve(first, middle)
        halve(middle, last)
        for path in paths[first:last]:
            path.append(part)

    halve(0, len(cut))
    return [(low, high, path) for (low, high), path in zip(cut, paths, strict=True)]


class Matcher:
    """A block of items ready to be searched."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float):
        import ahocorasick

        self.items = [(i, int(rate * len(t)), len(t), letter_masks(t), letter_masks(t[::-1])) for i, t in items]
        found: dict[str, list] = defaultdict(list)
        for n, (_, t) in enumerate(items):
            for low, high, path in _paths(t, self.items[n][1]):
                found[t[low:high]].append((n, low, path))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def search(self, text: str) -> dict[int | None, tuple[int, int]]:
        """item id -> (distance, end) of the items that occur in the normal text."""
        out: dict[int | None, tuple[int, int]] = {}
        known: dict[int, list[int]] = defaultdict(list)  # where an item was found, by its start
        for last, (size, places) in self.automaton.iter(text):
            for n, offset, path in places:
                key, k, m, ahead, back = self.items[n]
                start = last + 1 - size - offset
                if any(abs(start - s) <= k for s in known.get(n, ())):
                    continue
                for low, high, most, masks in path:
                    if best_match(masks, high - low, text[max(0, start + low - most) : start + high + most], most)[0] > most:
                        break
                else:
                    found = bordered_match(ahead, back, m, text, start, k)
                    if found is None:
                        continue
                    known[n].append(start)
                    if key not in out or found[0] < out[key][0]:
                        out[key] = found
        return out


def item_blocks(items: DataFrame, item_id: str | None, text: str, block_chars: int) -> Iterator[list[tuple[int | None, str]]]:
    """The distinct items in blocks, in the order of their ids; with no `item_id`, all without one."""
    key = F.lit(None) if item_id is None else col(item_id)
    rows = items.select(key.cast("long").alias("id"), col(text).alias("text")).distinct()
    block: list[tuple[int | None, str]] = []
    size = 0
    for row in rows.orderBy("id", "text").toLocalIterator():
        passage = normal(row["text"])
        if not passage:
            continue
        if block and size + len(passage) > block_chars:
            yield block
            block, size = [], 0
        block.append((row["id"], passage))
        size += len(passage)
    if block:
        yield block


def contaminated(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    rate: float = RATE, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """doc_id, item_id, distance, match_end (characters of the normal text) of all hits."""
    rows = docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).alias("text"))
    schema = "doc_id long, item_id long, distance long, match_end long"
    out = None
    for block in item_blocks(items, item_id, item_text, block_chars):

        def find(batches: Iterator[pa.RecordBatch], block: list = block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, rate)
            for batch in batches:
                hits = [
                    (key, item, *hit)
                    for key, value in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True)
                    for item, hit in matcher.search(normal(value.as_py())).items()
                ]
                columns = zip(*hits, strict=True) if hits else [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["doc_id", "item_id", "distance", "match_end"])

        part = rows.mapInArrow(find, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], schema)
    # An id that is in several blocks keeps its best hit.
    best = F.min(F.struct("distance", "match_end")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.distance", "b.match_end")


def drop_contaminated(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    rate: float = RATE, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The rows of `docs` whose text holds no item; nothing is shuffled. `item_id` is not read."""
    out, place = docs, docs.columns.index(text)
    for block in item_blocks(items, None, item_text, block_chars):

        def keep(batches: Iterator[pa.RecordBatch], block: list = block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, rate)
            for batch in batches:
                clean = [not matcher.search(normal(v.as_py())) for v in batch.column(place)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(keep, docs.schema)
    return out
