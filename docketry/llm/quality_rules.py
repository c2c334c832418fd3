"""Quality rules as a short-circuit cascade.

Each rule is timed and its rejections counted on a bounded sample; the cascade then runs the
rules in falling order of rejections per second, and a document that one rule rejects is not
looked at by later ones. The verdict does not depend on the order, so reruns agree though
timings differ.

Null texts count as empty, and an empty text fails `too_short`. Repeated rows are judged each
by itself, extra columns pass through, an empty table gives an empty result. Columns named
like the outputs are replaced.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from docketry.llm import words as W
from docketry.llm.frames import col, fresh

SAMPLE_ROWS = 500  # texts on which costs and rejections are estimated; steers the order only
WINDOW = 8
MIN_WORDS = 20

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_LEAD = (np.arange(256) & 0xC0) != 0x80
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_ASCII_LETTER = _UPPER | ((np.arange(256) >= 97) & (np.arange(256) <= 122))
_LETTER = _ASCII_LETTER | (np.arange(256) >= 128)
_INK = ~W._SPACE


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of `flags` in each range `at[d]:at[d + 1]`."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


@dataclass
class Texts:
    """A block of texts; each measure is worked out when a rule first asks for it."""

    data: np.ndarray
    at: np.ndarray

    def take(self, rows: np.ndarray) -> Texts:
        parts = [self.data[self.at[r] : self.at[r + 1]] for r in rows]
        size = np.array([len(p) for p in parts], np.int64)
        return Texts(np.concatenate(parts or [self.data[:0]]), np.concatenate([[0], np.cumsum(size)]))

    @cached_property
    def words(self) -> W.Words:
        return W.find_words(self.data, self.at)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.words.first)

    @cached_property
    def word_chars(self) -> np.ndarray:
        return _sums((_LEAD & _INK)[self.data], self.at)

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return _sums(_SYMBOL[self.data], self.at)

    @cached_property
    def n_upper(self) -> np.ndarray:
        return _sums(_UPPER[self.data], self.at)

    @cached_property
    def n_letters(self) -> np.ndarray:
        return _sums(_ASCII_LETTER[self.data], self.at)

    @cached_property
    def n_worded(self) -> np.ndarray:
        """Words that hold a letter."""
        w = self.words
        total = np.concatenate([[0], np.cumsum(_LETTER[self.data], dtype=np.int64)])
        return _sums(total[w.ends] > total[w.starts], w.first)

    @cached_property
    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines with a word, and distinct ones, of each text."""
        if not len(self.data):
            return np.zeros(len(self.at) - 1, np.int64), np.zeros(len(self.at) - 1, np.int64)
        breaks = np.flatnonzero(self.data == 10)
        starts = np.unique(np.concatenate([self.at[:-1], breaks + 1]))
        starts = starts[starts < len(self.data)]
        ends = np.minimum(np.append(starts[1:], len(self.data)), len(self.data))
        ends = np.where((ends > starts) & (self.data[ends - 1] == 10), ends - 1, ends)
        ink = np.concatenate([[0], np.cumsum(_INK[self.data], dtype=np.int64)])
        keep = ink[ends] > ink[starts]
        starts, ends = starts[keep], ends[keep]
        doc = np.searchsorted(self.at, starts, "right") - 1
        key = W.hash_ranges(self.data, starts, ends)
        order = np.lexsort((key, doc))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (doc[order][1:] != doc[order][:-1])
        n = len(self.at) - 1
        return np.bincount(doc, minlength=n), np.bincount(doc[order][new], minlength=n)

    @cached_property
    def n_lines(self) -> np.ndarray:
        return self._lines[0]

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        return self._lines[0] - self._lines[1]

    @cached_property
    def hashes(self) -> np.ndarray:
        return W.word_hashes(self.data, self.words)

    @cached_property
    def n_stutter(self) -> np.ndarray:
        """Words equal to the one before."""
        same = np.zeros(len(self.hashes), bool)
        same[1:] = self.hashes[1:] == self.hashes[:-1]
        heads = self.words.first[:-1]
        same[heads[heads < len(same)]] = False
        return _sums(same, self.words.first)

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        """Words in windows that the same text holds twice or more."""
        w = self.words
        places, count = W.gram_places(w, WINDOW)
        grams = W.gram_hashes(self.hashes, WINDOW)
        if not len(places):
            return np.zeros(len(self.at) - 1, np.int64)
        doc = np.repeat(np.arange(len(count), dtype=np.uint64), count)
        key = W.mix(grams[places] + (doc + np.uint64(1)) * W._M1)
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:]] = same
        twice[order[:-1]] |= same
        cover = np.zeros(len(w.starts) + 1, np.int64)
        cover[places[twice]] += 1
        cover[places[twice] + WINDOW] -= 1
        return _sums(np.cumsum(cover[:-1]) > 0, w.first)


@dataclass
class Rule:
    name: str
    rejects: Callable[[Texts], np.ndarray]


#: Fractions are whole-number comparisons, so that SQL gives the same verdicts.
TOO_SHORT = Rule("too_short", lambda t: t.n_words < MIN_WORDS)
REPEATED = Rule("repeated", lambda t: 100 * t.n_repeat_words > 30 * t.n_words)
RULES = [
    TOO_SHORT,
    REPEATED,
    Rule("symbols", lambda t: 100 * t.n_symbols > 20 * t.n_words),
    Rule("duplicate_lines", lambda t: 100 * t.n_dup_lines > 60 * t.n_lines),
    Rule("stuttering", lambda t: 100 * t.n_stutter > 30 * t.n_words),
    Rule("short_words", lambda t: t.word_chars < 2 * t.n_words),
    Rule("long_words", lambda t: t.word_chars > 15 * t.n_words),
    Rule("shouting", lambda t: 100 * t.n_upper > 60 * t.n_letters),
    Rule("few_letters", lambda t: 100 * t.n_worded < 60 * t.n_words),
]

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass
class Cascade:
    """Rules in running order, with what the sample said of each: (name, seconds, rejections)."""

    rules: list[Rule]
    estimates: list[tuple[str, float, int]] = field(default_factory=list)

    def rejected(self, texts: Texts) -> np.ndarray:
        n = len(texts.at) - 1
        out, rows, rest = np.zeros(n, bool), np.arange(n), texts
        for rule in self.rules:
            if not len(rows):
                break
            bad = rule.rejects(rest)
            out[rows[bad]] = True
            if bad.any():
                left = np.flatnonzero(~bad)
                rows, rest = rows[left], rest.take(left)
        return out


def plan_cascade(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> Cascade:
    """Order the rules by rejections per second over `sample_rows` texts (the first that Spark
    hands over; their choice steers only the order)."""
    rules = RULES if rules is None else rules
    sample = pa.array([r[0] for r in docs.select(col(text)).limit(sample_rows).collect()], pa.string())
    seconds, hits = dict.fromkeys([r.name for r in rules], 0.0), dict.fromkeys([r.name for r in rules], 0)
    for block in W.blocks(sample):
        for rule in rules:
            fresh = Texts(block.data, block.at)  # what a rule needs is part of its cost
            start = time.perf_counter()
            hits[rule.name] += int(rule.rejects(fresh).sum())
            seconds[rule.name] += time.perf_counter() - start
    gain = {r.name: hits[r.name] / (seconds[r.name] + 1e-9) for r in rules}
    order = sorted(rules, key=lambda r: (-gain[r.name], r.name))
    return Cascade(order, [(r.name, seconds[r.name], hits[r.name]) for r in order])


def apply_cascade(docs: DataFrame, cascade: Cascade, text: str = "text", kept: str = "kept", measures: list[str] = (), base: list[Rule] | None = None) -> DataFrame:
    """Every row of `docs` with `kept`: no rule rejects its text.

    `measures` adds counts of the whole text as columns. `base` adds `base_failed`: one of
    these rules rejects; the cascade then looks only at the other texts.
    """
    added = [*measures, *(["base_failed"] if base is not None else []), kept]
    names = [c for c in docs.columns if c not in added]
    flags = [StructField(c, BooleanType()) for c in added if c in ("base_failed", kept)]
    numbers = [StructField(c, LongType()) for c in measures]
    source = docs.select(*[col(c) for c in names])
    schema = StructType([source.schema[c] for c in names] + numbers + flags)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list[np.ndarray]] = {c: [] for c in added}
            for block in W.blocks(batch.column(names.index(text))):
                texts = Texts(block.data, block.at)
                for m in measures:
                    found[m].append(getattr(texts, m).astype(np.int64))
                bad = np.zeros(len(block.at) - 1, bool)
                if base is not None:
                    for rule in base:
                        bad |= rule.rejects(texts)
                    found["base_failed"].append(bad)
                rest = np.flatnonzero(~bad)
                verdict = bad.copy()
                verdict[rest] = cascade.rejected(texts if len(rest) == len(bad) else texts.take(rest))
                found[kept].append(~verdict)
            columns = [pa.array(np.concatenate(found[c])) if found[c] else pa.array([], pa.int64() if c in measures else pa.bool_()) for c in added]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*names, *added])

    return source.mapInArrow(judge, schema)


def keep_good(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """The rows of `docs` that pass every rule, with their columns."""
    mark = fresh(docs, "kept")
    return apply_cascade(docs, plan_cascade(docs, text, rules), text, kept=mark).where(col(mark)).drop(mark)
