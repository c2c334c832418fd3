"""Records of delimited text files whose cells may hold line ends, read in splits.

A split begins at a line, but the line may lie inside a quoted cell that an earlier split opened. Each
split is therefore given as a rule on two states, outside or inside a cell: where it ends if it
begins outside, and where if it begins inside, each with the text that ends a record open at its
beginning. One pass makes the rules. There are few, and composed along a file they tell every split's
first state and the text that ends the record open at its end. A second pass then puts records together
while it reads: the text is neither shuffled nor written for it.

A quote opens a cell only at its beginning, so a stray quote in a bare cell changes nothing: every
quote either turns the state, or leaves it outside whatever it was. That is computed for a batch of
lines at once, from the places of quotes and line feeds.

UTF-16 files are split at the bytes of a line feed. Those two bytes also occur across two
characters, which leaves pieces of odd length. How many of these a split has, counted first, says
whether the next one begins inside a character; the lines that were cut are whole again in the bytes
of a batch.
"""

from __future__ import annotations

import csv
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from docketry.functions.barrier import with_once
from docketry.session import cut_lineage

HEAD = 1 << 20  # bytes of a split's first lines that the first pass keeps, for either state
RULES = "split long, ends boolean, ends_in boolean, starts boolean, starts_in boolean, head binary, head_in binary"
RECORDS = "file string, block long, seq long, value binary"
# What is taken from a UTF-16 line: a byte order mark before it, a carriage return after it.
LINE_MARKS = re.compile("(?:(?<=\n)|\\A)\ufeff|\r(?=[\r\u0085\u2028\u2029]?(?:\n|\\Z))")


class Units(NamedTuple):
    """How a charset's text is seen in numpy, and the bytes of its line feed."""

    charset: str
    kind: str
    width: int
    feed: bytes

    def view(self, stream: bytes, cut: int) -> np.ndarray:
        """The whole characters of a stream whose first `cut` bytes end a character begun before."""
        return np.frombuffer(stream, self.kind, (len(stream) - cut) // self.width, cut)

    def utf8(self, text: bytes) -> bytes:
        if self.width == 1:
            return text
        out = text.decode(self.charset)
        return (LINE_MARKS.sub("", out) if "\r" in out or "\ufeff" in out else out).encode()


UNITS = {
    "UTF-8": Units("UTF-8", "u1", 1, b"\n"),
    "UTF-16LE": Units("UTF-16LE", "<u2", 2, b"\n\0"),
    "UTF-16BE": Units("UTF-16BE", ">u2", 2, b"\0\n"),
}


class Place(NamedTuple):
    """What the second pass knows of a split: `cut` bytes at its beginning end a character, `inside` is its
    first state, and `tail` is the text in later splits that ends its last record."""

    file: str
    block: int
    first: bool
    cut: int
    inside: bool
    tail: bytes


def _lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(file, block, split, value): lines with the split they are in; `split` stands for file and block.

    Splits of small files follow from the number of cores, so that is fixed here: every pass must
    see the same splits, also when executors come or go."""
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        cores = spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or spark.sparkContext.defaultParallelism
        spark.conf.set("spark.sql.files.minPartitionNum", str(cores))
    file, block = F.input_file_name(), F.input_file_block_start()
    split = F.xxhash64(file, block)  # of the functions, as a `_metadata` column would be copied for each line
    return spark.read.options(**options).text(path).select(file.alias("file"), block.alias("block"), split.alias("split"), F.col("value").cast("binary").alias("value"))


def _states(units: np.ndarray, fresh: bool, sep: str) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """The places of line feeds, and whether a cell is open at each of them and at the end: if the text
    begins outside a cell, and if inside. `fresh`: it begins with a line.

    Doubled quotes are escaped ones, or an empty cell, and change no state."""
    feeds, quotes = np.flatnonzero(units == ord("\n")), np.flatnonzero(units == ord('"'))
    first = np.flatnonzero(np.diff(quotes, prepend=-2) != 1)
    if len(first) < len(quotes):
        quotes = quotes[first[np.diff(first, append=len(quotes)) % 2 == 1]]  # one for each run of odd length
    before = units[quotes - 1]
    opens = (before == ord("\n")) | (before == ord(sep))
    if units.dtype.itemsize == 2 and (marks := quotes[before == 0xFEFF]).size:  # a byte order mark is no part of its line
        opens[before == 0xFEFF] = np.where(marks > 1, units[marks - 2] == ord("\n"), fresh)
    if len(quotes) and quotes[0] == 0:
        opens[0] = fresh
    past = np.append(np.searchsorted(quotes, feeds), len(quotes))  # quotes before each
    if opens[::2].all():  # they open and close by turns
        out = past % 2 == 1
    else:
        turns = np.cumsum(opens)
        last = np.maximum.accumulate(np.where(opens, -1, np.arange(len(quotes))))  # the last quote that opens nothing
        out = np.append(False, (turns - np.where(last >= 0, turns[last], 0)) % 2 == 1)[past]
    steady = np.flatnonzero(~opens)[:1]  # from there on both are the same
    return feeds, (out, out ^ (past <= (steady[0] if len(steady) else len(quotes))))


def _streams(batches: Iterator[pa.RecordBatch], feed: bytes) -> Iterator[tuple[int, bytes]]:
    """(split, the bytes of its next lines, each with its line feed)."""
    glue = pa.scalar(feed, pa.binary())
    for batch in batches:
        split, value = batch.column("split").to_numpy(), batch.column("value")
        cuts = [0, *(np.flatnonzero(split[1:] != split[:-1]) + 1), len(split)]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if high > low:
                lines = pa.ListArray.from_arrays(pa.array([0, high - low], pa.int32()), value.slice(low, high - low))
                yield int(split[low]), pc.binary_join(lines, glue)[0].as_py() + feed


class _Rule:
    """One split's rule as it grows: lists are by its first state, outside or inside."""

    def __init__(self, split: int, cut: int, most: int | None, first: bool):
        self.split, self.cut, self.most = split, cut, most
        self.state, self.starts, self.head = [False, True], [False, False], [[], []]
        # Outside, and at a line, a record begins with the split. The first record of a file is kept as a head.
        self.found = [cut == 0 and not first, False]

    def add(self, stream: bytes, units: Units, sep: str) -> None:
        feeds, states = _states(units.view(stream, self.cut), self.cut == 0, sep)
        for was in (0, 1):
            inside = states[self.state[was]]
            if self.found[was]:
                self.starts[was] = True
            else:
                ended = feeds[~inside[:-1]][:1]
                stop = self.cut + units.width * (int(ended[0]) + 1) if len(ended) else len(stream)
                if self.head[was] is not None:
                    self.head[was].append(stream[:stop])
                    if self.most is not None and sum(map(len, self.head[was])) > self.most:
                        self.head[was] = None
                self.found[was] = len(ended) > 0
                self.starts[was] = stop < len(stream)
            self.state[was] = bool(inside[-1])
        self.cut = (len(stream) - self.cut) % units.width

    def row(self) -> dict:
        heads = [None if h is None else b"".join(h) for h in self.head]
        return dict(zip(("split", "ends", "ends_in", "starts", "starts_in", "head", "head_in"), (self.split, *self.state, *self.starts, *heads), strict=True))


def _split_rules(cuts: dict[int, tuple[int, bool]], units: Units, sep: str, most: int, only: frozenset[int] = frozenset()) -> Callable:
    """A row per split: by its first state, the last one, whether a record starts in it, and the text
    before that start; NULL if longer than `most` bytes, unless the split is one of `only`. `cuts`: the
    bytes at a split's beginning that end a character, and whether it is the first of its file."""
    kinds = [pa.int64(), *[pa.bool_()] * 4, pa.binary(), pa.binary()]
    schema = pa.schema([(c.split()[0], kind) for c, kind in zip(RULES.split(", "), kinds, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = None
        for split, stream in _streams(batches, units.feed):
            if rule is None or split != rule.split:
                if rule:
                    yield pa.RecordBatch.from_pylist([rule.row()], schema=schema)
                _known(cuts, split)
                rule = _Rule(split, cuts[split][0], None if split in only else most, cuts[split][1])
            rule.add(stream, units, sep)
        if rule:
            yield pa.RecordBatch.from_pylist([rule.row()], schema=schema)

    return run


def _known(places: dict, split: int) -> None:
    if split not in places:
        raise RuntimeError("a split was not one of the first pass; keep spark.sql.files settings between passes")


def _records(places: dict[int, Place], units: Units, sep: str, headers: bool) -> Callable:
    """Lines put together to the records that start in each split, in UTF-8: as `RECORDS`, or without each
    file's first one and as values alone."""

    def cut(text: bytes, ends: np.ndarray) -> pa.Array:
        """The records of a text; `ends`: which of its line feeds end one."""
        data = np.frombuffer(units.utf8(text), "u1")
        ends = np.flatnonzero(data == ord("\n"))[ends]
        kept = np.ones(len(data), bool)
        kept[ends] = False
        offsets = np.append(0, ends - np.arange(len(ends))).astype("i4")
        return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data[kept])])

    def rows(place: Place, seq: int, values: pa.Array) -> pa.RecordBatch:
        if not headers:
            return pa.RecordBatch.from_arrays([values[1:] if place.first and seq == 0 else values], names=["value"])
        n = len(values)
        columns = [pa.repeat(pa.scalar(place.file), n), pa.repeat(pa.scalar(place.block, pa.int64()), n), pa.array(np.arange(seq, seq + n)), values]
        return pa.RecordBatch.from_arrays(columns, names=["file", "block", "seq", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, place, held = None, None, []
        for split, stream in _streams(batches, units.feed):
            if split != at:
                if any(held):
                    yield rows(place, seq, cut(b"".join([*held, place.tail]), np.array([-1])))
                _known(places, split)
                at, place, held, seq = split, places[split], [], 0
                skipped, state = place.cut or place.inside, place.inside  # the end of an earlier split's record comes first
                broken, inner = place.cut, 0  # `inner`: line feeds in what is held
            feeds, states = _states(units.view(stream, broken), broken == 0, sep)
            inside = states[state]
            state, ends = bool(inside[-1]), np.flatnonzero(~inside[:-1])
            stops = broken + units.width * (feeds[ends] + 1)
            broken = (len(stream) - broken) % units.width
            low, done = 0, 0  # bytes and line feeds passed
            if skipped:
                if len(ends) == 0:
                    continue
                skipped, low, done, ends, stops = False, stops[0], ends[0] + 1, ends[1:], stops[1:]
            if len(ends):
                values = cut(b"".join([*held, stream[low : stops[-1]]]), ends - done + inner)
                yield rows(place, seq, values)
                seq += len(values)
                held, inner, low, done = [], 0, stops[-1], ends[-1] + 1
            held.append(stream[low:])
            inner += len(feeds) - done
        if any(held):
            yield rows(place, seq, cut(b"".join([*held, place.tail]), np.array([-1])))

    return run


def _file_cuts(splits: list[Row], units: Units) -> dict[int, tuple[int, bool]]:
    """Per split, given by file and block in order: the bytes that end a character, and whether it is a file's first."""
    out = {}
    for file, rows in groupby(splits, lambda r: r.file):
        cut, first = 0, True
        for r in rows:
            if r.split in out:
                raise RuntimeError(f"{file} has a split that is told by the same number as another")
            out[r.split] = (cut, first)
            cut, first = (cut + r.odd) % units.width, False
        if cut:
            raise ValueError(f"{file} ends inside a character")
    return out


def scanned(spark: SparkSession, path: str, sep: str, charset: str) -> tuple[DataFrame, dict[int, Place], str | None]:
    """(lines, what the second pass must know of each split, the first file's first record)."""
    units = UNITS[charset]
    lines = _lines(spark, path, **({} if units.width == 1 else {"encoding": charset, "lineSep": "\n"}))
    odd = F.bit_xor(F.octet_length("value") % 2) if units.width == 2 else F.lit(0)
    splits = lines.groupBy("file", "block", "split").agg(odd.alias("odd")).collect()  # a row per split
    splits.sort(key=lambda r: (r.file, r.block))
    cuts = _file_cuts(splits, units)
    texts = lines.select("split", "value")
    rules = cut_lineage(texts.mapInArrow(_split_rules(cuts, units, sep, HEAD), RULES))
    rule = {r.split: r for r in rules.drop("head", "head_in").collect()}

    # A record that a split leaves open ends in the heads of the splits up to the next that has a start.
    inside, owner = {}, {}
    for r in splits:
        cut, first = cuts[r.split]
        state = False if first else ends
        if cut or state:
            owner[r.split] = last
        if not cut and not state or (rule[r.split].starts_in if state else rule[r.split].starts):
            last = r.split
        inside[r.split], ends = state, rule[r.split].ends_in if state else rule[r.split].ends
    asked = [r.split for r in splits[:1]] + list(owner)
    heads = _heads(rules, {s: inside[s] for s in asked})
    if long := frozenset(s for s, head in heads.items() if head is None):
        again = cut_lineage(texts.mapInArrow(_split_rules(cuts, units, sep, -1, long), RULES))
        heads |= _heads(again, {s: inside[s] for s in long})
    tails = {s: b"".join(heads[o] for o in owned) for s, owned in groupby(owner, owner.get)}
    places = {r.split: Place(r.file, r.block, cuts[r.split][1], cuts[r.split][0], inside[r.split], tails.get(r.split, b"")) for r in splits}
    if not splits:
        return texts, places, None
    start = splits[0].split
    header = heads[start] if rule[start].starts else heads[start] + places[start].tail
    return texts, places, units.utf8(header).decode(errors="replace").removesuffix("\n")


def _heads(rules: DataFrame, states: dict[int, bool]) -> dict[int, bytes | None]:
    """Heads of the given splits, by the state each begins in."""
    head = F.when(F.col("split").isin([s for s, inside in states.items() if inside]), F.col("head_in")).otherwise(F.col("head"))
    asked = rules.where(F.col("split").isin(list(states)))
    return {r.split: None if r.head is None else bytes(r.head) for r in asked.select("split", head.alias("head")).collect()}


def quote_rules(line: Column, sep: str) -> tuple[Column, Column]:
    """Whether a line ends inside a quoted cell, if it begins outside one and if inside.

    Doubled quotes are escaped ones, or an empty cell, and change no state."""
    cut = "\\t" if sep == "\t" else f"\\Q{sep}\\E"
    bare = F.replace(line, F.lit('""'), F.lit(""))

    def opens(text: Column) -> Column:
        return F.regexp_replace(text, f'(^|{cut})"[^"]*"', "$1_").rlike(f'(^|{cut})"')

    closing = F.instr(bare, '"')
    rest = F.concat(F.lit("_"), F.substring(bare, closing + 1, F.length(bare)))
    return opens(bare), F.when(closing == 0, True).otherwise(opens(rest))


def header_names(record: str, sep: str) -> list[str]:
    """Column names of a header record: empty ones by place, repeated ones with their place."""
    cells = next(csv.reader([record], delimiter=sep), [])
    many = Counter(c.lower() for c in cells)
    return [f"_c{i}" if not c else f"{c}{i}" if many[c.lower()] > 1 else c for i, c in enumerate(cells)]


def records_of(spark: SparkSession, path: str, sep: str, charset: str = "UTF-8") -> DataFrame:
    """(file, block, seq, value): the records of the files under `path`, header records included, each
    with the split it starts in and its number there. `sep` is one character, in ASCII."""
    lines, places, _ = scanned(spark, path, sep, charset)
    records = lines.mapInArrow(_records(places, UNITS[charset], sep, True), RECORDS)
    return records.withColumn("value", F.col("value").cast("string"))


def read_delimited(spark: SparkSession, path: str, sep: str, charset: str = "UTF-8") -> DataFrame:
    """All cells of the files under `path` as text, one row per record; each file has the same
    header. Line ends inside cells come out as line feeds. An empty file has no records. Each action on
    the rows reads the files again; cut their lineage where many do."""
    lines, places, header = scanned(spark, path, sep, charset)
    names = ["_c0"] if header is None else header_names(header, sep)
    body = lines.mapInArrow(_records(places, UNITS[charset], sep, False), "value binary").select(F.col("value").cast("string").alias("value"))
    cells = ", ".join(f"c{i} STRING" for i in range(len(names)))
    # A record is parsed by itself, so no character may end it.
    how = {"sep": sep, "escape": '"', "quote": '"', "lineSep": "\0"}
    # Parsed once, not once for every cell that a filter above asks for.
    return with_once(body, "r", F.from_csv("value", cells, how)).select("r.*").toDF(*names)
