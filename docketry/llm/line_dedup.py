"""Near-duplicate lines by a deletion-neighbourhood join, in DataFrame functions only.

Two lines are near if one edit (a character changed, added or removed) makes them equal. Every
line emits the hashes of its variants with one character deleted: lines with the same variant
and position differ by a change there, and a line that equals another's variant differs by that
character. A line goes if it or a near line occurs earlier, even where that near line goes too;
the kept line named beside it is then the end of the chain: from each line to its earliest near
line, until one that stays.

A line of n characters has n variants, so first its halves, then its sixteenths are tried, and
sixteenths of those down to `WIDTH` characters: two near lines agree on all but one part. Only
lines that share such a frame with another go on, and they delete characters in that part alone.
Nothing is lost by it. In a run of one character only the last is deleted, since all give the
same variant. So a long line is hashed whole some 16 times a level, not once per character. No
pairs are made inside a group: a member is only joined to the group's earliest, and that pair is
compared before and after the edit.

Lines are parts between line feeds; lines without a word are always kept. Lines under `min_chars`
characters have no near lines, only equal ones. Occurrences are ordered by document id (null
first), then line number. Null and empty texts have no lines to remove. Rows with one id count
as one document. Extra columns pass through `drop_lines`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.frames import col, packed
from docketry.session import cut_lineage

MIN_CHARS = 20
PARTS = 16
WIDTH = 32


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(col(doc_id).cast("long").alias("d"), F.posexplode(F.split(col(text), "\n", -1)).alias("l", "line"))
    return rows.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def _cut(m: Column, part: Column | int, parts: int) -> Column:
    return F.floor(m.cast("long") * part / parts).cast("int")


def _moves(line: Column, n: Column, m: Column, part: Column, parts: int) -> Column:
    """Whether a part holds an edit to try: a change, or the deletion of a run's last character."""
    low = _cut(m, part, parts)
    size = _cut(m, part + 1, parts) - low + 1
    return (m == n) | (F.substring(line, low + 1, size) != F.substring(line, low + 2, size))


def _frame(line: Column, n: Column, m: Column, part: Column, parts: int) -> Column:
    """Hash of a line without one of its parts, cut as a line of m characters would be."""
    low, high = _cut(m, part, parts), _cut(m, part + 1, parts)
    rest = m - high
    return F.xxhash64(F.lit(parts), m, part, F.substring(line, F.lit(1), low), F.substring(line, n - rest + 1, rest))


def _shared(keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key more than one row has."""
    twice = keys.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)
    return keys.join(twice, key)


def _roots(keep: DataFrame) -> DataFrame:
    """(id, mate) with every mate followed to a line that stays; each round doubles the steps."""
    while True:
        onward = keep.select(F.col("id").alias("mate"), F.col("mate").alias("next"))
        step = keep.join(onward, "mate", "left").select("id", F.coalesce("next", "mate").alias("mate"), F.col("next").isNotNull().alias("moved"))
        step = cut_lineage(step)
        keep = step.select("id", "mate")
        if step.where("moved").isEmpty():
            return keep


def removed_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, parts: int = PARTS) -> DataFrame:
    """doc_id, line_no (from 0), kept_doc_id, kept_line_no of every line that goes."""
    line, n = F.col("line"), F.length("line")
    told = _lines(docs, doc_id, text).select("d", "l", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), n.alias("n"), "line")
    halves = [_frame(line, F.col("n"), F.col("n") - F.lit(less), F.lit(part), 2).alias(f"f{2 * less + part}") for less in (0, 1) for part in (0, 1)]
    seen = told.select("d", "l", "h1", "h2", "n", *halves)
    alone = seen.groupBy("h1", "h2").agg(
        F.min(F.struct("d", "l")).alias("id"), F.max("n").alias("n"), *[F.max(f"f{k}").alias(f"f{k}") for k in range(4)]
    )
    distinct = cut_lineage(alone)
    # Halves: most lines share neither with any other and are done.
    keys = distinct.where(F.col("n") >= min_chars).select("h1", F.explode(F.array_distinct(F.array(*[f"f{k}" for k in range(4)]))).alias("f"))
    going = _shared(keys, "f").select("h1").distinct()
    found = distinct.where(F.col("n") >= min_chars).select("h1", "id", "n").join(going, "h1")
    by_doc = found.groupBy(F.col("id.d").alias("d")).agg(F.collect_set("id.l").alias("ls"))
    plain = docs.select(col(doc_id).cast("long").alias("_d"), col(text).alias("text"))
    picked = plain.join(by_doc, F.col("_d").eqNullSafe(F.col("d")))
    texts = picked.select("d", F.posexplode(F.split("text", "\n", -1)).alias("l", "line"), "ls").where(F.array_contains("ls", F.col("l")))
    texts = texts.select(F.struct("d", "l").alias("id"), "line", F.length("line").alias("n")).distinct()
    texts = cut_lineage(texts)
    # Sixteenths of those, finer ones of long lines, then the deletion variants inside a shared frame.
    shifts = F.explode(F.sequence(F.lit(0), F.lit(1))).alias("less")
    tried = texts.select("id", "n", "line", shifts).select("id", "n", "line", (F.col("n") - F.col("less")).alias("m"), F.lit(0).alias("part"))
    longest = texts.agg(F.max("n")).first()[0] or 0
    level, step, spots = parts, parts, []
    while True:
        finer = F.explode(F.sequence(F.col("part") * step, F.col("part") * step + (step - 1))).alias("part")
        framed = tried.select("id", "n", "line", "m", finer).where(_moves(line, F.col("n"), F.col("m"), F.col("part"), level))
        keys = framed.select("id", "m", "part", _frame(line, F.col("n"), F.col("m"), F.col("part"), level).alias("frame"))
        near = cut_lineage(_shared(keys, "frame").select("id", "m", "part")).join(texts, "id")
        low, high = _cut(F.col("m"), F.col("part"), level), _cut(F.col("m"), F.col("part") + 1, level)
        last = high + (F.col("n") - F.col("m")) - 1
        narrow = near.where(F.col("m") <= WIDTH * level)
        spots.append(narrow.where(last >= low).select("id", "m", "n", "line", F.explode(F.sequence(low, last)).alias("i")))
        if longest <= WIDTH * level:
            break
        tried = near.where(F.col("m") > WIDTH * level)
        level, step = level * PARTS, PARTS
    at = reduce(DataFrame.unionByName, spots)
    variant = F.concat(F.substring("line", F.lit(1), F.col("i")), F.substring("line", F.col("i") + 2, F.col("n")))
    changed = at.where("m = n").select("id", F.lit(0).alias("side"), "i", F.xxhash64(F.lit("change"), "i", "n", variant).alias("v"))
    ends = F.substring("line", F.col("i") + 1, F.lit(1)) != F.substring("line", F.col("i") + 2, F.lit(1))
    deleted = at.where("m < n").where(ends).select("id", F.lit(1).alias("side"), "i", F.xxhash64(F.lit("delete"), variant).alias("v"))
    whole = at.where("m = n").select("id", "line").distinct()
    whole = whole.select("id", F.lit(2).alias("side"), F.lit(-1).alias("i"), F.xxhash64(F.lit("delete"), "line").alias("v"))
    rows = cut_lineage(changed.unionByName(deleted).unionByName(whole).distinct())
    earliest = [F.min(F.when(F.col("side") == s, F.struct("id", "i"))).alias(f"m{s}") for s in range(3)]
    first = rows.groupBy("v").agg(F.count("*").alias("k"), *earliest)
    mate = F.when(F.col("side") == 0, F.col("m0")).when(F.col("side") == 1, F.col("m2")).otherwise(F.col("m1"))
    pairs = rows.join(first.where("k > 1"), "v").withColumn("to", mate)
    pairs = pairs.select("id", F.col("to.id").alias("mate"), F.greatest("i", "to.i").alias("i")).where(F.col("mate") < F.col("id")).distinct()
    mates = texts.select(F.col("id").alias("mate"), F.col("line").alias("other"), F.col("n").alias("o"))

    def rest(text: str, size: str) -> Column:  # what follows the edit; the shorter line lacks one character
        skipped = F.when(F.col(size) == F.greatest("n", "o"), 2).otherwise(1)
        return F.substring(text, F.col("i") + skipped, F.col(size))

    same = (F.substring("line", F.lit(1), F.col("i")) == F.substring("other", F.lit(1), F.col("i"))) & (rest("line", "n") == rest("other", "o"))
    close = pairs.join(texts, "id").join(mates, "mate").where(same)
    keep = _roots(cut_lineage(close.groupBy("id").agg(F.min("mate").alias("mate"))))
    fate = distinct.select("h1", "h2", "id").join(keep, "id", "left").select("h1", "h2", "id", "mate")
    here = F.struct("d", "l")
    all_lines = told.select("d", "l", "h1", "h2").join(fate, ["h1", "h2"])
    kept = F.when(~here.eqNullSafe(F.col("id")), F.coalesce("mate", "id")).otherwise(F.col("mate"))
    out = all_lines.select("d", "l", kept.alias("kept")).where("kept IS NOT NULL")
    return out.select(F.col("d").alias("doc_id"), F.col("l").alias("line_no"), F.col("kept.d").alias("kept_doc_id"), F.col("kept.l").alias("kept_line_no"))


def drop_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`docs` with the removed lines taken out of their texts."""
    gone = removed_lines(docs, doc_id, text, **options).groupBy(F.col("doc_id").alias("_d")).agg(F.collect_set("line_no").alias("_gone"))
    marked = packed(docs, d=col(doc_id).cast("long"), text=text).join(gone, F.col("d").eqNullSafe(F.col("_d")), "left")
    numbered = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    left = F.filter(numbered, lambda p: ~F.array_contains("_gone", p["i"]))
    cleaned = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda p: p["x"]), "\n"))
    return marked.select(*[(cleaned if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns])
