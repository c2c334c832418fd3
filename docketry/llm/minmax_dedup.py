"""Near-duplicate detection with min-max hashing.

A text's set is its distinct shingles of `shingle` words, A-Z lower-cased; a text of fewer
words has its whole sequence as the one shingle, a text without words has none and is linked
with nothing. Under each permutation both the minimum and the maximum are kept, so half the
hash evaluations fill a signature whose values agree with probability equal to the Jaccard
similarity. Signatures are banded; texts that share a band are candidates, and every link is
confirmed on the full sets.

Texts with equal sets are one class and enter the bands once. Inside a bucket no pair list is
made: each class is compared with a leader, and linked classes are contracted to components.
Classes that share a bucket but not a component are compared further, first those with one
leader, then those of one bucket: in blocks, inside tasks that pass on links only. A skipped
comparison is always between two texts already connected.

Null and empty texts: no set, kept. A null id: compared with nothing, kept, component null.
Rows with the same id count as one document, so the classes of its texts are linked; a row of it
without a set still names its own id. Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm import words as W
from docketry.llm.components import components
from docketry.llm.frames import col, packed
from docketry.session import cut_lineage

SHINGLE = 5
PERCENT = 80
BANDS = 40
ROWS = 5  # at similarity 0.8 a pair shares none of 40 bands of 5 with probability 1e-7
BLOCK_ROWS = 512
SEED = 20240229


def shingle_sets(data: np.ndarray, at: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted within it, and where each text's begin."""
    data = W.lower_ascii(data)
    words = W.find_words(data, at)
    h = W.word_hashes(data, words)
    n = np.diff(words.first)
    places, count = W.gram_places(words, shingle)
    grams = W.gram_hashes(h, shingle)[places] if len(places) else np.zeros(0, np.uint64)
    for d in np.flatnonzero((n > 0) & (n < shingle)):  # the whole sequence is the one shingle
        whole = W.gram_hashes(h[words.first[d] : words.first[d + 1]], int(n[d]))
        grams = np.insert(grams, count[:d].sum(), whole)
        count[d] = 1
    first = np.concatenate([[0], np.cumsum(count)])
    for d in range(len(count)):
        grams[first[d] : first[d + 1]].sort()
    new = np.ones(len(grams), bool)
    new[1:] = grams[1:] != grams[:-1]
    new[first[:-1][count > 0]] = True
    total = np.concatenate([[0], np.cumsum(new)])
    return grams[new], total[first]


def band_keys(sets: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes (texts x bands) of non-empty sets; column order is fixed by SEED."""
    heads = first[:-1]
    values = []
    rng = np.random.default_rng(SEED)
    for _ in range(-(-bands * rows // 2)):
        a, c = rng.integers(0, 1 << 63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        under = (sets ^ c) * a
        values += [np.minimum.reduceat(under, heads), np.maximum.reduceat(under, heads)]
    out = np.empty((len(heads), bands), np.int64)
    for b in range(bands):
        key = np.full(len(heads), b + 1, np.uint64)
        for v in values[b * rows : (b + 1) * rows]:
            key = W.mix((key ^ v) * W._M1)
        out[:, b] = key.view(np.int64)
    return out


def signatures(docs: DataFrame, doc_id: str, text: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """id, t (hash of the text), n (set size), k1 and k2 (a 128-bit hash of the set), bands (null for an empty set)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in W.blocks(batch.column(1)):
                sets, first = shingle_sets(block.data, block.at, shingle)
                n = np.diff(first)
                full = np.flatnonzero(n)
                k1, k2 = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
                lists = pa.nulls(len(n), pa.list_(pa.int64()))
                if len(full):
                    heads = first[:-1][full]
                    k1[full] = np.add.reduceat(W.mix(sets ^ W._M2), heads).view(np.int64)
                    k2[full] = np.bitwise_xor.reduceat(W.mix(sets ^ W._M3), heads).view(np.int64)
                    keys = band_keys(sets, np.append(heads, len(sets)), bands, rows)
                    where = np.zeros(len(n) + 1, np.int32)
                    where[1:] = np.cumsum(n > 0) * bands
                    lists = pa.ListArray.from_arrays(pa.array(where), pa.array(keys.ravel()), mask=pa.array(n == 0))
                ids, t = (batch.column(c).slice(block.rows.start, len(n)) for c in (0, 2))
                found = [ids, t, pa.array(n.astype(np.int64)), pa.array(k1), pa.array(k2), lists]
                yield pa.RecordBatch.from_arrays(found, ["id", "t", "n", "k1", "k2", "bands"])

    rows_in = docs.select(col(doc_id).cast("long").alias("id"), col(text).alias("text"), F.xxhash64(col(text)).alias("t"))
    return rows_in.mapInArrow(sign, "id long, t long, n long, k1 long, k2 long, bands array<long>")


def _confirm(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets reach the similarity."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            step = 256  # texts of two columns side by side
            for low in range(0, batch.num_rows, step):
                part = batch.slice(low, step)
                sets = []
                for name in ("tu", "tv"):
                    found = []
                    for block in W.blocks(part.column(name)):
                        s, first = shingle_sets(block.data, block.at, shingle)
                        found += [s[first[i] : first[i + 1]] for i in range(len(first) - 1)]
                    sets.append(found)
                for i, (a, b) in enumerate(zip(*sets, strict=True)):
                    both = np.concatenate([a, b])
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    keep[low + i] = 100 * shared >= percent * (len(both) - shared)
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(keep))

    wide = (
        pairs.join(texts.select(F.col("cls").alias("u"), F.col("text").alias("tu")), "u")
        .join(texts.select(F.col("cls").alias("v"), F.col("text").alias("tv")), "v")
        .select("u", "v", "tu", "tv")
    )
    return wide.mapInArrow(check, "u long, v long")


def _blockwise(members: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (u, v) inside each `home` group of members (home, cls, c), across components only.

    A group is cut into blocks of about BLOCK_ROWS; every two blocks meet in one task, which
    compares their sets and passes on, for each text and foreign component, its first link.
    """
    size = members.groupBy("home").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("k"), F.min("c").alias("low"), F.max("c").alias("high"))
    cut = members.join(size.where("low < high").select("home", "k"), "home")
    cut = cut.withColumn("mine", F.pmod(F.xxhash64("cls"), F.col("k")).cast("int"))
    met = cut.select("home", "cls", "c", "mine", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    met = met.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")}).drop("other")
    wide = met.join(texts, "cls")

    def compare(group: pa.Table) -> pa.Table:
        cls, comp, mine = (group.column(x).to_numpy() for x in ("cls", "c", "mine"))
        low, high = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        sets = []
        for block in W.blocks(group.column("text")):
            s, first = shingle_sets(block.data, block.at, shingle)
            sets += [s[first[d] : first[d + 1]] for d in range(len(first) - 1)]
        n = np.array([len(s) for s in sets])
        right = np.flatnonzero(mine == high)
        gram = np.concatenate([sets[r] for r in right] or [np.zeros(0, np.uint64)])
        owner = np.repeat(right, n[right])
        order = np.argsort(gram, kind="stable")
        gram, owner = gram[order], owner[order]
        out = []
        for x in np.flatnonzero(mine == low):
            if not (comp[right] != comp[x]).any():
                continue
            begin, end = np.searchsorted(gram, sets[x], "left"), np.searchsorted(gram, sets[x], "right")
            many = end - begin
            at = np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(many.sum())
            shared = np.bincount(owner[at], minlength=len(cls))
            hit = np.flatnonzero((100 * shared >= percent * (n + n[x] - shared)) & (comp != comp[x]) & (mine == high))
            _, once = np.unique(comp[hit], return_index=True)
            out += [(cls[x], cls[y]) for y in hit[once]]
        return pa.table({"u": pa.array([u for u, _ in out], pa.int64()), "v": pa.array([v for _, v in out], pa.int64())})

    return wide.groupBy("home", "i", "j").applyInArrow(compare, "u long, v long")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """Per row of `docs`: its id (named `doc_id`), n_shingles, component_id, kept."""
    signed = cut_lineage(signatures(docs, doc_id, text, shingle, bands, rows))
    key = ["n", "k1", "k2"]
    full = signed.where("id IS NOT NULL AND n > 0")
    classes = full.groupBy(*key).agg(F.min(F.struct("id", "t")).alias("rep"))
    classes = cut_lineage(classes.withColumn("cls", F.xxhash64(*key)))
    # One row per class in the bands; the representative's own bands are the class's.
    reps = full.join(classes, key).where("id = rep.id AND t = rep.t")
    banded = reps.select("cls", "n", F.explode(F.array_distinct("bands")).alias("b"))
    shared = banded.groupBy("b").agg(F.min("cls").alias("low"), F.max("cls").alias("high"), F.count("*").alias("size"))
    shared = shared.where("low < high").select("b", "size")
    buckets = cut_lineage(banded.join(shared, "b").distinct())
    # A class with many bucket mates is near the middle of its group and leads its buckets.
    weights = buckets.groupBy("cls").agg(F.sum("size").alias("w"))
    wanted = docs.select(col(doc_id).cast("long").alias("id"), F.xxhash64(col(text)).alias("t"), col(text).alias("text"))
    asked = classes.join(weights, "cls").select("cls", "rep.id", "rep.t")
    texts = cut_lineage(wanted.join(asked, ["id", "t"]).select("cls", "text").dropDuplicates(["cls"]))
    buckets = cut_lineage(buckets.drop("size").join(weights, "cls"))

    def near(u: str, v: str) -> Column:  # sets whose sizes differ more cannot reach the similarity
        return 100 * F.least(u, v) >= percent * F.greatest(u, v)

    lead = buckets.groupBy("b").agg(F.max(F.struct("w", F.col("cls").alias("lead"), "n")).alias("l"))
    lead = lead.select("b", "l.lead", F.col("l.w").alias("lw"), F.col("l.n").alias("ln"))
    votes = buckets.join(lead, "b").groupBy("cls", "n", "lead", "ln").agg(F.count("*").alias("k"), F.max("lw").alias("lw"))
    votes = cut_lineage(votes)

    def best(rows: DataFrame) -> DataFrame:
        return rows.groupBy("cls").agg(F.max(F.struct("k", "lw", "lead")).alias("t")).select("cls", "t.lead")

    star = best(votes.where("cls <> lead").where(near("n", "ln"))).select(F.col("cls").alias("u"), F.col("lead").alias("v"))
    # Texts of one id are one document.
    own = full.join(classes, key).select("id", "cls").distinct()
    several = own.groupBy("id").agg(F.min("cls").alias("v"), F.max("cls").alias("high")).where("v < high").select("id", "v")
    same = own.join(several, "id").select(F.col("cls").alias("u"), "v")
    linked = cut_lineage(components(_confirm(cut_lineage(star), texts, shingle, percent).unionByName(same)))

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(linked, F.col("cls") == F.col("node"), "left").withColumn("c", F.coalesce("component", "cls")).drop("node", "component")

    def joined(found: DataFrame) -> DataFrame:
        told = linked.select(F.col("node").alias("u"), F.col("component").alias("v"))
        return cut_lineage(components(told.unionByName(found)))

    # What is left: buckets that hold more than one component.
    now = placed(buckets.select("cls", "b"))
    split = now.groupBy("b").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("b")
    live = cut_lineage(now.join(split, "b").join(best(votes).withColumnRenamed("lead", "home"), "cls"))
    linked = joined(_blockwise(live.select("home", "cls", "c").distinct(), texts, shingle, percent))
    # Buckets with several homes, those of the same members once.
    now = placed(live.drop("c"))
    ends = [f(c).alias(f"{c}_{name}") for c in ("c", "home") for name, f in (("low", F.min), ("high", F.max))]
    split = now.groupBy("b").agg(*ends, F.bit_xor(F.xxhash64("cls")).alias("x"), F.count("*").alias("size"))
    split = split.where("c_low < c_high AND home_low < home_high").groupBy("x", "size").agg(F.min("b").alias("b")).select("b")
    linked = joined(_blockwise(now.join(split, "b").select(F.col("b").alias("home"), "cls", "c"), texts, shingle, percent))
    # Components are named by the smallest id of their classes.
    top = linked.join(classes, F.col("node") == F.col("cls")).groupBy("component").agg(F.min("rep.id").alias("top"))
    named = classes.join(linked, F.col("cls") == F.col("node"), "left").join(top, "component", "left")
    named = named.select(*key, F.coalesce("top", "rep.id").alias("component_id"))
    out = signed.select("id", *key).join(named, key, "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    out = out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(col(doc_id) == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`docs` without the rows whose text is near that of a document with a smaller id."""
    plain = docs.select(col(doc_id).alias("id"), col(text).alias("text"))
    gone = near_duplicates(plain, "id", "text", **options).where("NOT kept").select("id").distinct()
    return packed(docs, id=col(doc_id).cast("long")).join(gone, "id", "left_anti").select("row.*")
