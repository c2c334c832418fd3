"""Stored index of name forms: a batch of queries reads only the postings it probes.

Layout under `root`:

    order/              how often each piece occurred when the first arrival was indexed
    forms/part=N/       the distinct forms that arrival N brought
    postings/part=N/kind=K/band=L/bucket=B/   (piece, size, norm), sorted by piece and size
    parts/N/            one row, written last: arrival N is complete

`kind` is `gram` (the rarest trigrams of a form, enough to meet every form above the
threshold) or `piece` (all substrings of two and three characters, for containment). Prefix
filtering needs one order of pieces on both sides and no special one, so the order of the
first arrival is kept for good; pieces unseen then rank rarest. `band` is the magnitude of
`size`: the number of trigrams, or the length of a form. Sizes too far apart cannot reach the
threshold, so their bands are not read.

An arrival indexes only forms that no complete arrival holds. One that was lost on the way is
not listed in `parts` and writes its folders again; one that is listed is left as it is. Null
and empty forms are not indexed. Searches list complete parts only.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry import fixed
from docketry.functions.names import pieces, trigrams
from docketry.operators.ordering import best_per_key
from docketry.plans.search import prepare_queries, rank_hits, rarest_grams, score_pairs
from docketry.session import cut_lineage

BUCKETS = 16
POSTINGS = "piece string, size int, norm string, part int, kind string, band int, bucket int"


def extend_index(aliases: DataFrame, root: str, part: int, buckets: int = BUCKETS) -> None:
    """Index the forms of one arrival of aliases (column `norm`). The number of buckets is
    that of the first arrival."""
    spark = aliases.sparkSession
    done = complete_parts(spark, root)
    if part in done:
        return
    forms = aliases.select("norm").where(F.col("norm") != "").distinct()
    if done:
        buckets = next(iter(done.values()))
        forms = forms.join(_forms(spark, root, done), "norm", "left_anti")
    forms = cut_lineage(forms)
    if not done:
        _piece_counts(forms).write.mode("overwrite").parquet(f"{root}/order")
    postings = _postings(forms, _order(spark, root)).withColumns(
        {"part": F.lit(part), "band": _band(F.col("size")), "bucket": _bucket(F.col("piece"), buckets)}
    )
    layout = ["kind", "band", "bucket"]
    (
        # Salted by the form: a piece that a third of the names hold is many tasks' work.
        postings.repartition(*layout, F.pmod(F.xxhash64("norm"), F.lit(8)))
        .sortWithinPartitions(*layout, "piece", "size")
        .drop("part")
        .write.mode("overwrite")
        .partitionBy(*layout)
        .parquet(f"{root}/postings/part={part}")
    )
    forms.write.mode("overwrite").parquet(f"{root}/forms/part={part}")
    listed = spark.createDataFrame([(part, buckets)], "part int, buckets int")
    listed.write.mode("overwrite").parquet(f"{root}/parts/{part}")


def complete_parts(spark: SparkSession, root: str) -> dict[int, int]:
    """Complete arrivals and their number of buckets, one row per arrival."""
    try:
        rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/parts").collect()
    except AnalysisException:  # nothing indexed yet
        return {}
    return {r.part: r.buckets for r in sorted(rows)}


def candidate_pairs(spark: SparkSession, root: str, asked: DataFrame) -> DataFrame:
    """Distinct (norm, q_norm) pairs that may match the normalized queries `q_norm`."""
    done = complete_parts(spark, root)
    if not done:
        raise FileNotFoundError(f"no index under {root}")
    buckets = next(iter(done.values()))
    order = _order(spark, root)
    grams = rarest_grams(
        asked.select("q_norm", trigrams(F.col("q_norm")).alias("g")), "q_norm", _of_kind(order, "gram", "gram")
    )
    short = F.length("q_norm") == 2
    own = F.when(short, pieces(F.col("q_norm"), 2)).otherwise(pieces(F.col("q_norm"), 3))
    within = best_per_key(
        asked.select("q_norm", F.length("q_norm").alias("size"), F.explode(own).alias("piece")).join(
            F.broadcast(_of_kind(order, "piece", "piece")), "piece", "left"
        ),
        ["q_norm"],
        [F.asc_nulls_first("df"), F.asc("piece")],
    )
    probes = cut_lineage(
        grams.select("q_norm", F.lit("gram").alias("kind"), F.col("gram").alias("piece"), F.col("size").alias("q_size"))
        .unionByName(within.select("q_norm", F.lit("piece").alias("kind"), "piece", F.col("size").alias("q_size")))
        .withColumns({"bucket": _bucket(F.col("piece"), buckets)} | _reach(F.col("kind"), F.col("q_size")))
    )
    # Which folders the batch needs: at most kinds x buckets rows, whatever the batch.
    needed = probes.groupBy("kind", "bucket").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
    postings = _read_postings(spark, root, done).where(_any(
        (F.col("kind") == r.kind)
        & (F.col("bucket") == r.bucket)
        & F.col("band").between(_magnitude(r.low), _magnitude(r.high))
        for r in needed
    ))
    return (
        postings.join(probes, ["kind", "bucket", "piece"])
        .where(F.col("size").between(F.col("low"), F.col("high")))
        .where((F.col("kind") == "gram") | F.col("norm").contains(F.col("q_norm")))
        .select("norm", "q_norm")
        .distinct()
    )


def search_indexed(
    root: str, queries: DataFrame, aliases: DataFrame, employers: DataFrame, limit: int = 25, query: str = "q"
) -> DataFrame:
    """As `search_batch`, with the candidates from the stored index."""
    spark = queries.sparkSession
    asked = cut_lineage(prepare_queries(queries.select(query).distinct(), query))
    scored = score_pairs(candidate_pairs(spark, root, asked.select("q_norm").distinct()))
    return rank_hits(scored.join(asked, "q_norm").join(aliases, "norm"), employers, [query], limit)


def _piece_counts(forms: DataFrame) -> DataFrame:
    """(kind, piece, df); pieces of three characters at most, so bounded by the alphabet."""
    return _all_pieces(forms).groupBy("kind", "piece").agg(F.count(F.lit(1)).alias("df"))


def _all_pieces(forms: DataFrame) -> DataFrame:
    norm = F.col("norm")
    grams = forms.select("norm", F.lit("gram").alias("kind"), F.explode(trigrams(norm)).alias("piece"))
    held = F.explode(F.concat(pieces(norm, 2), pieces(norm, 3)))
    return grams.unionByName(forms.select("norm", F.lit("piece").alias("kind"), held.alias("piece")))


def _postings(forms: DataFrame, order: DataFrame) -> DataFrame:
    norm = F.col("norm")
    grams = rarest_grams(forms.select("norm", trigrams(norm).alias("g")), "norm", _of_kind(order, "gram", "gram"))
    held = F.explode(F.concat(pieces(norm, 2), pieces(norm, 3)))
    return grams.select(F.lit("gram").alias("kind"), F.col("gram").alias("piece"), "size", "norm").unionByName(
        forms.select(F.lit("piece").alias("kind"), held.alias("piece"), F.length("norm").alias("size"), "norm")
    )


def _order(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("kind string, piece string, df bigint").parquet(f"{root}/order")


def _of_kind(order: DataFrame, kind: str, name: str) -> DataFrame:
    return order.where(F.col("kind") == kind).select(F.col("piece").alias(name), "df")


def _forms(spark: SparkSession, root: str, parts: dict[int, int]) -> DataFrame:
    return spark.read.schema("norm string").parquet(*[f"{root}/forms/part={p}" for p in parts])


def _read_postings(spark: SparkSession, root: str, parts: dict[int, int]) -> DataFrame:
    reader = spark.read.schema(POSTINGS).option("basePath", f"{root}/postings")
    return reader.parquet(*[f"{root}/postings/part={p}" for p in parts])


def _bucket(piece: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(piece), F.lit(buckets)).cast("int")


def _band(size: Column) -> Column:
    return F.length(F.bin(size)) - 1


def _magnitude(size: int) -> int:
    return max(size, 1).bit_length() - 1


def _reach(kind: Column, q_size: Column) -> dict[str, Column]:
    """Sizes a match can have: at the threshold t the smaller set holds t of the larger one;
    a containing name is at least as long."""
    t = fixed.TRIGRAM_THRESHOLD
    low = F.when(kind == "gram", F.ceil(q_size * t - 1e-9)).otherwise(q_size)
    high = F.when(kind == "gram", F.floor(q_size / t + 1e-9)).otherwise(F.lit(2**31 - 1))
    return {"low": low.cast("int"), "high": high.cast("int")}


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out
