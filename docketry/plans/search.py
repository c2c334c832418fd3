"""Ranked name search: exact, prefix, substring, then fuzzy by trigrams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry import fixed
from docketry.functions.barrier import with_once
from docketry.functions.names import normalize_name, pieces, trigram_similarity, trigrams
from docketry.operators.ordering import best_per_key
from docketry.session import cut_lineage

EXACT, PREFIX, WITHIN, FUZZY = 0, 1, 2, 3
QUERY_MIN = 2
REQUEST_CHARS, REQUEST_HITS = 100, 8  # bounds of one typeahead request, not of the search


def prepare_queries(queries: DataFrame, text: str = "q") -> DataFrame:
    """Queries in matching form; too short ones find nothing."""
    return queries.withColumn("q_norm", normalize_name(F.trim(F.col(text)))).where(F.length("q_norm") >= QUERY_MIN)


def rarest_grams(side: DataFrame, name: str, counts: DataFrame) -> DataFrame:
    """The probe trigrams (name, size, gram) of a side with trigrams `g`: the rarest
    size - ceil(t * size) + 1 by `counts` (gram, df), a table bounded by the alphabet."""
    each = side.select(name, F.size("g").alias("size"), F.explode("g").alias("gram"))
    ranked = each.join(F.broadcast(counts), "gram", "left").groupBy(name, "size").agg(
        F.sort_array(
            F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram"))
        ).alias("by_df")  # a name's own trigrams
    )
    keep = F.col("size") - F.ceil(F.col("size") * fixed.TRIGRAM_THRESHOLD - 1e-9) + 1
    return ranked.select(name, "size", F.explode(F.slice("by_df", F.lit(1), keep.cast("int"))["gram"]).alias("gram"))


def _candidates(forms: DataFrame, asked: DataFrame) -> DataFrame:
    """(norm, q_norm) pairs that may match, without trying every name against every query.

    A fuzzy match above the threshold shares a trigram among the rarest few of both sides
    (prefix filtering), and a containing name holds the query's rarest piece. Both are
    equi-joins on rare pieces; a piece that a large part of the names holds is never the
    probe of a query that also holds a rarer one. Nothing is cut: the filters are exact.
    """
    grams = forms.select("norm", trigrams(F.col("norm")).alias("g"))
    wanted = asked.select("q_norm", trigrams(F.col("q_norm")).alias("g"))
    # At most 37^3 + padding trigrams exist over [A-Z0-9 ], so this table is bounded.
    counts = grams.select(F.explode("g").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))

    fuzzy = (
        rarest_grams(grams, "norm", counts)
        .join(rarest_grams(wanted, "q_norm", counts).drop("size"), "gram")
        .select("norm", "q_norm")
    )

    # A query is contained only in names that hold its rarest piece (of three letters, or of
    # two for a two-letter query); a piece no name holds ranks rarest and rules all out.
    held = forms.select("norm", F.explode(F.concat(pieces(F.col("norm"), 2), pieces(F.col("norm"), 3))).alias("piece"))
    freq = held.groupBy("piece").agg(F.count(F.lit(1)).alias("df"))  # bounded like the trigrams
    own = F.when(F.length("q_norm") == 2, pieces(F.col("q_norm"), 2)).otherwise(pieces(F.col("q_norm"), 3))
    probe = best_per_key(
        asked.select("q_norm", F.explode(own).alias("piece")).join(F.broadcast(freq), "piece", "left"),
        ["q_norm"],
        [F.asc_nulls_first("df"), F.asc("piece")],
    )
    within = (
        held.join(probe.select("q_norm", "piece"), "piece")
        .where(F.col("norm").contains(F.col("q_norm")))
        .select("norm", "q_norm")
    )
    return fuzzy.union(within).distinct()


def search_batch(
    queries: DataFrame,
    aliases: DataFrame,
    employers: DataFrame,
    limit: int = 25,
    query: str = "q",
) -> DataFrame:
    """Ranked hits of many queries in one job: (q, place, employer fields, alias, tier)."""
    asked = cut_lineage(prepare_queries(queries.select(query).distinct(), query))
    # Distinct forms first: many entities sharing a spelling are matched once.
    forms = cut_lineage(aliases.select("norm").where(F.col("norm") != "").distinct())
    scored = score_pairs(_candidates(forms, asked.select("q_norm").distinct()))
    hits = scored.join(asked, "q_norm").join(aliases, "norm")
    return rank_hits(hits, employers, [query], limit)


def search(
    text: str, aliases: DataFrame, employers: DataFrame, limit: int = 25
) -> DataFrame:
    """Ranked hits of one query: a single scan of the aliases, no join to find candidates."""
    spark = aliases.sparkSession
    asked = prepare_queries(spark.createDataFrame([(text,)], "q string"))
    norm = (asked.first() or {"q_norm": None})["q_norm"]  # the normalized query, one string
    asked_form = {"q": F.lit(text), "q_norm": F.lit(norm).cast("string")}
    found = _scored(aliases.withColumns(asked_form).where(F.lit(norm is not None)))
    return rank_hits(_rank_tier(found), employers, ["q"], limit)


def score_pairs(pairs: DataFrame) -> DataFrame:
    """Similarity and tier of (norm, q_norm) pairs; pairs of no tier are left out."""
    return _rank_tier(_scored(pairs))


def _scored(pairs: DataFrame) -> DataFrame:
    """Add the similarity of `norm` and `q_norm`, each pair's trigrams computed once."""
    grams = F.struct(trigrams(F.col("norm")).alias("a"), trigrams(F.col("q_norm")).alias("b"))
    sim = trigram_similarity(F.col("_grams.a"), F.col("_grams.b"))
    return with_once(with_once(pairs, "_grams", grams), "sim", sim).drop("_grams")


def _rank_tier(found: DataFrame) -> DataFrame:
    norm, q = F.col("norm"), F.col("q_norm")
    tier = (
        F.when(norm == q, EXACT)
        .when(norm.startswith(q), PREFIX)
        .when(norm.contains(q), WITHIN)
        .when(F.col("sim") >= fixed.TRIGRAM_THRESHOLD, FUZZY)
    )
    return found.withColumn("tier", tier).where(F.col("tier").isNotNull())


def rank_hits(hits: DataFrame, employers: DataFrame, by: list[str], limit: int) -> DataFrame:
    best = best_per_key(
        hits,
        [*by, "employer_id"],
        [F.asc("tier"), F.desc("sim"), F.desc("rows"), F.asc("name")],
    ).select(*by, "employer_id", F.col("name").alias("matched_alias"), "tier", "sim")
    order = [
        F.asc("tier"),
        F.when(F.col("tier") == FUZZY, F.col("sim")).desc_nulls_last(),
        F.desc_nulls_last("certified_total"),
        F.desc_nulls_last("uscis_initial_total"),
        F.asc("display_name"),
        F.asc("slug"),
    ]
    return best_per_key(
        best.join(employers, "employer_id"), by, order, max(limit, 1), "place"
    ).drop("sim")


def typeahead(text: str, aliases: DataFrame, employers: DataFrame) -> DataFrame:
    """Hits while a request is typed; only its first REQUEST_CHARS characters are read."""
    return search(text.strip()[:REQUEST_CHARS], aliases, employers, limit=REQUEST_HITS)
