"""Linking registry B to the entities: no shared key, only name, state and last four digits.

The candidates of a registry row are only ever counted and, when one stands out, named. So
they are summarized first, per (name, state) and per (name, state, last four), and the
registry joins the two summaries: one row each, no candidate lists and no pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry import fixed
from docketry.functions.barrier import with_once
from docketry.functions.names import normalize_name, slugify
from docketry.operators.ordering import dense_index
from docketry.operators.slugs import assign_slugs

KEY = ["norm", "state", "tax4"]


def approvals():
    """Initial and continuing approvals; unknown when either is."""
    return F.col("initial_approvals") + F.col("continuing_approvals")


COUNTS = [f"{t}_{o}" for t in ("initial", "continuing") for o in fixed.OUTCOMES] + [
    "new_employment_approvals"
]


def registry_summary(registry: DataFrame) -> DataFrame:
    """Registry rows combined per year and identity columns, with the name's matching form.

    Map tasks combine before the shuffle, and names are normalized once per combined row.
    `approvals` is the sum over rows, `top_approvals` the largest single row.
    """
    identity = ["fiscal_year", "source_file", "employer_name", "state", "city", "naics", "tax4"]
    combined = registry.groupBy(*identity).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.sum(c).alias(c) for c in COUNTS],
        F.sum(approvals()).alias("approvals"),
        F.max(approvals()).alias("top_approvals"),
    )
    return with_once(combined, "norm", normalize_name(F.col("employer_name")))


def registry_entities(summary: DataFrame) -> DataFrame:
    """Registry rows grouped to (norm, state, tax4); name and city by most approvals."""

    def by_most(c: str, out: str):
        # Rows without the value or without approvals do not compete; ties go to the
        # first value in the alphabet.
        counts = F.col(c).isNotNull() & F.col("top_approvals").isNotNull()
        order = F.when(counts, F.struct(-F.col("top_approvals"), F.col(c)))
        return F.min_by(c, order).alias(out)

    return (
        summary.where(F.col("norm") != "")
        .groupBy(*KEY)
        .agg(by_most("employer_name", "name"), by_most("city", "city"), F.sum("approvals").alias("approvals"))
    )


def entity_places(keyed: DataFrame, entity: DataFrame) -> DataFrame:
    """Distinct (entity, norm, state, tax id) under which an entity ever submitted."""
    return (
        keyed.where(F.col("employer_name").isNotNull())  # the keyed summary of filings
        .select("employer_key", "norm", F.col("employer_state").alias("state"))
        .distinct()
        .join(entity.select("employer_key", "employer_id", "fein"), "employer_key")
        .select("employer_id", "norm", "state", "fein")
        .distinct()
    )


def link_registry(registry_entity: DataFrame, places: DataFrame) -> DataFrame:
    """Add the matched entity id and the outcome to every registry entity.

    One candidate and no contradicting digits: match. Several: the one whose digits agree,
    if exactly one does. NULL states and NULL digits match nothing.
    """
    tail = F.right(F.replace(F.col("fein"), F.lit("-"), F.lit("")), F.lit(4))
    by_place = places.groupBy("norm", "state").agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.max("employer_id").alias("some_id"),
        F.count_if(F.col("fein").isNull()).alias("n_without_id"),
    )
    by_tail = (
        places.where(F.col("fein").isNotNull())
        .groupBy("norm", "state", tail.alias("tax4"))
        .agg(F.count(F.lit(1)).alias("n_agreeing"), F.max("employer_id").alias("agreeing_id"))
    )
    known = F.col("tax4").isNotNull()
    one, agrees = F.col("n_candidates") == 1, F.coalesce(F.col("n_agreeing") == 1, F.lit(False))
    any_candidate = known & F.col("n_candidates").isNotNull()
    method = (
        F.when(~any_candidate, F.lit("no_name_state_match"))
        .when(one & (F.col("n_without_id") == 1), F.lit("name_state"))
        .when(one & agrees, F.lit("name_state_tax4"))
        .when(one, F.lit("rejected_tax4_differs"))
        .when(agrees, F.lit("several_candidates_tax4"))
        .otherwise(F.lit("several_candidates"))
    )
    return (
        registry_entity.join(by_place, ["norm", "state"], "left")
        .join(by_tail, KEY, "left")
        .withColumn("method", method)
        .withColumn(
            "employer_id",
            F.when(F.col("method") == "name_state", F.col("some_id")).when(
                F.col("method").isin("name_state_tax4", "several_candidates_tax4"),
                F.col("agreeing_id"),
            ),
        )
        .select(*KEY, "name", "city", "approvals", "employer_id", "method")
    )


def registry_ids(linked: DataFrame, entity: DataFrame) -> DataFrame:
    """New ids, after the entities' own, for unmatched registry entities."""
    fresh = linked.where(F.col("employer_id").isNull()).drop("employer_id")
    order = [F.desc_nulls_last("approvals"), F.asc("norm"), F.asc_nulls_last("state"), F.asc_nulls_last("tax4")]
    top = entity.agg(F.coalesce(F.max("employer_id"), F.lit(0)).alias("_top"))
    return (
        dense_index(fresh, order, "_place")
        .crossJoin(F.broadcast(top))  # one row
        .withColumn("new_id", F.col("_place") + F.col("_top"))
        .drop("_place", "_top")
    )


def registry_slugs(numbered: DataFrame, entity: DataFrame) -> DataFrame:
    """Free slugs, none of which an entity holds, for the rows of `registry_ids`."""
    placed = with_once(numbered, "_base", slugify(F.coalesce("name", "norm")))  # the choices name it several times
    base = F.col("_base")
    stem = F.concat_ws("-", base, F.lower(F.coalesce("state", F.lit("xx"))))
    return assign_slugs(placed, "new_id", [base, stem], stem, entity.select("slug"), out="new_slug").drop("_base")


def registry_only(linked: DataFrame, entity: DataFrame) -> DataFrame:
    """New ids and slugs of unmatched registry entities."""
    return registry_slugs(registry_ids(linked, entity), entity).select(*KEY, "new_id", "new_slug")


def finalize_links(linked: DataFrame, only: DataFrame) -> DataFrame:
    """Every registry entity with its final id. Unknown states and digits keep their new id."""
    same = [F.col("m." + k).eqNullSafe(F.col("o." + k)) for k in KEY]
    return (
        linked.alias("m")
        .join(only.alias("o"), same, "left")
        .select(
            "m.*",
            F.coalesce("m.employer_id", "o.new_id").alias("final_id"),
            F.col("m.employer_id").isNotNull().alias("matched"),
            *[c for c in only.columns if c == "new_slug"],
        )
    )


def with_final_id(summary: DataFrame, final: DataFrame) -> DataFrame:
    """Registry summary rows with their entity's final id; nameless rows drop out."""
    same = [F.col("u." + k).eqNullSafe(F.col("e." + k)) for k in KEY]
    return (
        summary.alias("u")
        .join(final.alias("e"), same)
        .select("u.*", F.col("e.final_id").alias("final_id"), "e.matched")
    )


def registry_years(rows: DataFrame) -> DataFrame:
    """Registry counts per entity and year; a sum of nothing known stays missing."""
    return rows.groupBy(F.col("final_id").alias("employer_id"), "fiscal_year").agg(
        F.min("source_file").alias("source_file"),
        *[F.sum(c).cast("int").alias(c) for c in ["rows", *COUNTS]],
    )


def link_outcomes(final: DataFrame) -> DataFrame:
    """Registry entities and approvals per outcome."""
    return final.groupBy("method").agg(
        F.count(F.lit(1)).alias("employers"), F.sum("approvals").alias("approvals")
    )


def link_rates(final: DataFrame, summary: DataFrame) -> DataFrame:
    """Matched and total entities and approvals, and the rows that have no name."""
    rates = final.agg(
        F.count(F.lit(1)).alias("uscis_employers"),
        F.count_if("matched").alias("matched"),
        F.coalesce(F.sum("approvals"), F.lit(0)).alias("approvals"),
        F.coalesce(F.sum(F.when(F.col("matched"), F.col("approvals"))), F.lit(0)).alias("approvals_matched"),
    )
    unnamed = summary.where(F.col("employer_name").isNull()).agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("unnamed_rows"),
        F.coalesce(F.sum("approvals"), F.lit(0)).alias("unnamed_approvals"),
    )
    return rates.crossJoin(unnamed)  # two one-row tables
