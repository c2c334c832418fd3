"""Entity resolution: which employer does a filing row belong to.

Rows with a tax id are that id's. Rows without one are looked up by (name, state), then by
name alone; each lookup table has one row per key, so no join multiplies rows. Different ids
are never merged: sharing a name is only recorded.

Everything but the final attachment works on a summary of the filings: rows counted per
(id, spelling, state, city, year), which map tasks combine before anything is shuffled. Names
are normalized there, once per summary row instead of once per filing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry import fixed
from docketry.functions.barrier import with_once
from docketry.functions.names import normalize_name, slugify
from docketry.operators.ordering import best_per_key, dense_index
from docketry.operators.slugs import assign_slugs

PARTY = ["employer_fein", "employer_name", "employer_state", "employer_city", "fiscal_year"]


def filing_summary(cases: DataFrame) -> DataFrame:
    """Filings counted per party columns and year, with the name's matching form."""
    counted = cases.groupBy(*PARTY).agg(F.count(F.lit(1)).alias("n"))
    return with_once(counted, "norm", normalize_name(F.col("employer_name")))


def name_state_id_rows(summary: DataFrame) -> DataFrame:
    """Filings per (norm, state, id), over those that have an id."""
    return (
        summary.where(F.col("employer_fein").isNotNull() & (F.col("norm") != ""))
        .groupBy("norm", "employer_state", "employer_fein")
        .agg(F.sum("n").alias("n"))
    )


def name_state_ids(per_id: DataFrame, share: float = fixed.DOMINANT_SHARE) -> DataFrame:
    """(norm, state) -> number of ids, the id with most filings, and whether it dominates."""
    return per_id.groupBy("norm", "employer_state").agg(
        F.count(F.lit(1)).alias("ns_ids"),
        F.max_by("employer_fein", "n").alias("ns_top"),  # a tie never dominates
        (F.max("n") / F.sum("n") >= share).alias("ns_dominant"),
    )


def name_ids(per_id: DataFrame) -> DataFrame:
    """norm -> number of ids in any state, and the id when it is the only one."""
    ids = per_id.select("norm", "employer_fein").distinct()
    return ids.groupBy("norm").agg(
        F.count(F.lit(1)).alias("n_ids"), F.min("employer_fein").alias("n_only")
    )


def id_key(fein: Column) -> Column:
    return F.concat(F.lit("F:"), fein)


def name_key(norm: Column, state: Column) -> Column:
    return F.concat(F.lit("N:"), norm, F.lit("|"), F.coalesce(state, F.lit("")))


def key_id(key: Column) -> Column:
    """The tax id in a key; NULL for a name key."""
    return F.when(key.startswith("F:"), F.substr(key, F.lit(3)))


def keyed_summary(summary: DataFrame) -> DataFrame:
    """Add `employer_key` and `match_method` to every summary row."""
    with_id = summary.where(F.col("employer_fein").isNotNull()).withColumns(
        {"employer_key": id_key(F.col("employer_fein")), "match_method": F.lit("fein")}
    )
    per_id = name_state_id_rows(summary)
    dominant = F.coalesce(F.col("ns_dominant"), F.lit(False))
    # A name known anywhere in this state may not borrow an id from another state.
    elsewhere = F.col("ns_ids").isNull() & (F.col("n_ids") == 1)
    routed = (
        summary.where(F.col("employer_fein").isNull())
        .alias("k")
        .join(
            name_state_ids(per_id).alias("s"),
            (F.col("k.norm") == F.col("s.norm"))
            & F.col("k.employer_state").eqNullSafe(F.col("s.employer_state")),
            "left",
        )
        .join(name_ids(per_id).alias("n"), F.col("k.norm") == F.col("n.norm"), "left")
        .select(
            "k.*",
            F.when(dominant, id_key(F.col("ns_top")))
            .when(elsewhere, id_key(F.col("n_only")))
            .otherwise(name_key(F.col("k.norm"), F.col("k.employer_state")))
            .alias("employer_key"),
            F.when(dominant & (F.col("ns_ids") == 1), F.lit("name_state_to_fein"))
            .when(dominant, F.lit("name_state_to_dominant_fein"))
            .when(elsewhere, F.lit("name_to_fein"))
            .when(F.col("ns_ids").isNotNull() | (F.col("n_ids") > 1), F.lit("name_state_ambiguous"))
            .otherwise(F.lit("name_state"))
            .alias("match_method"),
        )
    )
    return with_id.unionByName(routed)


def with_entity_key(cases: DataFrame, keyed: DataFrame) -> DataFrame:
    """Add `employer_key` and `match_method` to every case.

    Cases with an id need no lookup and are not shuffled. The others join the routes of
    their (spelling, state), one row each.
    """
    with_id = cases.where(F.col("employer_fein").isNotNull()).withColumns(
        {"employer_key": id_key(F.col("employer_fein")), "match_method": F.lit("fein")}
    )
    # A route follows from spelling and state, so distinct routes are one per pair.
    routes = (
        keyed.where(F.col("employer_fein").isNull())
        .select("employer_name", "employer_state", "employer_key", "match_method")
        .distinct()
    )
    same = [F.col("k." + c).eqNullSafe(F.col("r." + c)) for c in ("employer_name", "employer_state")]
    routed = (
        cases.where(F.col("employer_fein").isNull())
        .alias("k")
        .join(routes.alias("r"), same)
        .select("k.*", "r.employer_key", "r.match_method")
    )
    return with_id.unionByName(routed)


def spelling_counts(keyed: DataFrame) -> DataFrame:
    """Filings per (entity, spelling), with the last year it was used."""
    return (
        keyed.where(F.col("employer_name").isNotNull())
        .groupBy("employer_key", "employer_name", "norm")
        .agg(F.sum("n").alias("n"), F.max("fiscal_year").alias("last_fy"))
    )


def display_names(spellings: DataFrame) -> DataFrame:
    order = [F.desc("n"), F.desc("last_fy"), F.asc("employer_name")]
    return best_per_key(spellings, ["employer_key"], order).select(
        "employer_key", F.col("employer_name").alias("display_name")
    )


def main_places(keyed: DataFrame) -> DataFrame:
    """Most frequent (city, state) of an entity; ties by city, then state."""
    places = (
        keyed.where(F.col("employer_state").isNotNull())
        .groupBy("employer_key", "employer_city", "employer_state")
        .agg(F.sum("n").alias("n"))
    )
    order = [F.desc("n"), F.asc_nulls_last("employer_city"), F.asc("employer_state")]
    return best_per_key(places, ["employer_key"], order).select(
        "employer_key", F.col("employer_city").alias("city"), F.col("employer_state").alias("state")
    )


def numbered_entities(keyed: DataFrame) -> DataFrame:
    """One row per entity of the keyed summary: id by volume, display name, tax id, place,
    filings. Linkage and lookups need no more; slugs take rounds of their own."""
    totals = keyed.groupBy("employer_key").agg(F.sum("n").alias("lca_rows"))
    base = (
        totals.join(display_names(spelling_counts(keyed)), "employer_key", "left")
        .join(main_places(keyed), "employer_key", "left")
        .select(
            "employer_key",
            F.coalesce("display_name", F.lit("(no name)")).alias("display_name"),
            key_id(F.col("employer_key")).alias("fein"),
            "city",
            "state",
            "lca_rows",
        )
    )
    return dense_index(base, [F.desc("lca_rows"), F.asc("employer_key")], "employer_id")


def with_slugs(numbered: DataFrame) -> DataFrame:
    """Entities with their unique slugs."""
    ranked = with_once(numbered, "_stem", slugify(F.col("display_name")))  # the choices name it several times
    stem = F.col("_stem")
    area = F.lower(F.coalesce("state", F.lit("xx")))
    choices = [
        stem,
        F.concat_ws("-", stem, area),
        F.when(F.col("fein").isNotNull(), F.concat_ws("-", stem, F.right(F.col("fein"), F.lit(4)))),
    ]
    slugged = assign_slugs(ranked, "employer_id", choices, stem)
    return slugged.select(
        "employer_id", "slug", "employer_key", "display_name", "fein", "city", "state", "lca_rows"
    )


def entities(keyed: DataFrame) -> DataFrame:
    """One row per entity of the keyed summary, with id and slug."""
    return with_slugs(numbered_entities(keyed))


def aliases(keyed: DataFrame, entity: DataFrame) -> DataFrame:
    """Spellings of every entity with their matching form and filing counts."""
    return (
        spelling_counts(keyed)
        .join(entity.select("employer_key", "employer_id"), "employer_key")
        .select("employer_id", F.col("employer_name").alias("name"), "norm", F.col("n").cast("int").alias("rows"))
    )


def attach_entities(cases: DataFrame, keyed: DataFrame, entity: DataFrame) -> DataFrame:
    """Give every case its entity id and match method."""
    ids = entity.select("employer_key", "employer_id")
    return with_entity_key(cases, keyed).join(ids, "employer_key").drop("employer_key")


def method_counts(keyed: DataFrame, year: int | None = None) -> DataFrame:
    """Filings per match method, over all years and in one year."""
    aggs = [F.sum("n").alias("cases")]
    if year is not None:
        in_year = F.when(F.col("fiscal_year") == year, F.col("n")).otherwise(0)
        aggs.append(F.sum(in_year).alias("cases_in_year"))
    return keyed.groupBy("match_method").agg(*aggs)


def resolution_stats(entity: DataFrame, alias: DataFrame, members: DataFrame) -> DataFrame:
    """Entity counts by kind, aliases, and how many pairs of ids share a name."""
    kinds = entity.agg(
        F.count(F.lit(1)).alias("employers"),
        F.count("fein").alias("fein_employers"),
        F.count_if(F.col("fein").isNull()).alias("name_employers"),
    )
    names = alias.agg(F.count(F.lit(1)).alias("aliases"))
    pairs = members.groupBy("norm").agg(F.first("group_pairs").alias("p")).agg(
        F.coalesce(F.sum("p"), F.lit(0)).alias("possible_link_pairs")
    )
    return kinds.crossJoin(names).crossJoin(pairs)  # three one-row tables
