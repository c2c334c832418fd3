"""Everything shown about one employer or one group, and the lists behind the pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry import fixed
from docketry.operators.links import partners_of
from docketry.operators.ordering import best_per_key


def by_volume() -> list[Column]:
    return [F.desc_nulls_last("certified_total"), F.asc("display_name"), F.asc("slug")]


def profile(tables: dict[str, DataFrame], slug: str) -> dict[str, DataFrame]:
    """The employer with this slug and its child lists, each in its display order."""
    employers = tables["agg_employers"]
    me = employers.where(F.col("slug") == slug)
    ident = me.select("employer_id")

    def mine(name: str, *order: Column) -> DataFrame:
        # One id on the right: a broadcast semi join, pushed to the scan of the table.
        return tables[name].join(F.broadcast(ident), "employer_id", "left_semi").orderBy(*order)

    partners = partners_of(tables["agg_links"], ident).select(
        F.col("partner_id").alias("employer_id"), F.col("norm").alias("norm_name")
    )
    group = tables["agg_groups"].join(F.broadcast(ident), "employer_id", "left_semi").select("group_slug")
    return {
        "employer": me,
        "years": mine("agg_lca_year", F.asc("fiscal_year")),
        "registry": mine("uscis_year", F.asc("fiscal_year")),
        "roles": mine("agg_lca_year_role", F.asc("role_group"), F.desc("fiscal_year")),
        "top": mine("agg_lca_year_top", F.asc("fiscal_year"), F.asc("kind"), F.asc("rank")),
        "aliases": mine("agg_aliases", F.desc("rows"), F.asc("name")),
        "signal": mine("agg_entry_signal", F.asc("role_selection")),
        "links": employers.join(partners, "employer_id").orderBy(*by_volume()),
        "similar": similar_employers(employers, me),
        "group": group_page(tables["agg_groups"], employers, group),
    }


def similar_employers(
    employers: DataFrame, asked: DataFrame | None = None, n: int = fixed.SIMILAR_LIMIT
) -> DataFrame:
    """Up to `n` other employers of the same industry and state, by volume.

    An employer's list is the top n + 1 of its group without itself, so the join carries at
    most n + 1 rows per employer however large the group is.
    """
    placed = F.col("naics").isNotNull() & F.col("state").isNotNull()
    top = best_per_key(
        employers.where(placed & F.col("has_lca")), ["naics", "state"], by_volume(), n + 1, "_place"
    )
    mine = (employers if asked is None else asked).where(placed).select(
        F.col("employer_id").alias("asked_id"), "naics", "state"
    )
    # Where the employer itself is not in the top list, the last of it is one too many.
    own = top.select(F.col("employer_id").alias("asked_id"), F.col("_place").alias("_own"))
    return (
        mine.join(top, ["naics", "state"])
        .join(own, "asked_id", "left")
        .where(F.col("employer_id") != F.col("asked_id"))
        .withColumn(
            "place", F.col("_place") - F.when(F.col("_own") < F.col("_place"), 1).otherwise(0)
        )
        .where(F.col("place") <= n)
        .drop("_place", "_own")
    )


def group_page(groups: DataFrame, employers: DataFrame, asked: DataFrame) -> DataFrame:
    """Members of the asked groups with their employer rows, by volume."""
    return (
        groups.select("group_slug", "group_name", "evidence_url", "reviewed_on", "employer_id")
        .join(asked, "group_slug", "left_semi")
        .join(employers, "employer_id")
        .orderBy("group_slug", *by_volume())
    )


def group_years(members: DataFrame, year: DataFrame, by: str = "group_slug", measure: str = "certified") -> DataFrame:
    """Measure per group, member and year, with a total over the group (employer_id NULL) for
    every year any member has. Years come from the data; a page lays them out as columns."""
    cells = members.select(by, "employer_id").join(year.select("employer_id", "fiscal_year", measure), "employer_id")
    sums = cells.rollup("fiscal_year", by, "employer_id").agg(F.sum(measure).cast("bigint").alias(measure), F.grouping_id().alias("_g"))
    return sums.where("_g < 3").where(F.col("_g") != 2).select(by, "employer_id", "fiscal_year", measure)


def own_last_years(year: DataFrame, key: str = "employer_id", n: int = 2) -> DataFrame:
    """The latest `n` years of each entity's own, which need not be the latest overall."""
    return best_per_key(year, [key], [F.desc("fiscal_year")], n)


def mix_shares(rows: DataFrame, key: str, category: str, measure: str) -> DataFrame:
    """Each category's sum and share of its entity's total. Categories are few per entity,
    so the window holds a short list."""
    sums = rows.groupBy(key, category).agg(F.sum(measure).cast("bigint").alias("n"))
    total = F.sum("n").over(Window.partitionBy(key))
    return sums.withColumn(
        "share", F.round(F.try_divide(F.col("n").cast("double"), total.cast("double")), 6)
    )


def first_aliases(aliases: DataFrame, n: int = fixed.ALIAS_SHOWN) -> DataFrame:
    """The `n` most used spellings per entity and how many more there are."""
    counts = aliases.groupBy("employer_id").agg(F.count(F.lit(1)).alias("_all"))
    shown = best_per_key(aliases, ["employer_id"], [F.desc("rows"), F.asc("name"), F.asc("source")], n, "place")
    return shown.join(counts, "employer_id").select(
        "employer_id", "place", "name", "source", "rows",
        F.greatest(F.col("_all") - n, F.lit(0)).alias("more"),
    )


def file_list(sources: DataFrame) -> DataFrame:
    return sources.orderBy("kind", F.asc_nulls_last("fiscal_year"), F.asc_nulls_last("quarter"), "file")


def key_chunks(df: DataFrame, ident: str, size: int = fixed.KEY_CHUNK) -> DataFrame:
    """Chunk number of every key in id order; ids are dense, so no numbering is needed."""
    return df.withColumn("chunk", F.floor((F.col(ident) - 1) / size).cast("int"))
