"""Published aggregate tables over resolved cases.

Status groups: certified; withdrawn (two statuses); denied; submitted is all. Pay percentiles use
certified full-time rows with a plausible yearly pay. Missing stays missing: a sum of no
stated values is NULL, while a count of no rows is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry import fixed
from docketry.functions.clean import annualize, plausible
from docketry.functions.rules import role_group
from docketry.operators.ordering import best_per_key
from docketry.operators.percentiles import exact_percentiles, percentiles_of_counts
from docketry.session import cut_lineage

PAY_BAND = 1000.0  # histogram band: plausible pay spans fewer than a thousand bands
QUARTILES = {"wage_p25": 0.25, "wage_median": 0.5, "wage_p75": 0.75}


def certified() -> Column:
    return F.col("case_status") == fixed.CERTIFIED


def pay_counts() -> Column:
    return F.col("full_time") & F.col("wage_valid")


def count_where(cond: Column) -> Column:
    return F.count_if(cond).cast("int")


def exact_sum(c: Column) -> Column:
    """Sum that does not depend on the order of rows."""
    return F.sum(c.cast("decimal(18,4)")).cast("double")


def with_annual_pay(cases: DataFrame) -> DataFrame:
    """Add (or replace) yearly offered pay, yearly prevailing pay and the plausibility flag."""
    return cases.withColumns(
        {
            "wage_annual": annualize(F.col("wage_from"), F.col("wage_unit")),
            "pw_annual": annualize(F.col("prevailing_wage"), F.col("pw_unit")),
        }
    ).withColumn("wage_valid", plausible(F.col("wage_annual")))


def with_dimensions(cases: DataFrame) -> DataFrame:
    """Add role group, wage level with a label for none, and the prevailing-pay flag."""
    return cases.withColumns(
        {
            "role_group": role_group(F.col("soc_code")),
            "level": F.coalesce("pw_wage_level", F.lit(fixed.NO_LEVEL)),
            "pw_valid": plausible(F.col("pw_annual")),
        }
    )


SOURCE_STEM = "LCA_Disclosure_Data_FY"


def year_sources(cases: DataFrame, stem: str = SOURCE_STEM) -> DataFrame:
    """Per fiscal year: the one file behind it or a label over its quarters; last quarter."""
    # Files first: all later text handling is on one row per file.
    files = cases.groupBy("fiscal_year", "source_file").agg(F.max("source_quarter").alias("_q"))
    label = F.concat(F.lit(stem), F.col("fiscal_year"), F.lit("_Q1-Q"), F.max("_q"))
    return files.groupBy("fiscal_year").agg(
        F.when(F.count("source_file") == 1, F.min("source_file")).otherwise(label).alias("source_file"),
        F.max("_q").alias("quarter"),
    )


def last_years(cases: DataFrame, n: int = 2) -> DataFrame:
    """The latest `n` distinct fiscal years, one row each."""
    return cases.select("fiscal_year").distinct().orderBy(F.desc("fiscal_year")).limit(n)


def entity_year(cases: DataFrame, key: str = "employer_id", stem: str = SOURCE_STEM) -> DataFrame:
    """Counts, stated workers, pay quartiles, level mix and flags per entity and year.

    The cases are read once for all of them, grouped down to one row per entity, year and counted
    pay; counts add these rows up, quartiles rank them. The file labels read three columns more.
    """
    keys = [key, "fiscal_year"]
    levels = {
        "level_i": "I", "level_ii": "II", "level_iii": "III", "level_iv": "IV",
        "level_none": fixed.NO_LEVEL,
    }
    tallies = {
        "submitted": F.lit(True),
        "certified": certified(),
        "withdrawn": F.col("case_status").isin(*fixed.WITHDRAWN_GROUP),
        "denied": F.col("case_status") == fixed.DENIED,
        **{c: certified() & (F.col("level") == v) for c, v in levels.items()},
    }
    flags = ["h1b_dependent", "willful_violator"]
    paid = F.when(certified() & pay_counts(), F.col("wage_annual"))
    once = cut_lineage(
        cases.groupBy(*keys, paid.alias("_v")).agg(
            F.count(F.lit(1)).alias("_n"),
            F.sum(F.when(certified(), F.col("total_workers"))).alias("_workers"),
            *[F.count_if(cond).alias(c) for c, cond in tallies.items()],
            *[F.bool_or(c).alias(c) for c in flags],
        )
    )
    workers = F.when(F.sum("certified") == 0, F.lit(0)).otherwise(F.sum("_workers"))
    counts = once.groupBy(*keys).agg(
        *[F.sum(c).cast("int").alias(c) for c in tallies],
        workers.cast("int").alias("certified_workers"),
        *[F.bool_or(c).alias(c) for c in flags],
    )
    counted = once.where(F.col("_v").isNotNull()).select(*keys, "_v", "_n")
    pay = percentiles_of_counts(counted, keys, QUARTILES, "wage_rows", PAY_BAND)
    return (
        counts.join(pay, keys, "left")
        .withColumn("wage_rows", F.coalesce("wage_rows", F.lit(0)))
        .join(year_sources(cases, stem), "fiscal_year")
        .select(
            key, "fiscal_year", "source_file", "quarter", "submitted", "certified", "withdrawn",
            "denied", "certified_workers", "wage_rows", *QUARTILES, *levels, "h1b_dependent",
            "willful_violator",
        )
    )


def entity_year_role(cases: DataFrame, key: str = "employer_id") -> DataFrame:
    """Certified stats per entity, year and role, from the year before the latest on."""
    keys = [key, "fiscal_year", "role_group"]
    years = cases.select("fiscal_year").distinct()
    latest = years.agg(F.max("fiscal_year").alias("last")).select(F.explode(F.array("last", F.col("last") - 1)).alias("fiscal_year"))
    pay = pay_counts()
    # Two years of certified cases and the columns used, written once for the three passes below.
    recent = cut_lineage(
        cases.where(certified())
        .join(F.broadcast(latest), "fiscal_year", "left_semi")  # two rows
        .select(*keys, "level", "wage_annual", "pw_annual", "pw_valid", "full_time", "wage_valid", "case_status")
    )
    counts = recent.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("int").alias("certified"),
        count_where(F.col("level") == "I").alias("level_i"),
        count_where(F.col("level") == "II").alias("level_ii"),
    )
    offered = exact_percentiles(
        recent.where(pay), keys, F.col("wage_annual"), QUARTILES, "wage_rows", PAY_BAND
    )
    prevailing = exact_percentiles(
        recent.where(pay & F.col("pw_valid")), keys, F.col("pw_annual"), {"pw_median": 0.5},
        "pw_rows", PAY_BAND,
    )
    return (
        counts.join(offered, keys, "left")
        .join(prevailing, keys, "left")
        .withColumn("wage_rows", F.coalesce("wage_rows", F.lit(0)))
        .withColumn("pw_rows", F.coalesce("pw_rows", F.lit(0)))
        .select(
            *keys, "certified", "level_i", "level_ii", "wage_rows", *QUARTILES, "pw_rows",
            "pw_median",
        )
    )


def top_values(
    cases: DataFrame, key: str = "employer_id", n: int = 5, kinds: dict[str, Column] | None = None
) -> DataFrame:
    """The `n` most frequent values per entity and kind in its latest certified year."""
    kinds = kinds or {"title": F.upper(F.col("job_title")), "state": F.col("worksite_state")}
    each = F.explode(
        F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("string").alias("value")) for k, v in kinds.items()])
    )
    chosen = cases.where(certified())
    latest = chosen.groupBy(key).agg(F.max("fiscal_year").alias("fiscal_year"))
    # Count first: the join then carries one row per value instead of one per case.
    counted = (
        chosen.select(key, "fiscal_year", each.alias("_v"))
        .select(key, "fiscal_year", "_v.kind", "_v.value")
        .where(F.col("value").isNotNull())
        .groupBy(key, "fiscal_year", "kind", "value")
        .agg(F.count(F.lit(1)).cast("int").alias("certified"))
        .join(latest, [key, "fiscal_year"], "left_semi")
    )
    return best_per_key(
        counted, [key, "fiscal_year", "kind"], [F.desc("certified"), F.asc("value")], n, "rank"
    ).select(key, "fiscal_year", "kind", "value", "certified", "rank")


def fact_cube(cases: DataFrame, key: str = "employer_id") -> DataFrame:
    """Certified counts and pay sums per entity, year, role, worksite state and level."""
    pay = pay_counts()
    return (
        cases.where(certified())
        .groupBy(
            key,
            "fiscal_year",
            "role_group",
            F.coalesce("worksite_state", F.lit(fixed.MISSING_STATE)).alias("worksite_state"),
            F.col("level").alias("wage_level"),
        )
        .agg(
            F.count(F.lit(1)).cast("int").alias("certified"),
            count_where(pay).alias("wage_rows"),
            exact_sum(F.when(pay, F.col("wage_annual"))).alias("wage_sum"),
        )
    )


def entry_signal(
    cases: DataFrame,
    registry_year: DataFrame,
    key: str = "employer_id",
    selection: tuple[str, list[str]] = fixed.ENTRY_SELECTION,
) -> DataFrame:
    """Entry-level share parts over the last two distinct years, with the registry's initial
    approvals for the same years, which are unknown unless every one of them is loaded."""
    name, roles = selection
    last2 = last_years(cases)
    years = last2.agg(
        F.concat_ws("-", F.min("fiscal_year"), F.max("fiscal_year")).alias("years"),
        F.count(F.lit(1)).alias("_wanted"),
    )
    loaded = (
        registry_year.select("fiscal_year")
        .distinct()
        .join(last2, "fiscal_year", "left_semi")
        .agg(F.count(F.lit(1)).alias("_loaded"))
    )
    entry = F.col("role_group").isin(*roles) & F.col("level").isin(*fixed.ENTRY_LEVELS)
    signal = (
        cases.where(certified())
        .join(F.broadcast(last2), "fiscal_year", "left_semi")  # two rows
        .groupBy(key)
        .agg(count_where(entry).alias("entry_lcas"), F.count(F.lit(1)).cast("int").alias("certified_all"))
    )
    initial = (
        registry_year.join(F.broadcast(last2), "fiscal_year", "left_semi")
        .groupBy(key)
        .agg(F.sum("initial_approvals").alias("_initial"))
    )
    complete = F.col("_loaded") == F.col("_wanted")
    return (
        signal.join(initial, key, "left")
        .crossJoin(F.broadcast(years.crossJoin(loaded)))  # one row
        .select(
            key,
            F.lit(name).alias("role_selection"),
            "years",
            "entry_lcas",
            "certified_all",
            F.when(complete, F.col("_initial")).cast("int").alias("uscis_initial"),
            complete.alias("uscis_years_loaded"),
        )
    )


def entity_totals(year: DataFrame, key: str = "employer_id") -> DataFrame:
    """Certified total, latest stated dependency flag, and whether a violation was ever stated."""
    stated = F.when(F.col("h1b_dependent").isNotNull(), F.col("fiscal_year"))
    return year.groupBy(key).agg(
        F.sum("certified").cast("int").alias("certified_total"),
        F.max_by("h1b_dependent", stated).alias("h1b_dependent_latest"),
        F.coalesce(F.bool_or("willful_violator"), F.lit(False)).alias("willful_violator_ever"),
    )


def most_frequent(
    df: DataFrame, key: str, value: str, out: str, weight: Column | None = None
) -> DataFrame:
    """Most frequent non-NULL value per key; ties go to the lowest value."""
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(key, F.col(value).alias(out))
        .agg(F.sum(F.lit(1) if weight is None else weight).alias("_n"))
    )
    return best_per_key(counted, [key], [F.desc("_n"), F.asc(out)]).drop("_n")


def employer_table(
    entity: DataFrame,
    cases: DataFrame,
    year: DataFrame,
    registry_year: DataFrame,
    registry_final: DataFrame,
    registry_rows: DataFrame,
) -> DataFrame:
    """Every employer: the case entities, then the registry's own, whose case figures are
    missing and not zero."""
    registry_total = registry_year.groupBy("employer_id").agg(
        F.sum("initial_approvals").cast("int").alias("uscis_initial_total"),
        F.lit(True).alias("_in_registry"),
    )
    ours = (
        entity.join(entity_totals(year), "employer_id", "left")
        .join(registry_total, "employer_id", "left")
        .join(most_frequent(cases, "employer_id", "naics_code", "naics"), "employer_id", "left")
        .select(
            "employer_id", "slug", "display_name", "fein", "city", "state",
            F.lit(True).alias("has_lca"),
            F.coalesce("_in_registry", F.lit(False)).alias("has_uscis"),
            F.col("lca_rows").cast("int").alias("lca_rows"),
            "certified_total", "uscis_initial_total", "h1b_dependent_latest",
            F.coalesce("willful_violator_ever", F.lit(False)).alias("willful_violator_ever"),
            "naics",
        )
    )
    sector = F.nullif(F.regexp_extract("naics", r"^\d+", 0), F.lit(""))
    sectors = most_frequent(
        registry_rows.where(~F.col("matched")).withColumn("_sector", sector),
        "final_id", "_sector", "_naics", F.col("rows"),
    )
    theirs = (
        registry_final.where(~F.col("matched"))
        .select(F.col("final_id").alias("employer_id"), "new_slug", "name", "city", "state")
        .join(registry_total, "employer_id", "left")
        .join(sectors, F.col("employer_id") == F.col("final_id"), "left")
        .select(
            "employer_id",
            F.col("new_slug").alias("slug"),
            F.col("name").alias("display_name"),
            F.lit(None).cast("string").alias("fein"),
            "city",
            "state",
            F.lit(False).alias("has_lca"),
            F.lit(True).alias("has_uscis"),
            F.lit(None).cast("int").alias("lca_rows"),
            F.lit(None).cast("int").alias("certified_total"),
            "uscis_initial_total",
            F.lit(None).cast("boolean").alias("h1b_dependent_latest"),
            F.lit(False).alias("willful_violator_ever"),
            F.col("_naics").alias("naics"),
        )
    )
    return ours.unionByName(theirs)


def alias_table(entity_aliases: DataFrame, registry_rows: DataFrame) -> DataFrame:
    """Spellings from both registries with their source and row counts."""
    ours = entity_aliases.select("employer_id", "name", "norm", F.lit("lca").alias("source"), "rows")
    theirs = registry_rows.groupBy(
        F.col("final_id").alias("employer_id"), F.col("employer_name").alias("name"), "norm"
    ).agg(F.lit("uscis").alias("source"), F.sum("rows").cast("int").alias("rows"))
    return ours.unionByName(theirs)


def pay_exclusions(cases: DataFrame, by: Column, name: str) -> DataFrame:
    """Rows left out of pay statistics, per `by`, and why."""
    pay = F.col("wage_annual")
    return cases.groupBy(by.alias(name)).agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(pay < fixed.PAY_MIN).alias("under_min"),
        F.count_if(pay > fixed.PAY_MAX).alias("over_max"),
        F.count_if(pay.isNull()).alias("unusable"),
        F.count_if(~F.col("wage_valid")).alias("excluded"),
        F.round(F.try_divide(F.count_if(~F.col("wage_valid")).cast("double"), F.count(F.lit(1))), 4).alias("share"),
    )


def pay_exclusion_totals(cases: DataFrame) -> DataFrame:
    """One row over all cases, incl. the excluded salaries submitted under another unit."""
    pay = F.col("wage_annual")
    wrong_unit = ~F.col("wage_valid") & (F.col("wage_unit") != "Year") & (F.col("wage_from") >= fixed.PAY_MIN)
    return cases.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(pay).alias("with_wage"),
        F.count_if(pay < fixed.PAY_MIN).alias("below_min"),
        F.count_if(pay > fixed.PAY_MAX).alias("above_max"),
        F.count_if(pay.isNull()).alias("unusable"),
        F.count_if(wrong_unit).alias("salary_wrong_unit"),
    )


def date_coverage(rows: DataFrame, file: str = "source_file", date: str = "decision_date") -> DataFrame:
    """First and last date per file."""
    return rows.groupBy(file).agg(
        F.min(date).alias("decision_date_min"), F.max(date).alias("decision_date_max")
    )


def site_totals(year: DataFrame, key: str = "employer_id") -> DataFrame:
    """Totals over everything, and how recent the latest year is."""
    totals = year.agg(
        F.sum("submitted").alias("submitted"),
        F.sum("certified").alias("certified"),
        F.count_distinct("fiscal_year").cast("int").alias("years"),
        F.count_distinct(key).alias("employers"),
    )
    latest = (
        year.groupBy("fiscal_year")
        .agg(F.max("quarter").alias("latest_quarter"))
        .orderBy(F.desc("fiscal_year"))
        .limit(1)
        .withColumnRenamed("fiscal_year", "latest_year")
    )
    return totals.crossJoin(latest)  # two one-row tables
