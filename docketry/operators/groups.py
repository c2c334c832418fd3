"""Curated groups of entities: checked, joined, and the misfits reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry import fixed


def group_violations(mapping: DataFrame) -> DataFrame:
    """(fein, group_slug, problem) for every rule a mapping row breaks; empty when sound."""

    def breaks(cond: Column, problem: str) -> Column:
        return F.when(F.coalesce(cond, F.lit(True)), F.lit(problem))

    evidence = (
        F.col("evidence_url").startswith("https://")
        & (F.coalesce("reviewed_by", F.lit("")) != "")
        & (F.coalesce("reviewed_on", F.lit("")) != "")
    )
    rules = F.array(
        breaks(~F.col("status").isin(*fixed.GROUP_STATUSES), "status"),
        breaks(~F.col("fein").rlike(r"^\d{2}-\d{7}$"), "fein"),
        breaks(~F.col("group_slug").rlike("^[a-z0-9]+(-[a-z0-9]+)*$"), "group_slug"),
        breaks((F.col("status") == "reviewed") & ~F.coalesce(evidence, F.lit(False)), "evidence"),
    )
    broken = mapping.select(
        "fein", "group_slug", F.explode(F.filter(rules, lambda p: p.isNotNull())).alias("problem")
    )
    repeated = (
        mapping.groupBy("fein")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("group_slug").alias("group_slug"))
        .where(F.col("_n") > 1)
        .select("fein", "group_slug", F.lit("fein_repeated").alias("problem"))
    )
    return broken.unionByName(repeated)


def check_groups(mapping: DataFrame) -> DataFrame:
    """The mapping itself, or an error naming the first broken rows."""
    bad = group_violations(mapping).limit(20).collect()
    if bad:
        raise ValueError("group map: " + "; ".join(f"{r.fein} {r.problem}" for r in bad))
    return mapping


def group_members(mapping: DataFrame, entity: DataFrame) -> DataFrame:
    """Reviewed members that are known entities, of groups that keep at least two."""
    members = mapping.where(F.col("status") == "reviewed").join(
        entity.select("fein", "employer_id"), "fein"
    )
    # Sizes come from a grouped count, not a window: a large group stays spread out.
    real = (
        members.groupBy("group_slug").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 2)
    )
    return members.join(real, "group_slug", "left_semi").select(
        "group_slug", "group_name", "employer_id", "fein", "evidence_url", "reviewed_on", "note"
    )


def unknown_members(mapping: DataFrame, entity: DataFrame) -> DataFrame:
    """Reviewed ids that no entity has."""
    known = entity.where(F.col("fein").isNotNull()).select("fein")
    return (
        mapping.where(F.col("status") == "reviewed")
        .select("fein")
        .join(known, "fein", "left_anti")
        .distinct()
    )
