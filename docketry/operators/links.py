"""Different ids that share a name: recorded, never merged.

All pairs inside a name are quadratic in the name's ids. The record kept here is linear: one
row per member with its group's size, from which the pair count and the partners of any
given entity follow exactly. Pairs themselves are never listed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def link_members(
    rows: DataFrame, group: str = "norm", ident: str = "fein", entity: str = "employer_id"
) -> DataFrame:
    """Members of every group that holds at least two ids, with the group's pair count."""
    members = (
        rows.where(F.col(ident).isNotNull() & (F.col(group) != ""))
        .select(group, ident, entity)
        .distinct()
    )
    sizes = (
        members.groupBy(group)
        .agg(F.count(F.lit(1)).alias("group_size"))
        .where(F.col("group_size") > 1)
        .withColumn(
            "group_pairs", (F.col("group_size") * (F.col("group_size") - 1) / 2).cast("bigint")
        )
    )
    return members.join(sizes, group)


def partners_of(
    members: DataFrame, asked: DataFrame, group: str = "norm", entity: str = "employer_id"
) -> DataFrame:
    """Partners of the asked entities: (entity, partner, group), from the member rows."""
    mine = members.join(asked.select(entity).distinct(), entity).select(
        F.col(entity).alias("asked_id"), group
    )
    return (
        mine.join(members.select(group, entity), group)
        .where(F.col(entity) != F.col("asked_id"))
        .select("asked_id", F.col(entity).alias("partner_id"), group)
        .distinct()
    )
