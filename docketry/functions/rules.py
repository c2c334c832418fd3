"""Classification rules as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry import fixed


def role_group(soc: Column) -> Column:
    """Role group of a cleaned occupation code; unmatched and missing codes are Other."""
    out = F
    for group, codes in fixed.ROLE_CODES.items():
        out = out.when(soc.isin(*codes), F.lit(group))
    for group, prefixes in fixed.ROLE_PREFIXES.items():
        for prefix in prefixes:
            out = out.when(soc.startswith(prefix), F.lit(group))
    return out.otherwise(F.lit(fixed.OTHER_ROLE))


def exempt_ids(register: DataFrame) -> DataFrame:
    """Distinct ids of the register that make their owner a nonprofit in the rule's sense."""
    return (
        register.where(
            (F.col("subsection") == fixed.EXEMPT_SUBSECTION)
            & F.col("ntee").rlike(fixed.EXEMPT_NTEE)
        )
        .select(F.col("fein").alias("_exempt_id"))
        .distinct()
    )


def with_exempt_rule(
    df: DataFrame,
    register: DataFrame,
    name: str = "display_name",
    naics: str = "naics",
    fein: str = "fein",
    out: str = "cap_exempt_rule",
) -> DataFrame:
    """Add the code of the first eligibility rule that fires, else NULL."""
    marked = df.join(exempt_ids(register), F.col(fein) == F.col("_exempt_id"), "left")
    rule = (
        F.when(F.col("_exempt_id").isNotNull(), F.lit("irs_nonprofit"))
        .when(F.col(naics) == fixed.COLLEGE_NAICS, F.lit("naics_611310"))
        .when(
            F.left(F.col(naics), F.lit(2)).isin(*fixed.EDU_OR_HEALTH_SECTORS)
            & F.upper(F.col(name)).rlike(fixed.COLLEGE_NAME),
            F.lit("name_higher_ed"),
        )
    )
    return marked.withColumn(out, rule).drop("_exempt_id")
