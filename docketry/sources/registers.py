"""Small outside registers: exempt organizations and the curated group map."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry import fixed


def read_exempt_register(spark: SparkSession, path: str) -> DataFrame:
    """(fein, subsection, ntee) of the register extracts; rows without nine digits drop out."""
    raw = spark.read.options(header=True, inferSchema=False).csv(path)
    digits = F.regexp_replace("EIN", "[^0-9]", "")

    def cell(c: str):
        return F.coalesce(F.trim(F.col(c)), F.lit(""))

    return raw.where(F.length(digits) == 9).select(
        F.concat_ws("-", F.substring(digits, 1, 2), F.substring(digits, 3, 7)).alias("fein"),
        cell("SUBSECTION").alias("subsection"),
        cell("NTEE_CD").alias("ntee"),
    )


def empty_exempt_register(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "fein string, subsection string, ntee string")


def read_group_map(spark: SparkSession, path: str) -> DataFrame:
    """The curated map. Spark compares the header with the schema and fails on a difference."""
    schema = ", ".join(f"{c} string" for c in fixed.GROUP_COLUMNS)
    return spark.read.options(header=True, enforceSchema=False).schema(schema).csv(path)
