"""Computed once: a column the optimizer does not copy into the filters above it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add `value` as a generated column.

    A filter on a plain projected column is pushed below the projection, and through a
    grouping too, and takes a copy of the expression along: a costly name expression would
    run again on every raw row under the grouping. A generator's output stays where it is.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
