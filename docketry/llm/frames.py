"""Rows carried whole, so that no extra column can clash with a working column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, **keys: str | Column) -> DataFrame:
    """`row` (all columns of `df`) beside the named keys."""
    named = [(col(k) if isinstance(k, str) else k).alias(name) for name, k in keys.items()]
    return df.select(F.struct(*[col(c) for c in df.columns]).alias("row"), *named)


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with underscores in front until no column is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
