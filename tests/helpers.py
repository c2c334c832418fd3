"""Small helpers for expression tests."""

from pyspark.sql import functions as F


def evaluate(spark, fn, values, kind="string"):
    """fn(column) over a list of values, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.coalesce(1).orderBy("i").select(fn(F.col("v"))).collect()]


def rows(df, *order):
    """Rows as tuples, sorted."""
    out = [tuple(r) for r in df.collect()]
    return sorted(out, key=lambda r: tuple((x is None, x) for x in r))
