"""Clustered tables: files that cover separate ranges of a Z-order key, and reads that skip files.

The key interleaves the bits of every column's place among its own quantiles, so rows near
each other in all columns share a file. Files are cut by ranges of (key, columns, row hash):
equal keys may span files, which keeps a hot key from becoming one task, and no two files
overlap in more than an end point. The smallest and largest value of every clustered column is
kept per file beside the data; a read with ranges opens only files that can hold a match.

Columns are numbers, dates or timestamps; NULL sorts first and a file with NULLs says so. A
table without rows has no file ranges and reads as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.session import cut_lineage

BITS = 6  # places per column: 2^BITS quantile ranges
KEY = "_zkey"


def _number(df: DataFrame, name: str) -> Column:
    """Dates as days, timestamps as microseconds, numbers as they are."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    raise TypeError(f"{name}: no order of numbers for {kind.simpleString()}")


def with_zkey(df: DataFrame, columns: list[str], bits: int = BITS) -> DataFrame:
    """Add the interleaved key. One aggregate finds the quantiles: 2^bits numbers a column."""
    if len(columns) * bits > 62:
        raise ValueError(f"{len(columns)} columns of {bits} bits do not fit one key")
    steps = [i / 2**bits for i in range(1, 2**bits)]
    cuts = df.agg(*[F.percentile_approx(_number(df, c), steps).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    key = F.lit(0).cast("bigint")
    for i, c in enumerate(columns):
        bounds = cuts[i] or []  # a hot value's quantiles stay repeated, so the places stay balanced
        mine = _number(df, c)
        passed = F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= mine)  # noqa: B023
        place = F.when(F.col(c).isNull() | F.lit(not bounds), 0).otherwise(F.size(passed)).cast("bigint")
        for bit in range(bits):
            key = key.bitwiseOR(F.shiftleft(F.shiftright(place, bit).bitwiseAND(F.lit(1)), bit * len(columns) + len(columns) - 1 - i))
    return df.withColumn(KEY, key)


def write_clustered(df: DataFrame, path: str, columns: list[str], files: int | None = None) -> None:
    """Write `df` clustered by `columns` to `path`/rows, and its file ranges to `path`/files."""
    spark = df.sparkSession
    # The sampling of range boundaries and the write must see the same rows.
    keyed = cut_lineage(with_zkey(df, columns))
    order = [KEY, *columns, F.xxhash64(*[F.col(c) for c in df.columns])]
    parts = [files] if files else []
    keyed.repartitionByRange(*parts, *order).sortWithinPartitions(KEY, *columns).write.mode("error").parquet(f"{path}/rows")
    rows = spark.read.schema(keyed.schema).parquet(f"{path}/rows")
    ranges = [
        part
        for i, c in enumerate([KEY, *columns])
        for part in (F.min(c).alias(f"low{i}"), F.max(c).alias(f"high{i}"), F.count_if(F.col(c).isNull()).alias(f"nulls{i}"))
    ]
    found = rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows"), *ranges)
    found.write.mode("error").parquet(f"{path}/files")


def file_ranges(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: rows, and low, high and NULL count of the key (0) and each column (1, ...)."""
    return spark.read.parquet(f"{path}/files")


def overlaps(spark: SparkSession, path: str) -> DataFrame:
    """Number of files whose key range reaches into the next one by more than its end point.
    The list of files is one row per file, ordered in one task as the driver lists it too."""
    line = Window.orderBy("low0", "high0")
    before = F.max("high0").over(line.rowsBetween(Window.unboundedPreceding, -1))
    ordered = file_ranges(spark, path).select("low0", before.alias("_before"))
    return ordered.agg(F.count_if(F.col("_before") > F.col("low0")).alias("overlaps"))


def read_clustered(spark: SparkSession, path: str, columns: list[str], within: dict[str, tuple]) -> DataFrame:
    """Rows whose columns lie in the given closed ranges; files that cannot hold one are not opened."""
    rows = spark.read.parquet(f"{path}/rows")
    schema = rows.schema
    can, match = F.lit(True), F.lit(True)
    for name, (low, high) in within.items():
        i = columns.index(name) + 1
        can = can & (F.col(f"high{i}") >= F.lit(low)) & (F.col(f"low{i}") <= F.lit(high))
        match = match & F.col(name).between(F.lit(low), F.lit(high))
    # Names of the files to open, as the driver's own listing would hold them.
    files = [r.file for r in file_ranges(spark, path).where(can).select("file").collect()]
    if not files:
        return rows.where(F.lit(False)).drop(KEY)
    return spark.read.schema(schema).parquet(*files).where(match).drop(KEY)
