"""Incremental arrival of release files: new rows are taken once, and only the fiscal years
they touch are rebuilt.

Arrived rows are kept in an append-only log with one folder per micro-batch; a repeated
batch overwrites its own folder. Latest-wins is associative, so a touched year is its snapshot
before the batch merged with the batch, written to a new folder; then a pointer row names that
folder. No step overwrites what it reads, so a job can be lost anywhere and run again. A row
without a year stops the batch before anything is written.
"""

from __future__ import annotations

import functools

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators.ordering import latest_wins
from docketry.session import cut_lineage


def take_batch(
    batch: DataFrame,
    batch_id: int,
    root: str,
    keys: list[str],
    order: list[Column],
    year: str = "fiscal_year",
) -> None:
    """Log one batch and rebuild the years it touches."""
    spark = batch.sparkSession
    batch = cut_lineage(batch)
    touched = batch.select(year).distinct()
    years = [r[0] for r in touched.collect()]  # fiscal years: few
    if None in years:
        raise ValueError(f"batch {batch_id} has rows without {year}")
    if not years:
        return
    batch.write.mode("overwrite").partitionBy(year).parquet(f"{root}/log/batch={batch_id}")
    rows = batch
    before = _pointers(spark, root, batch_id)
    if before is not None:
        old = _snapshot(spark, root, before, year).where(F.col(year).isin(*years))
        rows = batch.unionByName(old.select(*batch.columns))
    latest = latest_wins(rows, keys, order)
    latest.write.mode("overwrite").partitionBy(year).parquet(f"{root}/snapshot/batch={batch_id}")
    # Only now do readers look at the new folder.
    touched.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(
        f"{root}/pointers/{batch_id}"
    )


def run_arrivals(
    rows: DataFrame, root: str, keys: list[str], order: list[Column], year: str = "fiscal_year"
) -> None:
    """Take everything that has arrived on a stream of canonical rows, then stop."""
    query = (
        rows.writeStream.trigger(availableNow=True)
        .option("checkpointLocation", f"{root}/offsets")
        .foreachBatch(lambda df, n: take_batch(df, n, root, keys, order, year))
        .start()
    )
    query.awaitTermination()


def _pointers(spark: SparkSession, root: str, below: int | None = None) -> DataFrame | None:
    """(year, batch) rows of all batches, or of those before `below`; None if there are none."""
    try:
        rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/pointers")
    except AnalysisException:  # nothing has arrived yet
        return None
    return rows if below is None else rows.where(F.col("batch") < below)


def _snapshot(spark: SparkSession, root: str, pointers: DataFrame, year: str) -> DataFrame:
    rows = spark.read.option("basePath", f"{root}/snapshot").parquet(f"{root}/snapshot")
    # One row per fiscal year, resolved now: a reader does not depend on pointer files that
    # later upkeep merges. Year and batch are folders, so others are not read.
    newest = pointers.groupBy(year).agg(F.max("batch").alias("batch")).collect()
    named = [(F.col(year) == r[year]) & (F.col("batch") == r.batch) for r in newest]
    return rows.where(functools.reduce(Column.__or__, named, F.lit(False))).drop("batch")


def current_rows(spark: SparkSession, root: str, year: str = "fiscal_year") -> DataFrame:
    """The latest complete snapshot of every year."""
    pointers = _pointers(spark, root)
    if pointers is None:
        raise ValueError(f"nothing has arrived at {root}")
    return _snapshot(spark, root, pointers, year)


def year_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Stream of staged canonical files."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(path)
