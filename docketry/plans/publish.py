"""Publication: all tables of a load appear at once, or not at all.

A load is written under its own version folder, its row counts are checked against what was
written, and then one pointer file is replaced. Readers resolve every table through the
pointer, so they see the old load or the new one and never a mix.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry import fixed
from docketry.operators.quality import GateError

POINTER = "_CURRENT"


class UnsupportedType(TypeError):
    """A column type the publication has no mapping for."""


# --- Fixed values: column type -> relational column type -----------------------------------
SQL_TYPES = {
    "tinyint": "smallint",
    "smallint": "smallint",
    "int": "integer",
    "bigint": "bigint",
    "float": "real",
    "double": "double precision",
    "string": "text",
    "boolean": "boolean",
    "date": "date",
    "timestamp_ntz": "timestamp",
    "timestamp": "timestamptz",
}


def sql_type(kind: T.DataType) -> str:
    """Relational type of a column; an unknown type fails rather than being guessed."""
    if isinstance(kind, T.DecimalType):
        return f"numeric({kind.precision},{kind.scale})"
    if isinstance(kind, T.ArrayType):
        return sql_type(kind.elementType) + "[]"
    name = kind.simpleString()
    if name not in SQL_TYPES:
        raise UnsupportedType(f"no relational type for {name}")
    return SQL_TYPES[name]


def check_types(df: DataFrame) -> dict[str, str]:
    return {f.name: sql_type(f.dataType) for f in df.schema}


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def current_version(spark: SparkSession, root: str) -> str | None:
    """The version readers see; None before the first publication."""
    fs, jvm = _fs(spark, root)
    pointer = jvm.org.apache.hadoop.fs.Path(f"{root}/{POINTER}")
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        return bytes(stream.readAllBytes()).decode().strip()
    finally:
        stream.close()


def _point(spark: SparkSession, root: str, version: str) -> None:
    """Replace the pointer by one rename that overwrites its target."""
    fs, jvm = _fs(spark, root)
    path = jvm.org.apache.hadoop.fs.Path
    fresh, pointer = path(f"{root}/{POINTER}.{version}"), path(f"{root}/{POINTER}")
    out = fs.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    uri = fresh.toUri() if fresh.toUri().getScheme() else fs.makeQualified(fresh).toUri()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        uri, spark.sparkContext._jsc.hadoopConfiguration()
    )
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(fs.makeQualified(fresh), fs.makeQualified(pointer), options)


def publish(
    tables: dict[str, DataFrame],
    root: str,
    version: str,
    partition_by: dict[str, list[str]] | None = None,
    sort_by: dict[str, list[str]] | None = None,
) -> dict[str, int]:
    """Write every table as a new version, check it, and switch readers over to it.

    Rows are counted while they are written and again in what was written. Any failure
    before the switch leaves the current version as it is.
    """
    from pyspark.sql import Observation

    spark = next(iter(tables.values())).sparkSession
    counts = {}
    for name, df in tables.items():
        check_types(df)
        seen = Observation(f"rows_{name}")
        out = df.observe(seen, F.count(F.lit(1)).alias("n"))
        if name in (sort_by or {}):
            out = out.sortWithinPartitions(*sort_by[name])
        writer = out.write.mode("error")
        if name in (partition_by or {}):
            writer = writer.partitionBy(*partition_by[name])
        target = f"{root}/v={version}/{name}"
        writer.parquet(target)
        counts[name] = spark.read.schema(df.schema).parquet(target).count()
        if counts[name] != seen.get["n"]:
            raise GateError(f"{name}: wrote {seen.get['n']} rows, found {counts[name]}")
    _point(spark, root, version)
    return counts


def read_published(spark: SparkSession, root: str, name: str) -> DataFrame:
    version = current_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"nothing published under {root}")
    return spark.read.parquet(f"{root}/v={version}/{name}")


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str]) -> None:
    """Table to a relational database, in batches, with the mapped column types."""
    types = check_types(df)
    (
        df.write.mode("error")
        .option("createTableColumnTypes", ", ".join(f"`{c}` {t}" for c, t in types.items() if _portable(t)))
        .option("batchsize", fixed.JDBC_BATCH)
        .jdbc(url, table, properties=properties)
    )


def _portable(sql: str) -> bool:
    """Types the option can spell; the dialect's own mapping serves the others."""
    return sql in ("smallint", "integer", "bigint", "boolean", "date") or sql.startswith("numeric")


def sources_table(inventory: DataFrame, releases: DataFrame, coverage: DataFrame, counts: DataFrame) -> DataFrame:
    """Provenance per file: declared facts, hash and size, row counts, date coverage."""
    key = "source_file"
    return (
        releases.join(inventory.withColumnRenamed("file", key), key)
        .join(counts.select(key, "raw_rows", "loaded_rows"), key, "left")
        .join(coverage, key, "left")
        .withColumnRenamed(key, "file")
    )


def years_json(years: list[int]) -> str:
    return json.dumps(years)


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """Ordered CSV parts with headers: a global sort, so reading the parts in name order
    reads the rows in order, and no single task writes everything."""
    df.orderBy(*order).write.mode("overwrite").options(header=True).csv(path)
