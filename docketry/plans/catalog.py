"""Publication by name: versions are catalog tables, and one view says which version is current.

Every table of a load is created as `<name>__v<version>` in a database whose folder the caller
names, its rows are counted against the catalog table, and then the view `current_version` is
replaced. Readers resolve names through that view, so all tables of a load switch at once;
tables of earlier versions stay until they are dropped. Column lists come from the catalog.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from docketry.operators.quality import GateError
from docketry.plans.publish import check_types

VIEW = "current_version"
_PLAIN = re.compile("[A-Za-z][A-Za-z0-9_]*")


def _named(database: str, name: str, version: str | None = None) -> str:
    for part in (database, name) + ((version,) if version is not None else ()):
        if not (_PLAIN.fullmatch(part) or part == version and re.fullmatch("[A-Za-z0-9_]+", part)):
            raise ValueError(f"not a plain name: {part!r}")
    return f"`{database}`.`{name}`" if version is None else f"`{database}`.`{name}__v{version}`"


def publish_by_name(tables: dict[str, DataFrame], database: str, root: str, version: str) -> dict[str, int]:
    """Create every table under a new version, check its rows, then switch readers to it."""
    spark = next(iter(tables.values())).sparkSession
    view = _named(database, VIEW)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}` LOCATION '{root}'")
    counts = {}
    for name, df in tables.items():
        check_types(df)
        target = _named(database, name, version)
        seen = Observation(f"rows_{name}")
        out = df.observe(seen, F.count(F.lit(1)).alias("n"))
        out.write.format("parquet").mode("error").option("path", f"{root}/{name}/v={version}").saveAsTable(target)
        counts[name] = spark.table(target).count()
        if counts[name] != seen.get["n"]:
            raise GateError(f"{name}: wrote {seen.get['n']} rows, found {counts[name]}")
    spark.sql(f"CREATE OR REPLACE VIEW {view} AS SELECT '{version}' AS version")
    return counts


def current_name(spark: SparkSession, database: str, name: str) -> str:
    """The catalog name of the current version of a table."""
    view = _named(database, VIEW)
    if not spark.catalog.tableExists(view):
        raise FileNotFoundError(f"nothing published in {database}")
    return _named(database, name, spark.table(view).first().version)


def read_by_name(spark: SparkSession, database: str, name: str) -> DataFrame:
    return spark.table(current_name(spark, database, name))


def catalog_columns(spark: SparkSession, database: str, name: str) -> dict[str, str]:
    """Column -> type of the current version, from the catalog; no data is read."""
    return {c.name: c.dataType for c in spark.catalog.listColumns(current_name(spark, database, name))}


def require_columns(spark: SparkSession, database: str, name: str, needed: list[str]) -> None:
    """A consumer's check before it plans anything: columns the published table lacks are an error."""
    lost = sorted(set(needed) - set(catalog_columns(spark, database, name)))
    if lost:
        raise GateError(f"{database}.{name} has no columns {lost}")


def drop_versions(spark: SparkSession, database: str, keep: list[str]) -> list[str]:
    """Drop the tables of versions that are neither current nor in `keep`; the names dropped.
    Catalog entries only: their files go with `root`, when no reader of an old version is left."""
    kept = {*keep, spark.table(_named(database, VIEW)).first().version}
    gone = [
        t.name
        for t in spark.catalog.listTables(database)
        if "__v" in t.name and t.name.rsplit("__v", 1)[1] not in kept
    ]
    for name in gone:
        spark.sql(f"DROP TABLE `{database}`.`{name}`")
    return sorted(gone)
