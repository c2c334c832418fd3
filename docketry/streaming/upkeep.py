"""Upkeep of arrivals: a bounded number of folders however many batches came.

- The log is merged in levels: `fan` neighbouring runs of one level become one run of the next,
  so a row is rewritten once per level and at most fan - 1 runs of a level stay. A run's folder
  names its level and the batches it covers.
- A snapshot folder goes once neither the current pointers nor those of the `keep` latest
  batches name it. A reader who resolved the pointers before the latest batches still reads.
- Pointer rows older than these are merged into the newest row per year.

Every step writes the new folder whole before it deletes an old one. A run lost on the way has
no success mark and is written again; runs and pointer rows that a merged one covers count
once, so upkeep can stop anywhere and be run again. The `keep` latest batches, which a restarted
stream may send again, are never merged. One upkeep at a time, between batches.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAN, KEEP = 8, 2


class Run(NamedTuple):
    """A folder of the log: batches `first` to `last`; level 0 is one batch."""

    first: int
    last: int
    level: int
    folder: str


def _fs(spark: SparkSession, path: str):
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(sc._jsc.hadoopConfiguration()), sc._jvm.org.apache.hadoop.fs.Path


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at(path)) if s.isDirectory()] if fs.exists(at(path)) else []


def _delete(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at(path), True)


def _folders(spark: SparkSession, root: str) -> list[Run]:
    """All complete folders of the log, those that a merged run covers included."""
    fs, at = _fs(spark, root)
    out = []
    for name in _children(spark, f"{root}/log"):
        kind, _, numbers = name.partition("=")
        if not fs.exists(at(f"{root}/log/{name}/_SUCCESS")):
            continue
        if kind == "batch":
            out.append(Run(int(numbers), int(numbers), 0, name))
        elif kind == "run":
            level, first, last = map(int, numbers.split("-"))
            out.append(Run(first, last, level, name))
    return out


def log_runs(spark: SparkSession, root: str) -> list[Run]:
    """The runs that hold the log, each batch once, in order of batches."""
    out: list[Run] = []
    for run in sorted(_folders(spark, root), key=lambda r: (r.first, -r.last, -r.level)):
        if not out or run.last > out[-1].last:
            out.append(run)
    return out


def logged_rows(spark: SparkSession, root: str) -> DataFrame:
    """Every row that ever arrived, with the `batch` that brought it."""
    runs = log_runs(spark, root)
    if not runs:
        raise ValueError(f"nothing has arrived at {root}")
    return _read(spark, root, runs)


def _read(spark: SparkSession, root: str, runs: list[Run]) -> DataFrame:
    out = None
    for run in runs:
        path = f"{root}/log/{run.folder}"
        rows = spark.read.option("basePath", path).parquet(path)
        if not run.level:
            rows = rows.withColumn("batch", F.lit(run.first))
        out = rows if out is None else out.unionByName(rows)
    return out


def merge_log(spark: SparkSession, root: str, fan: int = FAN, keep: int = KEEP, year: str = "fiscal_year") -> int:
    """Merge runs until no level has `fan` neighbours; the number of merges."""
    if fan < 2:
        raise ValueError("a merge takes two runs at least")
    merges = 0
    while True:
        runs = log_runs(spark, root)
        _drop_covered(spark, root, runs)
        settled = runs[: max(len(runs) - max(keep, 0), 0)]
        windows = [settled[i : i + fan] for i in range(len(settled) - fan + 1)]
        group = next((w for w in windows if len({r.level for r in w}) == 1), None)
        if group is None:
            return merges
        name = f"run={group[0].level + 1}-{group[0].first}-{group[-1].last}"
        # By year and a row hash: a year that holds most rows is many tasks' work.
        rows = _read(spark, root, group)
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(16))
        rows.repartition(year, salt).write.mode("overwrite").partitionBy(year).parquet(f"{root}/log/{name}")
        merges += 1


def _drop_covered(spark: SparkSession, root: str, runs: list[Run]) -> None:
    held = {r.folder for r in runs}
    for run in _folders(spark, root):
        if run.folder not in held:
            _delete(spark, f"{root}/log/{run.folder}")


def retire_snapshots(spark: SparkSession, root: str, keep: int = KEEP, year: str = "fiscal_year") -> list[int]:
    """Delete snapshots that no pointer of the `keep` latest batches needs, and merge the pointers
    before; the batches whose snapshots went. Two are kept at least: the last batch may come again."""
    schema = f"{year} int, batch int"
    names = _children(spark, f"{root}/pointers")
    if not names:
        return []
    read = spark.read.schema(schema).option("recursiveFileLookup", "true")
    batches = sorted(r.batch for r in read.parquet(f"{root}/pointers").select("batch").distinct().collect())
    latest = batches[-max(keep, 2) :]
    pointers = read.parquet(f"{root}/pointers")
    needed: set[int] = set()
    for state in latest:  # at most one folder per year and state
        newest = pointers.where(F.col("batch") <= state).groupBy(year).agg(F.max("batch").alias("batch"))
        needed |= {r.batch for r in newest.select("batch").distinct().collect()}
    old = [n for n in names if n.startswith("merged-") or int(n) < latest[0]]
    if len(old) > 1:
        # Rows of years are few; the name holds the last batch, so a rerun writes the same folder.
        before = read.parquet(*[f"{root}/pointers/{n}" for n in old]).groupBy(year).agg(F.max("batch").alias("batch"))
        last = max(int(n.removeprefix("merged-")) for n in old)
        target = f"merged-{last}"
        if target not in old:
            before.coalesce(1).write.mode("overwrite").parquet(f"{root}/pointers/{target}")
        for name in old:
            if name != target:
                _delete(spark, f"{root}/pointers/{name}")
    gone = []
    for name in _children(spark, f"{root}/snapshot"):
        batch = int(name.partition("=")[2])
        if batch not in needed and batch <= latest[-1]:
            _delete(spark, f"{root}/snapshot/{name}")
            gone.append(batch)
    return sorted(gone)


def upkeep(spark: SparkSession, root: str, fan: int = FAN, keep: int = KEEP, year: str = "fiscal_year") -> None:
    """Merge the log and retire snapshots; run it between batches."""
    merge_log(spark, root, fan, keep, year)
    retire_snapshots(spark, root, keep, year)
