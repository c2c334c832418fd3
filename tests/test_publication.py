"""Clustered tables and tables published by name."""

import datetime as dt
import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from docketry.operators.quality import GateError
from docketry.plans import catalog, clustering


def test_clustered_files_do_not_overlap_and_reads_skip_them(spark, tmp_path):
    """A third of the rows share one key; some values are NULL; any box reads as a filter does."""
    rnd = random.Random(7)
    day = dt.date(2020, 1, 1)
    data = [
        (i, 5 if i % 3 == 0 else rnd.choice([None, rnd.randrange(-50, 50)]), day + dt.timedelta(rnd.randrange(400)), rnd.random())
        for i in range(3000)
    ]
    df = spark.createDataFrame(data, "i int, k int, d date, v double").repartition(5)
    columns = ["k", "d", "v"]
    path = str(tmp_path / "t")
    clustering.write_clustered(df, path, columns, files=12)
    ranges = clustering.file_ranges(spark, path)
    assert clustering.overlaps(spark, path).first()[0] == 0
    assert ranges.agg(F.sum("rows"), F.sum("nulls1")).first()[:] == (3000, sum(r[1] is None for r in data))
    # The hot key's rows are many files' work.
    assert ranges.where("low1 <= 5 AND high1 >= 5").count() > 1 and ranges.agg(F.max("rows")).first()[0] < 1000
    late = day + dt.timedelta(380)
    for within in [{"k": (5, 5)}, {"d": (late, late)}, {"k": (-50, -40), "d": (day, late)}, {"v": (0.5, 0.51)}, {"k": (60, 70)}, {}]:
        got = clustering.read_clustered(spark, path, columns, within)
        assert got.columns == df.columns
        want = [r for r in data if all(r[df.columns.index(c)] is not None and a <= r[df.columns.index(c)] <= b for c, (a, b) in within.items())]
        assert [r[0] for r in rows(got)] == [r[0] for r in want]
    assert len(clustering.read_clustered(spark, path, columns, {"k": (-50, -40)}).inputFiles()) < ranges.count()


def test_clustered_edge_cases(spark, tmp_path):
    empty = spark.createDataFrame([], "k int, d date")
    clustering.write_clustered(empty, str(tmp_path / "e"), ["k", "d"])
    assert clustering.read_clustered(spark, str(tmp_path / "e"), ["k", "d"], {"k": (0, 9)}).count() == 0
    assert clustering.overlaps(spark, str(tmp_path / "e")).first()[0] == 0
    nulls = spark.createDataFrame([(None, None)] * 3, "k int, d timestamp")
    clustering.write_clustered(nulls, str(tmp_path / "n"), ["k", "d"])
    assert clustering.read_clustered(spark, str(tmp_path / "n"), ["k", "d"], {}).count() == 3
    assert clustering.read_clustered(spark, str(tmp_path / "n"), ["k", "d"], {"k": (0, 9)}).count() == 0
    with pytest.raises(TypeError):
        clustering.with_zkey(spark.createDataFrame([("a",)], "s string"), ["s"])
    with pytest.raises(ValueError):
        clustering.with_zkey(empty, ["k"] * 11)


def test_names_switch_together_and_a_failed_load_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "db")
    one, two = spark.range(5), spark.range(7).withColumn("x", F.lit("y"))
    with pytest.raises(FileNotFoundError):
        catalog.read_by_name(spark, "load_t", "a")
    assert catalog.publish_by_name({"a": one, "b": one}, "load_t", root, "1") == {"a": 5, "b": 5}
    reader = catalog.read_by_name(spark, "load_t", "a")
    broken = two.withColumn("x", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        catalog.publish_by_name({"a": two, "b": broken}, "load_t", root, "2")
    assert catalog.read_by_name(spark, "load_t", "a").count() == 5
    catalog.publish_by_name({"a": two, "b": two}, "load_t", root, "3")
    assert [catalog.read_by_name(spark, "load_t", n).count() for n in "ab"] == [7, 7]
    assert reader.count() == 5  # a reader of the old version is not broken
    assert catalog.catalog_columns(spark, "load_t", "b") == {"id": "bigint", "x": "string"}
    catalog.require_columns(spark, "load_t", "b", ["x", "id"])
    with pytest.raises(GateError, match="'z'"):
        catalog.require_columns(spark, "load_t", "b", ["x", "z"])
    assert "a__v1" in catalog.drop_versions(spark, "load_t", keep=["2"])
    assert reader.count() == 5 and catalog.read_by_name(spark, "load_t", "a").count() == 7
    for bad in ["a; drop", "a`", "", "1a"]:
        with pytest.raises(ValueError):
            catalog.publish_by_name({bad: one}, "load_t", root, "4")
    with pytest.raises(ValueError):
        catalog.publish_by_name({"a": one}, "load_t", root, "4' --")
