"""The shared folder, lineage cuts, and columns computed once."""

import os

from pyspark.sql import functions as F

from docketry.functions.barrier import with_once
from docketry.functions.names import normalize_name
from docketry.session import clear_run, cut_lineage, run_dir, shared_dir


def test_the_named_folder_is_used(spark, shared_folder):
    assert shared_dir(spark) == shared_folder
    cut = cut_lineage(spark.range(10).withColumn("x", F.col("id") * 2))
    assert cut.count() == 10 and cut.columns == ["id", "x"]
    assert all(f.startswith(f"file://{run_dir(spark)}/tables/") for f in cut.inputFiles())


def test_a_run_has_one_folder_that_can_be_cleared(spark, shared_folder, monkeypatch):
    import docketry.session as session

    monkeypatch.setattr(session, "shared_dir", lambda _: f"{shared_folder}/own")
    path = cut_lineage(spark.range(3)).inputFiles()[0].removeprefix("file://")
    assert path.startswith(run_dir(spark)) and os.path.exists(path)
    clear_run(spark)
    assert not os.path.exists(run_dir(spark))


def test_a_costly_column_is_not_pushed_below_the_grouping(spark):
    counted = spark.range(100).groupBy((F.col("id") % 5).cast("string").alias("name")).count()
    named = with_once(counted, "norm", normalize_name(F.col("name"))).where("norm <> ''")
    plan = named._jdf.queryExecution().optimizedPlan().toString()
    assert named.count() == 5
    assert "regexp_replace" not in plan[plan.index("Aggregate") :]
