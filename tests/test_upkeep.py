"""Upkeep of arrivals: bounded folders, the same rows, readers of old pointers, lost steps."""

import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from docketry.streaming import arrivals, upkeep

SCHEMA = "fiscal_year int, k string, q int, x string"


def folders(path):
    return sorted(p.name for p in path.iterdir() if p.is_dir())


def test_many_batches_leave_few_folders_and_the_same_rows(spark, tmp_path):
    rnd, root = random.Random(2), str(tmp_path)
    order, sent, reader = [F.desc("q")], [], None
    for n in range(11):
        # A third of the rows share one year; some years come once and never again.
        data = [(rnd.choice([2020, 2020 + n, 2021]), f"k{rnd.randrange(9)}", n * 100 + i, None if i % 4 else "x") for i in range(12)]
        sent += [(*row, n) for row in data]
        batch = spark.createDataFrame(data, SCHEMA)
        arrivals.take_batch(batch, n, root, ["fiscal_year", "k"], order)
        resolved = arrivals.current_rows(spark, root).select("fiscal_year", "k", "q", "x")
        upkeep.upkeep(spark, root, fan=3, keep=2)
        if reader is not None:
            assert rows(reader) == held  # resolved a batch ago, read after two upkeeps
        best = {}
        for y, k, q, x, _ in sent:
            best[y, k] = max(best.get((y, k), (-1, None)), (q, x), key=lambda v: v[0])
        want = sorted((y, k, q, x) for (y, k), (q, x) in best.items())
        reader, held = resolved, rows(arrivals.current_rows(spark, root).select("fiscal_year", "k", "q", "x"))
        assert [r[:3] for r in held] == [r[:3] for r in want]
        assert len(folders(tmp_path / "log")) <= 2 * 2 + 2 + 1
        assert len(folders(tmp_path / "pointers")) <= 3
    log = upkeep.logged_rows(spark, root).select("fiscal_year", "k", "q", "x", "batch")
    assert rows(log) == sorted(sent, key=lambda r: tuple((x is None, x) for x in r))
    assert max(r.level for r in upkeep.log_runs(spark, root)) == 2
    # The last batch comes again after upkeep: nothing changes.
    arrivals.take_batch(batch, 10, root, ["fiscal_year", "k"], order)
    assert rows(arrivals.current_rows(spark, root).select("fiscal_year", "k", "q", "x")) == held
    assert upkeep.logged_rows(spark, root).count() == len(sent)
    named = arrivals._pointers(spark, root).groupBy("fiscal_year").agg(F.max("batch").alias("b")).select("b").distinct().count()
    assert len(folders(tmp_path / "snapshot")) <= named + 1


def test_upkeep_lost_on_the_way_is_done_again(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    for n in range(5):
        arrivals.take_batch(spark.createDataFrame([(2020, f"k{n}", n, "x")], SCHEMA), n, root, ["fiscal_year", "k"], [F.desc("q")])
    # A run without its success mark is no run.
    (tmp_path / "log/run=1-0-2").mkdir()
    assert [r.folder for r in upkeep.log_runs(spark, root)] == [f"batch={n}" for n in range(5)]
    # Lost after the merged run was written and before the old folders went.
    with monkeypatch.context() as m:
        m.setattr(upkeep, "_delete", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            upkeep.merge_log(spark, root, fan=3)
    assert "batch=0" in folders(tmp_path / "log") and upkeep.logged_rows(spark, root).count() == 5
    upkeep.upkeep(spark, root, fan=3)
    assert folders(tmp_path / "log") == ["batch=3", "batch=4", "run=1-0-2"]
    assert rows(upkeep.logged_rows(spark, root).select("k", "batch")) == [(f"k{n}", n) for n in range(5)]
    assert arrivals.current_rows(spark, root).count() == 5
    upkeep.upkeep(spark, root, fan=3)
    assert folders(tmp_path / "log") == ["batch=3", "batch=4", "run=1-0-2"]


def test_nothing_arrived(spark, tmp_path):
    upkeep.upkeep(spark, str(tmp_path))
    with pytest.raises(ValueError):
        upkeep.logged_rows(spark, str(tmp_path))
    with pytest.raises(ValueError):
        upkeep.merge_log(spark, str(tmp_path), fan=1)
