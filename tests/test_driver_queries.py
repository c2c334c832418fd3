"""Every registered query against DuckDB on the given tables: same columns, same rows."""

import datetime as dt
import decimal
import os

import pytest

import __spark_entry__ as driver
from docketry.plans.registered.everything import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{file}'")
    yield con
    con.close()


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return repr(round(float(v), 6) + 0.0)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return str(v)


def table(columns, records):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in records)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = driver.queries()[name](spark, SF_DIR)
    got = table(df.columns, df.collect())
    sql = driver.oracle_sql().get(name)
    if sql is None:
        assert got[1]
        return
    out = duck.execute(sql)
    assert got == table([c[0] for c in out.description], out.fetchall())


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_only_file_inventories_have_no_sql():
    assert set(QUERIES) - set(driver.oracle_sql()) == {"file_inventory", "change_detection"}
    assert set(QUERIES) <= set(driver.queries())


@pytest.mark.parametrize("name", ["dedup_latest", "top5_per_entity_latest_year", "similar_entities", "first_aliases"])
def test_top_rows_are_pruned_before_the_shuffle(spark, name):
    plan = driver.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("name", ["fact_cube", "entity_latest_flag", "registry_year_sums", "wage_exclusions_by_year"])
def test_plans_prune_columns_and_combine_first(spark, name):
    plan = driver.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "partial_" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
