import datetime as dt

from helpers import evaluate
from pyspark.sql import functions as F

from docketry.functions import display as d


def test_numbers_keep_missing_missing(spark):
    assert evaluate(spark, d.int_text, [1234567.0, 0.0, None], "double") == ["1,234,567", "0", "–"]
    assert evaluate(spark, d.usd_text, [98765.4, 120000.0, None], "double") == ["$98,765", "$120,000", "–"]
    assert evaluate(spark, d.compact_text, [2136934.0, 12900.0, 999.0, 1000.0, None], "double") == [
        "2.1M", "12.9K", "999", "1K", "–",
    ]


def test_percent(spark):
    df = spark.createDataFrame([(1, 3), (0, 10), (None, 10), (5, None), (0, 0)], "p int, w int")
    got = [r[0] for r in df.select(d.percent_text(F.col("p"), F.col("w"))).collect()]
    assert got == ["33%", "0%", "–", "–", "–"]


def test_quarters(spark):
    df = spark.createDataFrame([(2026, 1), (2026, 2), (2026, 3), (2025, 4), (2025, 9)], "fy int, q int")
    end = d.quarter_end(F.col("fy"), F.col("q"))
    assert [r[0] for r in df.select(d.long_date(end)).collect()] == [
        "December 31, 2025", "March 31, 2026", "June 30, 2026", "September 30, 2025", "September 30, 2025",
    ]
    days = spark.createDataFrame([(dt.date(2024, 9, 30),), (dt.date(2024, 10, 1),)], "x date")
    got = [tuple(r) for r in days.select(d.fiscal_year(F.col("x")), d.fiscal_quarter(F.col("x"))).collect()]
    assert got == [(2024, 4), (2025, 1)]


def test_source_labels(spark):
    cases = {
        "LCA_Disclosure_Data_FY2025_Q1-Q4": "DOL LCA FY2025 Q1-Q4",
        "LCA_Worksites_FY_2026_Q3.xlsx": "DOL LCA FY2026 Q3",
        "h1b_datahubexport-2023.csv": "USCIS Data Hub FY2023",
        "LCA_Disclosure_Data_FY2025_Q1-Q4 + LCA_Disclosure_Data_FY2026_Q3.xlsx": "DOL LCA FY2025 Q1-Q4 + FY2026 Q3",
        "something_else.csv": "something_else.csv",
    }
    assert evaluate(spark, d.source_label, list(cases)) == list(cases.values())


def test_alias_note_and_guard(spark):
    df = spark.createDataFrame([("Amazon Web Services, Inc.", "AMAZON WEB SERVICES INC"), ("Acme", "Acme Labs"), ("Acme", None)], "a string, b string")
    assert [r[0] for r in df.select(d.alias_note(F.col("a"), F.col("b"))).collect()] == [None, "Acme Labs", None]
    assert evaluate(spark, d.guard_formula, ["=H(1)", "@S", "-5", "ok", None]) == ["'=H(1)", "'@S", "'-5", "ok", None]
