import datetime as dt

from helpers import evaluate
from pyspark.sql import functions as F

from docketry.functions import clean, rules


def test_text_collapses_and_blanks_are_missing(spark):
    got = evaluate(spark, clean.text, ["  a \t b\n", "   ", "", None])
    assert got == ["a b", None, None, None]


def test_money(spark):
    got = evaluate(spark, clean.money, ["$1,234.5", "62725", " 7 ", "5d", "abc", "", None])
    assert got == [1234.5, 62725.0, 7.0, None, None, None, None]


def test_whole_rounds_and_rejects_text(spark):
    assert evaluate(spark, clean.whole, ["1.5", "2", "-1.5", "x"]) == [2, 2, -2, None]


def test_dates_from_serials_and_text(spark):
    values = ["45839", "45839.75", "2025-07-01", "2025-07-01 10:00:00", "2024", "N/A", None]
    day = dt.date(2025, 7, 1)
    # '2024' is digits only, so it is a serial, as every digits-only cell is.
    assert evaluate(spark, clean.serial_date, values) == [
        day, day, day, day, dt.date(1905, 7, 16), None, None,
    ]


def test_flags(spark):
    got = evaluate(spark, clean.yes_no, ["Y", "Yes", " no ", "N", "N/A", None])
    assert got == [True, True, False, False, None, None]


def test_tax_ids(spark):
    values = ["39-0989781", "390989781", "12-3456789", "111111111", "00-1234567", "12345", "98 765 4321", None]
    assert evaluate(spark, clean.tax_id, values) == ["39-0989781"] * 2 + [None] * 6


def test_states(spark):
    got = evaluate(spark, clean.state_code, ["mn", "Minnesota ", "ZZ", "Atlantis", " ", None])
    assert got == ["MN", "MN", "ZZ", None, None, None]


def test_status(spark):
    got = evaluate(spark, clean.status, [" certified ", "Certified  -Withdrawn", "denied", "Pending"])
    assert got == ["Certified", "Certified - Withdrawn", "Denied", "UNKNOWN:PENDING"]


def test_codes_and_levels(spark):
    assert evaluate(spark, clean.soc_code, ["19-2012.00", "151252", "x", None]) == ["19-2012", "15-1252", None, None]
    assert evaluate(spark, clean.wage_level, [" iv", "V", None]) == ["IV", None, None]
    assert evaluate(spark, clean.tail4, ["42", "12345", " ", None]) == ["0042", "12345", None, None]


def test_role_groups(spark):
    codes = ["15-1252", "15-1253", "17-2999", "13-2011", "15-2031", "15-1299", "15-2051", "11-1111", None]
    assert evaluate(spark, rules.role_group, codes) == [
        "Software engineering", "Software engineering", "Engineering", "Finance",
        "Quant and actuarial", "IT and systems", "Data and analytics", "Other", "Other",
    ]


def test_annualize_and_plausible(spark):
    pay = [(120000.0, "Year"), (10000.0, "Month"), (4000.0, "Bi-Weekly"), (2000.0, "Week"),
           (50.0, " hour "), (4000.0, "BiWeekly"), (4000.0, "bi_weekly"), (None, "Year"),
           (1.0, None), (1.0, "Fortnight")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pay)], "i int, v double, u string")
    got = [r[0] for r in df.orderBy("i").select(clean.annualize(F.col("v"), F.col("u"))).collect()]
    assert got == [120000, 120000, 104000, 104000, 104000, 104000, 104000, None, None, None]
    edge = evaluate(spark, clean.plausible, [15000.0, 14999.99, 1000000.0, 1000000.01, None], "double")
    assert edge == [True, False, True, False, False]


def test_known_parts_sum(spark):
    df = spark.createDataFrame([(1, None), (None, None), (2, 3)], "a int, b int")
    got = [r[0] for r in df.select(clean.known_parts_sum(F.col("a"), F.col("b"))).collect()]
    assert got == [1, None, 5]


def test_separated_int(spark):
    assert evaluate(spark, clean.separated_int, ["1,200", "3.9", "", "x", None]) == [1200, 3, None, None, None]


def test_exempt_rule_order(spark):
    register = spark.createDataFrame(
        [("11-1111111", "03", "B42"), ("22-2222222", "04", "B42"), ("33-3333333", "03", "A01")],
        "fein string, subsection string, ntee string",
    )
    emp = spark.createDataFrame(
        [(1, "Acme", "541511", "11-1111111"), (2, "Acme", "611310", "22-2222222"),
         (3, "State University", "622110", None), (4, "Universityville Co", "611110", "33-3333333"),
         (5, "State University", "541511", None), (6, "Tech Medical School", "611110", None)],
        "i int, display_name string, naics string, fein string",
    )
    got = {r.i: r.cap_exempt_rule for r in rules.with_exempt_rule(emp, register).collect()}
    assert got == {1: "irs_nonprofit", 2: "naics_611310", 3: "name_higher_ed", 4: None, 5: None, 6: "name_higher_ed"}
