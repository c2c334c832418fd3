"""Cleaning expressions: raw text cell -> typed canonical value. Unusable cells are NULL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry import fixed

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def lookup(key: Column, table: dict) -> Column:
    """Value of `key` in a small constant table; NULL when absent. The table is one literal,
    so the key expression is evaluated once and not once per entry."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), key)


def text(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))


LAST_SERIAL = 2_958_466  # the day after 9999-12-31; larger numbers are no dates


def number(c: Column) -> Column:
    # The guard matters: a bare cast would take '5d' for 5.0.
    return F.when(c.rlike(NUMBER), F.trim(c).try_cast("double"))


def money(c: Column) -> Column:
    return number(F.regexp_replace(F.trim(c), "[$,]", ""))


def whole(c: Column) -> Column:
    """Integer from text; a fraction rounds half away from zero."""
    return F.round(number(c)).try_cast("int")


def serial_date(c: Column) -> Column:
    """Date from a spreadsheet serial number or from ISO text."""
    t = F.trim(c)
    days = F.floor(t.try_cast("double"))
    serial = F.date_add(F.lit("1899-12-30").cast("date"), F.when(days < LAST_SERIAL, days.try_cast("int")))
    iso = F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), F.left(t, F.lit(10)).try_cast("date"))
    return F.when(t.rlike(r"^\d+(\.\d+)?$"), serial).otherwise(iso)


def yes_no(c: Column) -> Column:
    v = F.upper(F.trim(c))
    return F.when(v.isin("Y", "YES"), F.lit(True)).when(v.isin("N", "NO"), F.lit(False))


def tax_id(c: Column) -> Column:
    """`dd-ddddddd` from nine usable digits; placeholders and repeated digits are NULL."""
    d = F.regexp_replace(c, "[^0-9]", "")
    usable = (
        (F.length(d) == 9)
        & ~d.isin(*fixed.PLACEHOLDER_IDS)
        & ~d.rlike(r"^(\d)\1{8}$")
        & ~d.startswith("00")
    )
    return F.when(usable, F.concat_ws("-", F.substring(d, 1, 2), F.substring(d, 3, 7)))


def state_code(c: Column) -> Column:
    v = F.upper(F.nullif(F.trim(c), F.lit("")))
    return F.when(F.length(v) == 2, v).otherwise(lookup(v, fixed.STATE_CODES))


def status(c: Column) -> Column:
    """Canonical status; an unmapped value comes back marked, for the status gate."""
    key = F.upper(F.regexp_replace(F.trim(c), r"\s*-\s*", "-"))
    return F.coalesce(lookup(key, fixed.STATUSES), F.concat(F.lit(fixed.UNKNOWN_PREFIX), key))


def soc_code(c: Column) -> Column:
    pattern = r"(\d{2})-?(\d{4})"
    return F.when(
        c.rlike(pattern),
        F.concat_ws("-", F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2)),
    )


def wage_level(c: Column) -> Column:
    v = F.upper(F.trim(c))
    return F.when(v.isin(*fixed.LEVELS), v)


def upper_text(c: Column) -> Column:
    return F.upper(text(c))


def annualize(value: Column, unit: Column) -> Column:
    """Yearly pay from a rate and its unit; NULL for an unknown unit."""
    u = F.lower(F.replace(F.replace(F.trim(unit), F.lit(" "), F.lit("")), F.lit("_"), F.lit("-")))
    u = F.coalesce(lookup(u, fixed.PAY_UNIT_SYNONYMS), u)
    return value.cast("double") * lookup(u, fixed.PAY_UNITS).cast("double")


def plausible(pay: Column, low: float = fixed.PAY_MIN, high: float = fixed.PAY_MAX) -> Column:
    return F.coalesce(pay.between(low, high), F.lit(False))


def known_parts_sum(*parts: Column) -> Column:
    """Sum of the parts that are known; NULL only when none is."""
    total = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0)) for p in parts])
    return F.when(F.coalesce(*parts).isNotNull(), total)


def separated_int(c: Column) -> Column:
    """Integer from text with thousands separators; a fraction is cut off."""
    return number(F.replace(F.trim(c), F.lit(","), F.lit(""))).try_cast("int")


def tail4(c: Column) -> Column:
    """Last-four id text, zero-filled when shorter and never cut when longer."""
    t = F.nullif(F.trim(c), F.lit(""))
    return F.when(F.length(t) < 4, F.lpad(t, 4, "0")).otherwise(t)
