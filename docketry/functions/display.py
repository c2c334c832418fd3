"""Display scalars. A missing figure is shown as missing and never as zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry import fixed
from docketry.functions.names import normalize_name


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, halves rounded up; NULL when a side is missing or the whole is not positive."""
    return F.when(
        (whole > 0) & part.isNotNull(),
        F.floor(F.lit(100.0) * part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)) + 0.5).cast("int"),
    )


def percent_text(part: Column, whole: Column) -> Column:
    return F.coalesce(F.concat(percent(part, whole).cast("string"), F.lit("%")), F.lit(fixed.MISSING_TEXT))


def int_text(c: Column) -> Column:
    return F.coalesce(F.format_number(c, 0), F.lit(fixed.MISSING_TEXT))


def usd_text(c: Column) -> Column:
    rounded = F.floor(c.cast("double") + 0.5)
    return F.coalesce(F.concat(F.lit("$"), F.format_number(rounded, 0)), F.lit(fixed.MISSING_TEXT))


def compact_text(c: Column) -> Column:
    """1234567 -> 1.2M; at most one decimal, none when it would be zero."""
    x = c.cast("double")

    def short(scale: float, unit: str) -> Column:
        scaled = F.round(x / scale, 1)
        return F.concat(F.regexp_replace(F.format_number(scaled, 1), r"\.0$", ""), F.lit(unit))

    size = F.abs(x)
    out = (
        F.when(size >= 999_950_000, short(1e9, "B"))
        .when(size >= 999_950, short(1e6, "M"))
        .when(size >= 999.95, short(1e3, "K"))
        .when(x.isNotNull(), short(1.0, ""))
    )
    return F.coalesce(out, F.lit(fixed.MISSING_TEXT))


def fiscal_year(date: Column) -> Column:
    """Year FY runs from 1 October of FY-1 to 30 September of FY."""
    return F.year(date) + F.when(F.month(date) >= 10, 1).otherwise(0)


def fiscal_quarter(date: Column) -> Column:
    return F.floor(((F.month(date) + 2) % 12) / 3).cast("int") + 1


def quarter_end(fy: Column, quarter: Column) -> Column:
    """Last day covered by a release; quarters outside 1..4 are clamped."""
    q = F.least(F.greatest(quarter, F.lit(1)), F.lit(4))
    return F.date_sub(F.add_months(F.make_date(fy - 1, F.lit(10), F.lit(1)), q * 3), 1)


def long_date(date: Column) -> Column:
    return F.date_format(date, "MMMM d, yyyy")


def is_partial_year(quarter: Column) -> Column:
    return F.coalesce(quarter, F.lit(4)) < 4


def _one_label(f: Column) -> Column:
    release = r"FY_?(\d{4})_(Q[\d-Q]+)"
    return (
        F.when(
            f.startswith("h1b_datahubexport") | f.startswith("uscis_hub"),
            F.concat(F.lit("USCIS Data Hub FY"), F.regexp_extract(f, r"(\d{4})", 1)),
        )
        .when(
            f.rlike(release),
            F.concat_ws(
                " ",
                F.concat(F.lit("DOL LCA FY"), F.regexp_extract(f, release, 1)),
                F.regexp_extract(f, release, 2),
            ),
        )
        .otherwise(f)
    )


def source_label(f: Column) -> Column:
    """Short label of a source file name, or of several joined with ' + '."""
    many = F.array_join(F.transform(F.split(f, r" \+ "), _one_label), " + ")
    return F.when(
        f.contains(" + "), F.replace(many, F.lit(" + DOL LCA"), F.lit(" +"))
    ).otherwise(_one_label(f))


def alias_note(display: Column, alias: Column) -> Column:
    """The matched alias, unless it is just another spelling of the display name."""
    return F.when(
        (alias != "") & (normalize_name(alias) != normalize_name(display)), alias
    )


def guard_formula(c: Column) -> Column:
    """Text a spreadsheet would take for a formula gets a leading apostrophe."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)
