"""Raw case and worksite rows -> the canonical tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import clean
from docketry.operators.ordering import latest_wins
from docketry.operators.quality import gate, unmapped_statuses
from docketry.sources.releases import Release, header_map, missing_headers

_CASE_TYPES = {
    "case_status": (clean.status, "string"),
    "received_date": (clean.serial_date, "date"),
    "decision_date": (clean.serial_date, "date"),
    "employer_fein": (clean.tax_id, "string"),
    "employer_city": (clean.upper_text, "string"),
    "employer_state": (clean.state_code, "string"),
    "soc_code": (clean.soc_code, "string"),
    "full_time": (clean.yes_no, "boolean"),
    "worksite_city": (clean.upper_text, "string"),
    "worksite_state": (clean.state_code, "string"),
    "wage_from": (clean.money, "double"),
    "wage_to": (clean.money, "double"),
    "prevailing_wage": (clean.money, "double"),
    "pw_wage_level": (clean.wage_level, "string"),
    "h1b_dependent": (clean.yes_no, "boolean"),
    "willful_violator": (clean.yes_no, "boolean"),
    "total_workers": (clean.whole, "int"),
    "worksite_workers": (clean.whole, "int"),
}
CASE_KEYS = ["fiscal_year", "case_number"]


def read_text_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """CSV with a header, every cell as text."""
    return spark.read.options(header=True, inferSchema=False, **options).csv(path)


def canonical(raw: DataFrame, release: Release) -> DataFrame:
    """Project one release's raw rows to the canonical columns and types.

    A raw header the map needs and the file lacks is an error: drift must not load NULLs.
    """
    headers = header_map(release.kind, release.fiscal_year, release.quarter)
    lost = missing_headers(headers, raw.columns)
    if lost:
        raise KeyError(f"{release.source_file}: header lacks {lost}")

    def column(name: str, header: str | None) -> Column:
        convert, kind = _CASE_TYPES.get(name, (clean.text, "string"))
        cell = F.lit(None).cast(kind) if header is None else convert(F.col(f"`{header}`"))
        return cell.cast(kind).alias(name)

    columns = [column(n, h) for n, h in headers.items()]
    columns.insert(1, F.lit(release.fiscal_year).alias("fiscal_year"))
    columns.append(F.lit(release.source_file).alias("source_file"))
    if release.kind == "lca":
        columns.append(F.lit(release.quarter).alias("source_quarter"))
        columns.append(clean.text(F.col(headers["employer_name"])).alias("employer_name_raw"))
    keyed = raw.where(F.col(headers["case_number"]).isNotNull())
    return keyed.select(*columns).where(F.col("case_number").isNotNull())


def union_releases(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def all_cases(raw: dict[Release, DataFrame], checked: bool = True) -> DataFrame:
    """Every staged case row of every release; unmapped statuses stop the load."""
    rows = union_releases([canonical(df, r) for r, df in raw.items() if r.kind == "lca"])
    if checked:
        gate(unmapped_statuses(rows), "unmapped case status")
    return rows


def latest_cases(rows: DataFrame) -> DataFrame:
    """One row per case and fiscal year: a later quarter supersedes, then a later decision."""
    order = [F.desc("source_quarter"), F.desc_nulls_last("decision_date"), F.asc("source_file")]
    return latest_wins(rows, CASE_KEYS, order)


def worksites(raw: dict[Release, DataFrame]) -> DataFrame:
    return union_releases([canonical(df, r) for r, df in raw.items() if r.kind == "lca_worksites"])
