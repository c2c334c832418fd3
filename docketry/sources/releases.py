"""The declared releases and the per-release column maps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from docketry import fixed

REGISTRY_SCHEMA = "source_file string, kind string, fiscal_year int, quarter int, cumulative boolean"


@dataclass(frozen=True)
class Release:
    """One published file with the facts its name and page declare."""

    source_file: str
    kind: str  # 'lca' or 'lca_worksites'
    fiscal_year: int
    quarter: int
    cumulative: bool  # holds the year to date rather than one quarter


@dataclass(frozen=True)
class RegistryFile:
    """One registry-B file; an optional one is loaded when it is there."""

    source_file: str
    fiscal_year: int
    required: bool = False


def declared_releases() -> list[Release]:
    year, quarter = fixed.LATEST_RELEASE
    quarterly = [(fy, q) for fy in fixed.QUARTERLY_YEARS for q in (1, 2, 3, 4)]
    cases = [
        Release(f"LCA_Disclosure_Data_FY{fy}_Q{q}.xlsx", "lca", fy, q, (fy, q) in fixed.CUMULATIVE_CASES)
        for fy, q in [*quarterly, (year, quarter)]
    ]
    sites = [
        Release(f"LCA_Worksites_FY{fy}_Q4.xlsx", "lca_worksites", fy, 4, True)
        for fy in fixed.QUARTERLY_YEARS
    ]
    latest = Release(f"LCA_Worksites_FY_{year}_Q{quarter}.xlsx", "lca_worksites", year, quarter, True)
    return [*cases, *sites, latest]


def declared_registry_files() -> list[RegistryFile]:
    return [
        RegistryFile("h1b_datahubexport-2023.csv", 2023, required=True),
        *[RegistryFile(f"uscis_hub_FY{fy}.csv", fy) for fy in (2024, 2025, 2026)],
    ]


def release_table(spark: SparkSession, releases: list[Release]) -> DataFrame:
    """The declared releases as a table, for joins with inventories and link lists."""
    rows = [(r.source_file, r.kind, r.fiscal_year, r.quarter, r.cumulative) for r in releases]
    return spark.createDataFrame(rows, REGISTRY_SCHEMA)


def header_map(kind: str, fiscal_year: int, quarter: int) -> dict[str, str | None]:
    """Canonical column -> raw header of one release; None where it is not published."""
    headers = dict(fixed.CASE_HEADERS if kind == "lca" else fixed.WORKSITE_HEADERS)
    if kind == "lca":
        for year, q, column, header in fixed.HEADER_DEVIATIONS:
            if year == fiscal_year and q in (None, quarter):
                headers[column] = header
    return headers


def missing_headers(headers: dict[str, str | None], columns: list[str]) -> list[str]:
    """Raw headers the map needs that the file does not have."""
    return sorted({h for h in headers.values() if h} - set(columns))


def present_files(
    spark: SparkSession, files: list[RegistryFile], folder: str
) -> list[RegistryFile]:
    """The declared files that exist; a missing required one is an error. Names only are read."""
    from docketry.operators.inventory import file_inventory

    listed = file_inventory(spark, folder, hashed=False).select("file")
    declared = spark.createDataFrame([(f.source_file,) for f in files], "file string")
    found = {r.file for r in declared.join(listed, "file", "left_semi").collect()}
    lost = [f.source_file for f in files if f.required and f.source_file not in found]
    if lost:
        raise FileNotFoundError(f"required registry files are missing: {lost}")
    return [f for f in files if f.source_file in found]
