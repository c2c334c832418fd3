"""Factories for cases and registry rows."""

import datetime as dt

CASE_SCHEMA = (
    "case_number string, fiscal_year int, case_status string, received_date date, decision_date date, "
    "employer_name string, employer_fein string, employer_city string, employer_state string, "
    "naics_code string, job_title string, soc_code string, full_time boolean, worksite_state string, "
    "wage_from double, wage_unit string, prevailing_wage double, pw_unit string, pw_wage_level string, "
    "h1b_dependent boolean, willful_violator boolean, total_workers int, source_file string, source_quarter int"
)
NAMES = [c.split()[0] for c in CASE_SCHEMA.split(", ")]
DEFAULT = dict(
    case_status="Certified", fiscal_year=2025, received_date=dt.date(2025, 1, 1), decision_date=dt.date(2025, 2, 1),
    employer_name="Acme Software LLC", employer_fein="11-1111111", employer_city="RESTON", employer_state="VA",
    naics_code="541511", job_title="Software Engineer", soc_code="15-1252", full_time=True, worksite_state="VA",
    wage_from=100000.0, wage_unit="Year", prevailing_wage=90000.0, pw_unit="Year", pw_wage_level="II",
    h1b_dependent=False, willful_violator=False, total_workers=1, source_file="f", source_quarter=4,
)


def case(n, **kw):
    row = {**DEFAULT, "case_number": f"I-{n}", **kw}
    return tuple(row[c] for c in NAMES)


def cases(spark, *rows):
    return spark.createDataFrame(list(rows), CASE_SCHEMA)


REGISTRY_SCHEMA = (
    "fiscal_year int, source_file string, employer_name string, initial_approvals int, initial_denials int, "
    "continuing_approvals int, continuing_denials int, naics string, tax4 string, state string, city string, "
    "new_employment_approvals int"
)


def registry(spark, *lines):
    """'name,initial,continuing,tax4,state,city[,year]' lines; empty cells are missing."""
    out = []
    for line in lines:
        name, initial, continuing, tax4, state, city, *year = [v or None for v in line.split(",")]
        number = lambda v: None if v is None else int(v)
        out.append((int(year[0]) if year else 2023, "u.csv", name, number(initial), 0, number(continuing), 0,
                    "54 - Professional", tax4, state, city, None))
    return spark.createDataFrame(out, REGISTRY_SCHEMA)
