"""They decide results, so they are data here and nothing else.

Word lists, code tables, constants and patterns that the filing records and their
registries use. Everything in this file is a fixed value that must not change.
"""

# --- Fixed values: case status, normalized key -> canonical value -----------------------
STATUSES = {
    "CERTIFIED": "Certified",
    "CERTIFIED-WITHDRAWN": "Certified - Withdrawn",
    "WITHDRAWN": "Withdrawn",
    "DENIED": "Denied",
}
CERTIFIED = "Certified"
WITHDRAWN_GROUP = ("Withdrawn", "Certified - Withdrawn")
DENIED = "Denied"
UNKNOWN_PREFIX = "UNKNOWN:"

# --- Fixed values: prevailing wage levels -----------------------------------------------
LEVELS = ("I", "II", "III", "IV")
NO_LEVEL = "none"

# --- Fixed values: pay units and plausible yearly pay -----------------------------------
PAY_UNITS = {"year": 1, "month": 12, "bi-weekly": 26, "week": 52, "hour": 2080}
PAY_UNIT_SYNONYMS = {"biweekly": "bi-weekly"}
PAY_MIN = 15_000
PAY_MAX = 1_000_000

# --- Fixed values: tax ids that filers type when they have none -------------------------
PLACEHOLDER_IDS = ("123456789", "987654321", "012345678")

# --- Fixed values: occupation code -> role group ('17-2' is a prefix) --------------------
ROLE_CODES = {
    "Software engineering": ["15-1252", "15-1253", "15-1256"],
    "Data and analytics": ["15-2051", "15-2041", "13-1161"],
    "Finance": ["13-2051", "13-2052", "13-2011", "13-2099"],
    "Quant and actuarial": ["15-2011", "15-2031"],
    "IT and systems": ["15-1211", "15-1212", "15-1244", "15-1299"],
}
ROLE_PREFIXES = {"Engineering": ["17-2"]}
OTHER_ROLE = "Other"
ROLE_GROUPS = [*ROLE_CODES, *ROLE_PREFIXES, OTHER_ROLE]

# --- Fixed values: the entry-level selection of role groups ------------------------------
ENTRY_SELECTION = (
    "swe_data_fin",
    ["Software engineering", "Data and analytics", "Finance", "Quant and actuarial"],
)
ENTRY_LEVELS = ("I", "II")

# --- Fixed values: eligibility rule ------------------------------------------------------
EXEMPT_SUBSECTION = "03"
EXEMPT_NTEE = r"^(B4[0-3]|B50|H|U)"
COLLEGE_NAICS = "611310"
EDU_OR_HEALTH_SECTORS = ("61", "62")
COLLEGE_NAME = (
    r"\b(UNIVERSITY|COLLEGE)\b|INSTITUTE OF TECHNOLOGY|SCHOOL OF MEDICINE|MEDICAL SCHOOL"
)

# --- Fixed values: legal-form words dropped from the end of a name -----------------------
LEGAL_FORMS = [
    "INC", "LLC", "LLP", "CORP", "CORPORATION", "CO", "LTD", "LP", "PLLC",
    "INCORPORATED", "LIMITED", "COMPANY", "PC",
]

# --- Fixed values: entity resolution, search, paging --------------------------------------
DOMINANT_SHARE = 0.95
TRIGRAM_THRESHOLD = 0.3
PAGE_SIZE = 50
EXPORT_LIMIT = 5000
KEY_CHUNK = 40_000
SIMILAR_LIMIT = 8
ALIAS_SHOWN = 40

# --- Fixed values: state names -> postal codes --------------------------------------------
STATE_CODES = {
    "ALABAMA": "AL", "ALASKA": "AK", "AMERICAN SAMOA": "AS", "ARIZONA": "AZ",
    "ARKANSAS": "AR", "CALIFORNIA": "CA", "COLORADO": "CO", "CONNECTICUT": "CT",
    "DELAWARE": "DE", "DISTRICT OF COLUMBIA": "DC", "FLORIDA": "FL", "GEORGIA": "GA",
    "GUAM": "GU", "HAWAII": "HI", "IDAHO": "ID", "ILLINOIS": "IL", "INDIANA": "IN",
    "IOWA": "IA", "KANSAS": "KS", "KENTUCKY": "KY", "LOUISIANA": "LA", "MAINE": "ME",
    "MARYLAND": "MD", "MASSACHUSETTS": "MA", "MICHIGAN": "MI", "MINNESOTA": "MN",
    "MISSISSIPPI": "MS", "MISSOURI": "MO", "MONTANA": "MT", "NEBRASKA": "NE",
    "NEVADA": "NV", "NEW HAMPSHIRE": "NH", "NEW JERSEY": "NJ", "NEW MEXICO": "NM",
    "NEW YORK": "NY", "NORTH CAROLINA": "NC", "NORTH DAKOTA": "ND",
    "NORTHERN MARIANA ISLANDS": "MP", "OHIO": "OH", "OKLAHOMA": "OK", "OREGON": "OR",
    "PENNSYLVANIA": "PA", "PUERTO RICO": "PR", "RHODE ISLAND": "RI",
    "SOUTH CAROLINA": "SC", "SOUTH DAKOTA": "SD", "TENNESSEE": "TN", "TEXAS": "TX",
    "UTAH": "UT", "VERMONT": "VT", "VIRGIN ISLANDS": "VI", "VIRGINIA": "VA",
    "WASHINGTON": "WA", "WEST VIRGINIA": "WV", "WISCONSIN": "WI", "WYOMING": "WY",
}
MISSING_STATE = "??"
# Associated states may be filtered on too, next to every code above.
FILTER_STATES = sorted({*STATE_CODES.values(), "FM", "MH", "PW"})

# --- Fixed values: canonical case column -> raw header ------------------------------------
CASE_HEADERS = {
    "case_number": "CASE_NUMBER",
    "case_status": "CASE_STATUS",
    "received_date": "RECEIVED_DATE",
    "decision_date": "DECISION_DATE",
    "visa_class": "VISA_CLASS",
    "employer_name": "EMPLOYER_NAME",
    "employer_fein": "EMPLOYER_FEIN",
    "employer_city": "EMPLOYER_CITY",
    "employer_state": "EMPLOYER_STATE",
    "naics_code": "NAICS_CODE",
    "job_title": "JOB_TITLE",
    "soc_code": "SOC_CODE",
    "soc_title": "SOC_TITLE",
    "full_time": "FULL_TIME_POSITION",
    "worksite_city": "WORKSITE_CITY",
    "worksite_state": "WORKSITE_STATE",
    "wage_from": "WAGE_RATE_OF_PAY_FROM",
    "wage_to": "WAGE_RATE_OF_PAY_TO",
    "wage_unit": "WAGE_UNIT_OF_PAY",
    "prevailing_wage": "PREVAILING_WAGE",
    "pw_unit": "PW_UNIT_OF_PAY",
    "pw_wage_level": "PW_WAGE_LEVEL",
    "h1b_dependent": "H_1B_DEPENDENT",
    "willful_violator": "WILLFUL_VIOLATOR",
    "total_workers": "TOTAL_WORKER_POSITIONS",
}
WORKSITE_HEADERS = {
    "case_number": "CASE_NUMBER",
    "worksite_workers": "WORKSITE_WORKERS",
    "worksite_city": "WORKSITE_CITY",
    "worksite_state": "WORKSITE_STATE",
    "wage_from": "WAGE_RATE_OF_PAY_FROM",
    "wage_unit": "WAGE_UNIT_OF_PAY",
    "pw_wage_level": "PW_WAGE_LEVEL",
}
# Deviations from the two maps above: fiscal year, quarter (None: every quarter of the
# year), canonical column, header (None: the column is not published).
HEADER_DEVIATIONS = [
    (2023, None, "employer_fein", None),
    (2025, 1, "h1b_dependent", "H-1B_DEPENDENT"),
]
# Releases known to the loader: kind, first and last fiscal year of the quarterly series,
# and the single cumulative releases after it.
QUARTERLY_YEARS = (2023, 2024, 2025)
CUMULATIVE_CASES = [(2023, 2), (2026, 3)]
LATEST_RELEASE = (2026, 3)
RELEASE_NAME = r"(LCA_(?:Disclosure_Data|Worksites)_FY_?(\d{4})_Q([1-4])\.xlsx)"
REGISTRY_RELEASE_NAME = r"(h1b_datahubexport-(\d{4})\.csv)"

# --- Fixed values: registry B layouts -----------------------------------------------------
CATEGORIES = {
    "new_employment": "New Employment",
    "new_concurrent": "New Concurrent",
    "continuation": "Continuation",
    "change_same_employer": "Change with Same Employer",
    "change_of_employer": "Change of Employer",
    "amended": "Amended",
}
INITIAL_PARTS = ("new_employment", "new_concurrent")
CONTINUING_PARTS = ("continuation", "change_same_employer", "change_of_employer", "amended")
OUTCOMES = ("approvals", "denials")
# What does not count in a registry header: all but letters and digits, and a plural outcome's s.
HEADER_NOISE = ("[^a-z0-9]", "(?<=approval)s$", "(?<=denial)s$")
REGISTRY_ID_HEADERS = {
    "fiscal_year": ["fiscalyear"],
    "employer_name": ["employer", "employername", "employerpetitionername", "petitionername"],
    "state": ["state", "petitionerstate", "employerstate"],
    "city": ["city", "petitionercity", "employercity"],
    "zip": ["zip", "zipcode", "petitionerzipcode"],
    "naics": ["naics", "naicscode", "industrynaicscode"],
    "tax4": ["taxid"],
}
LEGACY_HEADERS = {
    "initialapproval": "initial_approvals",
    "initialdenial": "initial_denials",
    "continuingapproval": "continuing_approvals",
    "continuingdenial": "continuing_denials",
}
MEASURE_NAME_HEADER, MEASURE_VALUE_HEADER = "measurenames", "measurevalues"

# --- Fixed values: curated group map ------------------------------------------------------
GROUP_COLUMNS = [
    "group_slug", "group_name", "fein", "status", "evidence_url", "reviewed_by",
    "reviewed_on", "note",
]
GROUP_STATUSES = ("proposed", "reviewed")

# --- Fixed values: published table names, table shape version -----------------------------
PUBLISHED = {
    "agg_employers": "employers",
    "agg_aliases": "aliases",
    "agg_lca_year": "lca_year",
    "agg_lca_year_role": "lca_year_role",
    "agg_lca_year_top": "lca_year_top",
    "agg_lca_cube": "lca_cube",
    "agg_entry_signal": "entry_signal",
    "uscis_year": "uscis_year",
    "agg_links": "links",
    "agg_groups": "groups",
}
SCHEMA_VERSION = 2
JDBC_BATCH = 50_000

# --- Fixed values: display -----------------------------------------------------------------
MISSING_TEXT = "–"
EXPORT_COLUMNS = [
    "employer", "state", "certified_lcas", "mean_offered_wage", "wage_rows",
    "uscis_initial_approvals_", "h1b_dependent_latest", "likely_cap_exempt_rule", "url",
]
