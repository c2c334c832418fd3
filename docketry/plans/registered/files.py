"""Text sources under the oracle: given tables are written as release and registry files, in their
layouts, below the run's folder, and read back by the library."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry import fixed
from docketry.functions.display import fiscal_year
from docketry.operators import inventory, quality
from docketry.operators.ordering import dense_index
from docketry.plans import publish
from docketry.plans.registered.base import REGISTRY, query, registry, table
from docketry.session import run_dir
from docketry.sources import cases as case_files
from docketry.sources import registers
from docketry.sources import registry as registry_files
from docketry.sources.releases import Release, header_map

COUNTS = ["initial_approvals", "initial_denials", "continuing_approvals", "continuing_denials"]


def written(df: DataFrame, **options) -> str:
    """Folder of a text table with a header."""
    path = f"{run_dir(df.sparkSession)}/text/{uuid.uuid4().hex}"
    df.write.options(header=True, **options).csv(path)
    return path


def parsed(spark, path: str, *columns: str) -> DataFrame:
    """Rows of a registry file, with the layout it was found to have."""
    layout, rows = registry_files.parse_registry(registry_files.read_registry_text(spark, path))
    return rows.withColumn("layout", F.lit(layout)).select(*columns)


@query(
    "registry_text_legacy",
    f"WITH {REGISTRY} SELECT 'legacy' AS layout, fiscal_year, employer_name, state, city, tax4, {', '.join(COUNTS)} FROM registry",
)
def registry_text_legacy(spark, d):
    """The four-count layout, with quotes in the names' header and tabs between cells."""
    rows = registry(spark, d)
    named = {"Fiscal Year": "fiscal_year", "Employer (Petitioner) Name": "employer_name", "Petitioner State": "state", "Petitioner City": "city",
             "Industry (NAICS) Code": "naics", "Tax ID": "tax4", "Initial Approval": COUNTS[0], "Initial Denial": COUNTS[1],
             "Continuing Approval": COUNTS[2], "Continuing Denial": COUNTS[3]}
    path = written(rows.select(*[F.col(c).cast("string").alias(h) for h, c in named.items()]), sep="\t")
    return parsed(spark, path, "layout", "fiscal_year", "employer_name", "state", "city", "tax4", *COUNTS)


PARTS = [f"{c}_{o}" for c in ("new_employment", "new_concurrent", "continuation", "change_same_employer", "change_of_employer", "amended") for o in ("approvals", "denials")]
SIX_ROWS = """WITH six AS (SELECT fiscal_year, employer_name || chr(10) || 'c/o "' || coalesce(state, 'none') || '", ' || tax4 AS employer_name,
    upper(city || chr(10) || chr(2638) || chr(256)) AS city, coalesce(initial_approvals, 0) AS a, coalesce(initial_denials, 0) AS d FROM registry WHERE employer_name IS NOT NULL AND tax4 IS NOT NULL)
  SELECT 'six_category' AS layout, fiscal_year, employer_name, city,
    {cells}, 2 * a + 1 AS initial_approvals, 2 * d + 1 AS initial_denials, 4 * a + 14 AS continuing_approvals, 4 * d + 14 AS continuing_denials FROM six"""


def six_cells(a: str, d: str) -> list[str]:
    """The twelve counts of a row, by its two counts: k + the count, for the category at place k."""
    return [f"{source} + {k}" for k in range(6) for source in (a, d)]


SIX_SQL = f"WITH {REGISTRY}, " + SIX_ROWS.removeprefix("WITH ").format(cells=", ".join(f"{cell} AS {name}" for cell, name in zip(six_cells("a", "d"), PARTS, strict=True)))


def six_category(spark, d, **options):
    """Twelve counts, with line feeds, quotes, separators and characters beyond ASCII inside cells."""
    rows = registry(spark, d).where("employer_name IS NOT NULL AND tax4 IS NOT NULL")
    name = F.concat("employer_name", F.lit('\nc/o "'), F.coalesce("state", F.lit("none")), F.lit('", '), "tax4")
    counts = {"a": F.coalesce("initial_approvals", F.lit(0)), "d": F.coalesce("initial_denials", F.lit(0))}
    heads = [f"{c} {o}" for c in fixed.CATEGORIES.values() for o in ("Approval", "Denials")]
    cells = [(counts["a" if i % 2 == 0 else "d"] + i // 2).cast("string").alias(h) for i, h in enumerate(heads)]
    # The last two letters hold a line feed's bytes in UTF-16, across them.
    city = F.concat("city", F.lit("\n\u0a4e\u0100"))
    path = written(rows.select(F.col("fiscal_year").alias("Fiscal Year"), name.alias("Employer (Petitioner) Name"), city.alias("Petitioner City"), *cells), escape='"', quoteAll=True, **options)
    return parsed(spark, path, "layout", "fiscal_year", "employer_name", "city", *PARTS, *COUNTS)


@query("registry_text_quoted", SIX_SQL)
def registry_text_quoted(spark, d):
    """UTF-8, line feeds inside cells: read in splits by quote states."""
    return six_category(spark, d)


@query("registry_text_utf16", SIX_SQL)
def registry_text_utf16(spark, d):
    """UTF-16 with tabs: read in splits, pieces cut inside a character put together again."""
    return six_category(spark, d, sep="\t", encoding="UTF-16LE")


@query("registry_record_counts", f"""WITH {REGISTRY} SELECT 'legacy' AS file, count(*) AS counted, count(*) AS read FROM registry WHERE employer_name IS NOT NULL
    UNION ALL SELECT 'quoted', count(*), count(*) FROM registry WHERE employer_name IS NOT NULL""")
def registry_record_counts(spark, d):
    """Records counted beside the reader, and rows it gives: plain cells, and cells with line feeds."""
    rows = registry(spark, d).where("employer_name IS NOT NULL")
    out = []
    for name, cell in (("legacy", F.col("employer_name")), ("quoted", F.concat(F.lit("\n"), F.col("employer_name"), F.lit('"\n')))):
        path = written(rows.select(F.col("fiscal_year").cast("string").alias("Fiscal Year"), cell.alias("Employer")), escape='"')
        read = registry_files.read_registry_text(spark, path).agg(F.count(F.lit(1)).alias("read"))
        out.append(registry_files.raw_records(spark, path).select(F.lit(name).alias("file"), F.col("rows").alias("counted")).crossJoin(read))  # one row each
    return out[0].unionByName(out[1])


@query(
    "registry_text_long",
    """WITH s AS (SELECT l_suppkey, CAST(year(l_shipdate + INTERVAL 3 MONTH) AS INTEGER) AS fiscal_year,
        sum(l_linenumber) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY ALL)
    SELECT 'long' AS layout, fiscal_year, 'Supplier, No ' || l_suppkey AS employer_name, CAST(a AS INTEGER) AS initial_approvals, CAST(NULL AS INTEGER) AS initial_denials,
      CAST(NULL AS INTEGER) AS continuing_approvals, CAST(r AS INTEGER) AS continuing_denials FROM s""",
)
def registry_text_long(spark, d):
    """One row per measure, with thousands separators; the library turns them into columns."""
    flag = F.col("l_returnflag")
    sums = table(spark, d, "lineitem").groupBy("l_suppkey", fiscal_year(F.col("l_shipdate")).cast("int").alias("fy")).agg(
        F.sum(F.when(flag == "A", F.col("l_linenumber"))).alias("a"), F.count_if(flag == "R").alias("r")
    )
    measures = F.array(
        F.struct(F.lit("New Employment Approvals").alias("m"), F.format_number("a", 0).alias("v")),
        F.struct(F.lit("Amended Denial").alias("m"), F.format_number("r", 0).alias("v")),
    )
    name = F.concat(F.lit("Supplier, No "), F.col("l_suppkey").cast("string")).alias("Employer")
    long = sums.select(F.col("fy").alias("Fiscal Year"), name, F.explode(measures).alias("x"))
    path = written(long.select("Fiscal Year", "Employer", F.col("x.m").alias("Measure Names"), F.col("x.v").alias("Measure Values")))
    return parsed(spark, path, "layout", "fiscal_year", "employer_name", *COUNTS)


@query(
    "case_text_releases",
    """WITH r AS (SELECT *, unnest([1, 2, 4]) AS quarter FROM orders),
      kept AS (SELECT *, CASE quarter WHEN 1 THEN 'Certified' WHEN 2 THEN 'Withdrawn' ELSE 'Denied' END AS status FROM r
        WHERE quarter = 1 OR quarter = 2 AND o_orderkey % 3 = 0 OR quarter = 4 AND o_orderkey % 5 = 0)
    SELECT 'I-' || o_orderkey AS case_number, 2024 AS fiscal_year, max(quarter) AS source_quarter, arg_max(status, quarter) AS case_status,
      any_value(CAST(o_orderdate AS DATE)) AS decision_date, any_value('12-' || lpad(CAST(o_custkey AS VARCHAR), 7, '0')) AS employer_fein,
      any_value(CAST(floor(o_totalprice) AS DOUBLE)) AS wage_from, any_value(o_orderkey % 4 <> 0) AS full_time FROM kept GROUP BY o_orderkey""",
)
def case_text_releases(spark, d):
    """Three quarterly files, each with its own headers; a later quarter supersedes."""
    o, key = table(spark, d, "orders"), F.col("o_orderkey")
    cells = {
        "case_number": F.concat(F.lit(" I-"), key.cast("string")),
        "decision_date": F.date_format("o_orderdate", "yyyy-MM-dd"),
        "employer_name": F.concat(F.lit("Customer, "), F.col("o_custkey").cast("string")),
        "employer_fein": F.lpad(F.col("o_custkey").cast("string"), 7, "0"),
        "wage_from": F.concat(F.lit("$"), F.format_number(F.floor("o_totalprice"), 0)),
        "wage_unit": F.lit("Year"),
        "full_time": F.when(key % 4 == 0, "n").otherwise("Yes"),
    }
    cells["employer_fein"] = F.concat(F.lit("12"), cells["employer_fein"])
    raw = {}
    for quarter, status, rows in ((1, "CERTIFIED", o), (2, "Withdrawn", o.where(key % 3 == 0)), (4, "denied", o.where(key % 5 == 0))):
        release = Release(f"cases_Q{quarter}", "lca", 2024, quarter, False)
        headers = {h: c for c, h in header_map("lca", 2024, quarter).items() if h}
        values = {**cells, "case_status": F.lit(status)}
        text = rows.select(*[values.get(c, F.lit(None).cast("string")).alias(h) for h, c in headers.items()])
        raw[release] = case_files.read_text_csv(spark, written(text))
    latest = case_files.latest_cases(case_files.all_cases(raw))
    return latest.select("case_number", "fiscal_year", "source_quarter", "case_status", "decision_date", "employer_fein", "wage_from", "full_time")


@query(
    "file_digests_written",
    """SELECT 'k=' || c_nationkey AS folder, sum(strlen(c_name) + strlen(CAST(c_custkey AS VARCHAR)) + 2)::BIGINT AS bytes,
      sha256(string_agg(c_custkey || chr(9) || c_name || chr(10), '' ORDER BY c_custkey)) AS sha256 FROM customer GROUP BY c_nationkey""",
)
def file_digests_written(spark, d):
    """A file per nation, written in order, then listed and hashed in splits."""
    rows = table(spark, d, "customer")
    line = F.concat_ws("\t", F.col("c_custkey").cast("string"), "c_name").alias("value")
    path = f"{run_dir(spark)}/digests/{uuid.uuid4().hex}"
    lines = rows.select(F.col("c_nationkey").alias("k"), "c_custkey", line).repartition("k").sortWithinPartitions("k", "c_custkey")
    lines.drop("c_custkey").write.partitionBy("k").text(path)
    files = inventory.file_inventory(spark, path, "*.txt")
    return files.select(F.regexp_extract("file", "(k=[^/]*)/", 1).alias("folder"), "bytes", "sha256")


@query(
    "exempt_register_read",
    """SELECT CASE WHEN c_custkey % 5 = 1 THEN lpad(CAST(c_custkey AS VARCHAR), 2, '0') || '-' || lpad(CAST(c_custkey AS VARCHAR), 7, '0')
        ELSE substr(lpad(CAST(c_custkey AS VARCHAR), 9, '0'), 1, 2) || '-' || substr(lpad(CAST(c_custkey AS VARCHAR), 9, '0'), 3) END AS fein,
      lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS subsection, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS ntee
    FROM customer WHERE c_custkey % 5 <> 0 AND (c_custkey % 5 <> 1 OR c_custkey < 100)""",
)
def exempt_register_read(spark, d):
    """Ids with and without a dash, padded cells, absent codes; ids that lack a digit drop out."""
    key = F.col("c_custkey").cast("string")
    ein = F.when(F.col("c_custkey") % 5 == 0, F.lpad(key, 8, "0")).when(F.col("c_custkey") % 5 == 1, F.concat(F.when(F.col("c_custkey") < 100, F.lpad(key, 2, "0")).otherwise(key), F.lit("-"), F.lpad(key, 7, "0"))).otherwise(F.lpad(key, 9, "0"))
    cells = {"EIN": ein, "NAME": F.col("c_name"), "SUBSECTION": F.concat(F.lit(" "), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")), "NTEE_CD": F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment"))}
    path = written(table(spark, d, "customer").select(*[c.alias(h) for h, c in cells.items()]), ignoreLeadingWhiteSpace=False)
    return registers.read_exempt_register(spark, path)


@query(
    "group_map_read",
    f"""SELECT {", ".join(f"'{c} ' || c_custkey AS {c}" for c in fixed.GROUP_COLUMNS)} FROM customer""",
)
def group_map_read(spark, d):
    """The curated map by its exact header."""
    key = F.col("c_custkey").cast("string")
    rows = table(spark, d, "customer").select(*[F.concat(F.lit(f"{c} "), key).alias(c) for c in fixed.GROUP_COLUMNS])
    return registers.read_group_map(spark, written(rows))


@query("csv_in_order", "SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS place, o_orderkey FROM orders")
def csv_in_order(spark, d):
    """Ordered CSV parts: read in the order of their names they give the rows in order."""
    path = f"{run_dir(spark)}/ordered/{uuid.uuid4().hex}"
    publish.write_csv(table(spark, d, "orders").select("o_totalprice", "o_orderkey"), path, ["o_totalprice", "o_orderkey"])
    rows = spark.read.options(header=True).schema("o_totalprice double, o_orderkey long").csv(path)
    placed = rows.select("o_orderkey", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return dense_index(placed, [F.col("file"), F.col("block"), F.col("at")], "place").select("place", "o_orderkey")


@query(
    "golden_pairs",
    """WITH p AS (SELECT c_custkey % 7 <> 0 AS same, c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AS found FROM customer),
      c AS (SELECT count(*) FILTER (found AND same) AS tp, count(*) FILTER (found AND NOT same) AS fp,
        count(*) FILTER (NOT found AND same) AS fn, count(*) FILTER (NOT found AND NOT same) AS tn FROM p)
    SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
      tp / (tp + fp) >= 0.85 AND tp / (tp + fn) >= 0.8 AS floors_hold FROM c""",
)
def golden_pairs(spark, d):
    """Labelled pairs of spellings: legal forms and case differ, some pairs are other companies, and
    some abbreviate what the normal form does not know; the floors of precision and recall hold."""
    key = F.col("c_custkey")
    other = F.when(key % 7 == 0, key + 1).otherwise(key).cast("string")
    a = F.concat(F.lit("Customer Works "), key.cast("string"), F.lit(", Inc."))
    b = F.concat(F.when(key % 11 == 0, "CUST. WKS ").otherwise("CUSTOMER  WORKS "), other, F.lit(" LLC"))
    pairs = table(spark, d, "customer").select(a.alias("name_a"), b.alias("name_b"), F.when(key % 7 == 0, "0").otherwise("1").alias("same"))
    scores = quality.score_normalizer(pairs)
    return scores.withColumn("floors_hold", (F.col("precision") >= 0.85) & (F.col("recall") >= 0.8))
