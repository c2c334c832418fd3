"""The registry of queries, and the role map of the filing tables onto the given tables.

Orders play the cases, customers the employers, line items and suppliers registry B, parts
the curated names, pages the listing pages. Attributes the given tables lack are derived
from their columns, in Spark and in SQL by the same arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docketry.functions.clean import lookup, plausible
from docketry.functions.display import fiscal_quarter, fiscal_year
from docketry.operators.aggregates import with_annual_pay
from docketry.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under `name`, with the SQL of the same result."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table; its schema is read from the file once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


UNITS = ["Year", "Month", "bi_weekly", " week ", "HOUR"]
MULTIPLIERS = [1, 12, 26, 52, 2080]


def cases(spark: SparkSession, d: str) -> DataFrame:
    """Orders as cases: canonical columns plus yearly pay and dimensions."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    key, cust = F.col("o_orderkey"), F.col("c_custkey")
    places = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = o.join(c, F.col("o_custkey") == cust).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    fy, q = fiscal_year(F.col("o_orderdate")), fiscal_quarter(F.col("o_orderdate"))
    unit = (key % 5).cast("int")
    price = F.col("o_totalprice")
    status = (
        F.when(F.col("o_orderstatus") == "F", "Certified")
        .when((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT"), "Certified - Withdrawn")
        .when(F.col("o_orderstatus") == "O", "Withdrawn")
        .otherwise("Denied")
    )
    level = lookup(F.left("o_orderpriority", F.lit(1)), {"1": "I", "2": "II", "3": "III", "4": "IV"})
    group = F.floor(cust / 10).cast("string")
    noisy = cust + F.when(key % 40 == 0, 1).otherwise(0)
    name = F.concat(
        F.when(key % 4 == 0, "The ").otherwise(""),
        "c_mktsegment",
        F.lit(" Group "),
        group,
        F.when(key % 3 == 0, ", Inc.").when(key % 3 == 1, " L.L.C.").otherwise(" Corp"),
    )
    out = rows.select(
        key.alias("case_number"),
        fy.cast("int").alias("fiscal_year"),
        q.alias("source_quarter"),
        F.concat(F.lit("cases_FY"), fy, F.lit("_Q"), q).alias("source_file"),
        status.alias("case_status"),
        F.col("o_orderdate").cast("date").alias("decision_date"),
        cust.alias("employer_id"),
        name.alias("employer_name"),
        F.when(fy != 1996, F.concat(F.lit("12-"), F.lpad(noisy.cast("string"), 7, "0"))).alias("employer_fein"),
        F.col("r_name").alias("employer_state"),
        F.col("n_name").alias("employer_city"),
        F.concat(F.lit("54"), (cust % 7).cast("string")).alias("naics_code"),
        F.col("o_orderpriority").alias("job_title"),
        F.col("c_mktsegment").alias("role_group"),
        F.when(cust % 9 != 0, F.col("n_name")).alias("worksite_state"),
        level.alias("pw_wage_level"),
        F.coalesce(level, F.lit("none")).alias("level"),
        F.get(F.array(*[F.lit(u) for u in UNITS]), unit).alias("wage_unit"),
        F.floor(price / F.get(F.array(*[F.lit(m) for m in MULTIPLIERS]), unit)).cast("double").alias("wage_from"),
        F.floor(price * 0.9).cast("double").alias("prevailing_wage"),
        F.lit("Year").alias("pw_unit"),
        (key % 10 != 0).alias("full_time"),
        F.when(key % 4 != 0, (key % 3 + 1).cast("int")).alias("total_workers"),
        F.when(key % 5 == 0, True).when(key % 5 < 3, False).alias("h1b_dependent"),
        (key % 97 == 0).alias("willful_violator"),
    )
    return with_annual_pay(out).withColumn("pw_valid", plausible(F.col("pw_annual")))


FY = "CAST(year({d}) + CASE WHEN month({d}) >= 10 THEN 1 ELSE 0 END AS INTEGER)"
FQ = "CAST(floor(((month({d}) + 2) % 12) / 3) AS INTEGER) + 1"

CASES = f"""raw_cases AS (
  SELECT o_orderkey AS case_number,
    {FY.format(d="o_orderdate")} AS fiscal_year,
    {FQ.format(d="o_orderdate")} AS source_quarter,
    'cases_FY' || {FY.format(d="o_orderdate")} || '_Q' || ({FQ.format(d="o_orderdate")}) AS source_file,
    CASE WHEN o_orderstatus = 'F' THEN 'Certified'
         WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN 'Certified - Withdrawn'
         WHEN o_orderstatus = 'O' THEN 'Withdrawn' ELSE 'Denied' END AS case_status,
    CAST(o_orderdate AS DATE) AS decision_date,
    c_custkey AS employer_id,
    (CASE WHEN o_orderkey % 4 = 0 THEN 'The ' ELSE '' END) || c_mktsegment || ' Group ' || (c_custkey // 10)
      || (CASE o_orderkey % 3 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' L.L.C.' ELSE ' Corp' END) AS employer_name,
    CASE WHEN {FY.format(d="o_orderdate")} <> 1996 THEN '12-' || lpad(CAST(c_custkey
      + CASE WHEN o_orderkey % 40 = 0 THEN 1 ELSE 0 END AS VARCHAR), 7, '0') END AS employer_fein,
    r_name AS employer_state, n_name AS employer_city,
    '54' || (c_custkey % 7) AS naics_code,
    o_orderpriority AS job_title, c_mktsegment AS role_group,
    CASE WHEN c_custkey % 9 <> 0 THEN n_name END AS worksite_state,
    CASE left(o_orderpriority, 1) WHEN '1' THEN 'I' WHEN '2' THEN 'II' WHEN '3' THEN 'III'
      WHEN '4' THEN 'IV' END AS pw_wage_level,
    o_orderkey % 5 AS unit_no,
    CASE o_orderkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 12 WHEN 2 THEN 26 WHEN 3 THEN 52 ELSE 2080 END AS mult,
    o_totalprice,
    CAST(floor(o_totalprice * 0.9) AS DOUBLE) AS pw_annual,
    o_orderkey % 10 <> 0 AS full_time,
    CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 3 + 1 AS INTEGER) END AS total_workers,
    CASE WHEN o_orderkey % 5 = 0 THEN true WHEN o_orderkey % 5 < 3 THEN false END AS h1b_dependent,
    o_orderkey % 97 = 0 AS willful_violator
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), cases AS (
  SELECT *, coalesce(pw_wage_level, 'none') AS level,
    CASE unit_no WHEN 0 THEN 'Year' WHEN 1 THEN 'Month' WHEN 2 THEN 'bi_weekly' WHEN 3 THEN ' week ' ELSE 'HOUR' END AS wage_unit,
    floor(o_totalprice / mult) AS wage_from,
    floor(o_totalprice / mult) * mult AS wage_annual,
    floor(o_totalprice / mult) * mult BETWEEN 15000 AND 1000000 AS wage_valid,
    pw_annual BETWEEN 15000 AND 1000000 AS pw_valid
  FROM raw_cases
)"""


def employers(spark: SparkSession, d: str, cases_df: DataFrame | None = None) -> DataFrame:
    """Customers as published employer rows."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    key, balance = F.col("c_custkey"), F.floor("c_acctbal").cast("int")
    rule = F.when(F.col("c_mktsegment") == "BUILDING", F.when(key % 7 == 3, F.lit("naics_611310")))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        key.alias("employer_id"),
        F.concat(F.lit("c-"), key.cast("string")).alias("slug"),
        F.concat("c_mktsegment", F.lit(" "), F.floor(key / 3).cast("string")).alias("display_name"),
        F.col("n_name").alias("state"),
        F.concat(F.lit("54"), (key % 7).cast("string")).alias("naics"),
        (key % 13 != 5).alias("has_lca"),
        F.when(key % 3 != 0, balance).alias("uscis_initial_total"),
        F.when(key % 5 == 0, True).when(key % 5 < 3, False).alias("h1b_dependent_latest"),
        rule.alias("cap_exempt_rule"),
        F.when(key % 11 != 4, balance + 1000).alias("certified_total"),
    )


EMPLOYERS = """employers AS (
  SELECT c_custkey AS employer_id, 'c-' || c_custkey AS slug,
    c_mktsegment || ' ' || (c_custkey // 3) AS display_name, n_name AS state,
    '54' || (c_custkey % 7) AS naics, c_custkey % 13 <> 5 AS has_lca,
    CASE WHEN c_custkey % 3 <> 0 THEN CAST(floor(c_acctbal) AS INTEGER) END AS uscis_initial_total,
    CASE WHEN c_custkey % 5 = 0 THEN true WHEN c_custkey % 5 < 3 THEN false END AS h1b_dependent_latest,
    CASE WHEN c_mktsegment = 'BUILDING' AND c_custkey % 7 = 3 THEN 'naics_611310' END AS cap_exempt_rule,
    CASE WHEN c_custkey % 11 <> 4 THEN CAST(floor(c_acctbal) AS INTEGER) + 1000 END AS certified_total
  FROM customer JOIN nation ON c_nationkey = n_nationkey
)"""


def registry(spark: SparkSession, d: str) -> DataFrame:
    """Line items as registry-B rows of their suppliers."""
    li, s = table(spark, d, "lineitem"), table(spark, d, "supplier")
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    sup = F.col("s_suppkey")
    places = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    segments = F.array(*[F.lit(x) for x in SEGMENTS])
    qty = F.col("l_quantity").cast("int")
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    rows = li.join(s, F.col("l_suppkey") == sup).join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    fy = fiscal_year(F.col("l_shipdate")).cast("int")
    return rows.select(
        fy.alias("fiscal_year"),
        F.concat(F.lit("registry_"), fy).alias("source_file"),
        F.when(
            sup % 17 != 0,
            F.concat(F.get(segments, (sup % 5).cast("int")), F.lit(" GROUP "), (sup % 150).cast("string"), F.lit(" LLC")),
        ).alias("employer_name"),
        F.when(sup % 19 != 0, F.col("r_name")).alias("state"),
        F.concat(F.lit("CITY "), (line % 3).cast("string")).alias("city"),
        F.concat(F.lit("54 - "), "n_name").alias("naics"),
        F.when(sup % 23 != 0, F.lpad(((sup % 150) * 10 + sup % 10).cast("string"), 4, "0")).alias("tax4"),
        F.when(flag != "N", qty).alias("initial_approvals"),
        F.when(flag == "R", line).alias("initial_denials"),
        F.when(line != 3, qty + 1).alias("continuing_approvals"),
        F.when(flag == "A", line).alias("continuing_denials"),
        F.when(flag == "A", qty).alias("new_employment_approvals"),
    )


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

REGISTRY = f"""registry AS (
  SELECT {FY.format(d="l_shipdate")} AS fiscal_year,
    'registry_' || {FY.format(d="l_shipdate")} AS source_file,
    CASE WHEN s_suppkey % 17 <> 0 THEN (CASE s_suppkey % 5 WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'BUILDING'
      WHEN 2 THEN 'FURNITURE' WHEN 3 THEN 'HOUSEHOLD' ELSE 'MACHINERY' END)
      || ' GROUP ' || (s_suppkey % 150) || ' LLC' END AS employer_name,
    CASE WHEN s_suppkey % 17 <> 0 THEN (CASE s_suppkey % 5 WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'BUILDING'
      WHEN 2 THEN 'FURNITURE' WHEN 3 THEN 'HOUSEHOLD' ELSE 'MACHINERY' END)
      || ' GROUP ' || (s_suppkey % 150) END AS norm,
    CASE WHEN s_suppkey % 19 <> 0 THEN r_name END AS state,
    'CITY ' || (l_linenumber % 3) AS city,
    CASE WHEN s_suppkey % 23 <> 0 THEN lpad(CAST((s_suppkey % 150) * 10 + s_suppkey % 10 AS VARCHAR), 4, '0') END AS tax4,
    CASE WHEN l_returnflag <> 'N' THEN CAST(l_quantity AS INTEGER) END AS initial_approvals,
    CASE WHEN l_returnflag = 'R' THEN l_linenumber END AS initial_denials,
    CASE WHEN l_linenumber <> 3 THEN CAST(l_quantity AS INTEGER) + 1 END AS continuing_approvals,
    CASE WHEN l_returnflag = 'A' THEN l_linenumber END AS continuing_denials,
    CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS INTEGER) END AS new_employment_approvals
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""


def aliases(spark: SparkSession, d: str) -> DataFrame:
    """Parts as the spellings of employers: brand is the employer, name the spelling."""
    from docketry.functions.names import normalize_name

    p = table(spark, d, "part")
    name = F.initcap(F.concat_ws(" ", "p_name", "p_type", "p_brand"))
    return (
        p.groupBy((F.col("p_size") * 100 + F.length("p_type")).cast("bigint").alias("employer_id"), name.alias("name"))
        .agg(F.count(F.lit(1)).cast("int").alias("rows"))
        .withColumn("norm", normalize_name(F.col("name")))
    )
