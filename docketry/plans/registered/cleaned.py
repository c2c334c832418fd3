"""Cleaning, mapping, dedup and name queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.functions import clean, display, names
from docketry.functions.rules import role_group, with_exempt_rule
from docketry.operators.ordering import dense_index, latest_wins
from docketry.operators.slugs import assign_slugs
from docketry.plans.registered.base import FQ, FY, query, table
from docketry.sources import cases as case_files


@query(
    "clean_text",
    r"""WITH t AS (SELECT doc_id, nullif(trim(regexp_replace(text, '\s+', ' ', 'g')), '') AS c FROM documents)
    SELECT doc_id, CAST(length(c) AS INTEGER) AS chars, md5(c) AS digest FROM t""",
)
def clean_text(spark, d):
    c = clean.text(F.col("text"))
    return table(spark, d, "documents").select(
        "doc_id", F.length(c).alias("chars"), F.md5(c).alias("digest")
    )


@query(
    "clean_money",
    """WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN ' $' || CAST(o_totalprice AS DECIMAL(18,2)) || ' '
        WHEN 1 THEN CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS VARCHAR) || ',000' WHEN 2 THEN o_orderpriority
        ELSE CAST(o_custkey AS VARCHAR) END AS cell FROM orders)
    SELECT o_orderkey, TRY_CAST(regexp_replace(trim(cell), '[$,]', '', 'g') AS DOUBLE) AS amount,
        TRY_CAST(trim(cell) AS INTEGER) AS whole FROM t""",
)
def clean_money(spark, d):
    key = F.col("o_orderkey")
    cell = (
        F.when(key % 4 == 0, F.concat(F.lit(" $"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(" ")))
        .when(key % 4 == 1, F.concat(F.floor(F.col("o_totalprice") / 1000).cast("string"), F.lit(",000")))
        .when(key % 4 == 2, F.col("o_orderpriority"))
        .otherwise(F.col("o_custkey").cast("string"))
    )
    return table(spark, d, "orders").select(
        "o_orderkey", clean.money(cell).alias("amount"), clean.whole(cell).alias("whole")
    )


@query(
    "clean_date_serial",
    """SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day
    FROM orders""",
)
def clean_date_serial(spark, d):
    day, p = F.col("o_orderdate").cast("date"), F.col("o_orderpriority")
    serial = F.datediff(day, F.lit("1899-12-30").cast("date")).cast("string")
    cell = (
        F.when(p == "1-URGENT", F.concat(F.lit(" "), serial))
        .when(p == "2-HIGH", F.concat(serial, F.lit(".75")))
        .when(p == "3-MEDIUM", F.date_format(day, "yyyy-MM-dd"))
        .when(p == "4-NOT SPECIFIED", F.date_format(day, "yyyy-MM-dd 00:00:00"))
        .otherwise(p)
    )
    return table(spark, d, "orders").select("o_orderkey", clean.serial_date(cell).alias("day"))


@query(
    "clean_flags",
    """SELECT event_type, CASE event_type WHEN 'view' THEN true WHEN 'click' THEN true WHEN 'purchase' THEN false
        WHEN 'signup' THEN false END AS flag, count(*) AS n FROM events GROUP BY ALL""",
)
def clean_flags(spark, d):
    cell = clean.lookup(
        F.col("event_type"),
        {"view": "Y", "click": " yes ", "purchase": "No", "signup": "n", "error": "N/A"},
    )
    flags = table(spark, d, "events").select("event_type", clean.yes_no(cell).alias("flag"))
    return flags.groupBy("event_type", "flag").agg(F.count(F.lit(1)).alias("n"))


@query(
    "clean_id",
    r"""WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '12-3456789' WHEN o_orderkey % 7 = 1
          THEN repeat(CAST(o_custkey % 10 AS VARCHAR), 9)
          ELSE ' ' || lpad(CAST(o_orderkey * 48271 + o_custkey AS VARCHAR), 9, '0') || '-' END AS cell FROM orders),
      u AS (SELECT o_orderkey, regexp_replace(cell, '[^0-9]', '', 'g') AS digits FROM t)
    SELECT o_orderkey, CASE WHEN length(digits) = 9 AND digits NOT IN ('123456789', '987654321', '012345678')
        AND digits <> repeat(left(digits, 1), 9) AND left(digits, 2) <> '00'
        THEN left(digits, 2) || '-' || right(digits, 7) END AS id FROM u""",
)
def clean_id(spark, d):
    key = F.col("o_orderkey")
    cell = (
        F.when(key % 7 == 0, "12-3456789")
        .when(key % 7 == 1, F.repeat((F.col("o_custkey") % 10).cast("string"), 9))
        .otherwise(F.concat(F.lit(" "), _pad9(key * 48271 + F.col("o_custkey")), F.lit("-")))
    )
    return table(spark, d, "orders").select("o_orderkey", clean.tax_id(cell).alias("id"))


def _pad9(c):
    return F.lpad(c.cast("string"), 9, "0")


@query(
    "clean_status",
    """SELECT CASE WHEN o_orderstatus = 'F' THEN 'Certified' WHEN o_orderstatus = 'O' THEN 'Certified - Withdrawn'
        WHEN o_orderpriority = '1-URGENT' THEN 'Denied' WHEN o_orderpriority = '2-HIGH' THEN 'Withdrawn'
        ELSE 'UNKNOWN:' || upper(o_orderpriority) END AS status, count(*) AS n FROM orders GROUP BY 1""",
)
def clean_status(spark, d):
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    cell = (
        F.when(s == "F", " certified ")
        .when(s == "O", "Certified  -  Withdrawn")
        .when(p == "1-URGENT", "DENIED")
        .when(p == "2-HIGH", "withdrawn")
        .otherwise(F.lower(p))
    )
    rows = table(spark, d, "orders").select(clean.status(cell).alias("status"))
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "clean_state_and_code",
    """SELECT c_custkey, CASE c_nationkey WHEN 0 THEN 'MN' WHEN 1 THEN 'NY' WHEN 2 THEN 'VA' WHEN 3 THEN 'ZZ' END AS state,
        CASE WHEN c_nationkey < 5 THEN lpad(CAST(10 + c_nationkey AS VARCHAR), 2, '0') || '-' ||
          lpad(CAST(1000 + c_custkey % 9000 AS VARCHAR), 4, '0') END AS code,
        CASE WHEN c_mktsegment = 'BUILDING' THEN 'IV' WHEN c_mktsegment = 'MACHINERY' THEN 'II' END AS level
    FROM customer""",
)
def clean_state_and_code(spark, d):
    nation, seg = F.col("c_nationkey"), F.col("c_mktsegment")
    state = (
        F.when(nation == 0, "Minnesota ").when(nation == 1, " ny").when(nation == 2, "VIRGINIA")
        .when(nation == 3, "zz").when(nation == 4, "").otherwise("Atlantis")
    )
    digits = F.concat(F.lpad((nation + 10).cast("string"), 2, "0"),
                      F.when(nation % 2 == 0, "-").otherwise(""),
                      F.lpad((F.col("c_custkey") % 9000 + 1000).cast("string"), 4, "0"))
    code = F.when(nation < 5, F.concat(digits, F.lit(".00"))).otherwise("n/a")
    level = F.when(seg == "BUILDING", " iv").when(seg == "MACHINERY", "II ").otherwise(seg)
    return table(spark, d, "customer").select(
        "c_custkey",
        clean.state_code(state).alias("state"),
        clean.soc_code(code).alias("code"),
        clean.wage_level(level).alias("level"),
    )


@query(
    "map_union_by_name",
    f"""SELECT o_orderkey AS case_number, {FY.format(d="o_orderdate")} AS fiscal_year,
        CASE WHEN {FY.format(d="o_orderdate")} <= 1997 THEN NULL ELSE o_custkey END AS employer,
        CAST(o_totalprice AS DECIMAL(18,2)) AS amount, 'file_' || {FY.format(d="o_orderdate")} AS source_file
    FROM orders""",
)
def map_union_by_name(spark, d):
    orders = table(spark, d, "orders").withColumn("fy", display.fiscal_year(F.col("o_orderdate")).cast("int"))
    # Two header generations of the same table: the older one does not publish the employer.
    old = orders.where("fy <= 1997").select("fy", F.col("o_orderkey").alias("Case Number"), F.col("o_totalprice").alias("Pay"))
    new = orders.where("fy > 1997").select("fy", F.col("o_orderkey").alias("CASE_NO"), F.col("o_custkey").alias("EMP"), F.col("o_totalprice").alias("AMOUNT"))
    maps = [
        (old, {"case_number": "Case Number", "employer": None, "amount": "Pay"}),
        (new, {"case_number": "CASE_NO", "employer": "EMP", "amount": "AMOUNT"}),
    ]
    types = {"case_number": "bigint", "employer": "bigint", "amount": "decimal(18,2)"}
    parts = [
        df.select(
            *[
                (F.lit(None) if h is None else F.col(f"`{h}`")).cast(types[c]).alias(c)
                for c, h in m.items()
            ],
            F.col("fy").alias("fiscal_year"),
            F.concat(F.lit("file_"), "fy").alias("source_file"),
        )
        for df, m in maps
    ]
    return case_files.union_releases(parts)


LATEST_LINES = """latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_shipdate DESC, l_extendedprice DESC, l_partkey, l_suppkey, l_quantity DESC, l_discount, l_tax,
      l_returnflag, l_linestatus) AS rn
    FROM lineitem) WHERE rn = 1)"""


def line_order():
    up = ["l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    return [F.desc("l_shipdate"), F.desc("l_extendedprice"), F.asc("l_partkey"), F.asc("l_suppkey"),
            F.desc("l_quantity"), *[F.asc(c) for c in up]]


@query(
    "dedup_latest",
    f"WITH {LATEST_LINES} SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice, l_partkey FROM latest",
)
def dedup_latest(spark, d):
    rows = latest_wins(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], line_order())
    return rows.select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_partkey")


@query(
    "dedup_superseded_count",
    """SELECT count(*) AS staged, count(DISTINCT (l_orderkey, l_linenumber)) AS kept,
        count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS superseded FROM lineitem""",
)
def dedup_superseded_count(spark, d):
    per_key = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.sum("n").alias("staged"), F.count(F.lit(1)).alias("kept"), F.sum(F.col("n") - 1).alias("superseded")
    )


PART_ROLES = """WITH t AS (SELECT p_partkey, p_size, CASE p_size % 8 WHEN 0 THEN '15-1252' WHEN 1 THEN '15-2051' WHEN 2 THEN '13-2011'
    WHEN 3 THEN '15-2031' WHEN 4 THEN '15-1299' WHEN 5 THEN '17-2' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0')
    WHEN 6 THEN '15-1253.00' END AS soc FROM part)"""


@query(
    "role_group_map",
    PART_ROLES + """ SELECT CASE p_size % 8 WHEN 0 THEN 'Software engineering' WHEN 1 THEN 'Data and analytics'
      WHEN 2 THEN 'Finance' WHEN 3 THEN 'Quant and actuarial' WHEN 4 THEN 'IT and systems' WHEN 5 THEN 'Engineering'
      WHEN 6 THEN 'Software engineering' ELSE 'Other' END AS role_group, count(*) AS parts,
      count(soc) AS with_code FROM t GROUP BY 1""",
)
def role_group_map(spark, d):
    size = F.col("p_size") % 8
    raw = (
        F.when(size == 0, "15-1252").when(size == 1, "152051").when(size == 2, "13-2011.00")
        .when(size == 3, "15-2031").when(size == 4, "15-1299.08")
        .when(size == 5, F.concat(F.lit("17-2"), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0")))
        .when(size == 6, "15-1253.00")
    )
    code = clean.soc_code(raw)
    rows = table(spark, d, "part").select(code.alias("code"), role_group(code).alias("role_group"))
    return rows.groupBy("role_group").agg(F.count(F.lit(1)).alias("parts"), F.count("code").alias("with_code"))


@query(
    "rule_flags",
    r"""WITH register AS (SELECT s_suppkey * 7 AS id, CASE WHEN s_suppkey % 2 = 0 THEN '03' ELSE '04' END AS subsection FROM supplier),
      reg AS (SELECT DISTINCT id FROM register WHERE subsection = '03'),
      emp AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'State University ' ELSE 'Acme ' END || c_mktsegment AS name,
        CASE c_custkey % 4 WHEN 0 THEN '611310' WHEN 1 THEN '611110' WHEN 2 THEN '622110' ELSE '541511' END AS naics FROM customer)
    SELECT c_custkey, CASE WHEN c_custkey IN (SELECT id FROM reg) THEN 'irs_nonprofit' WHEN naics = '611310' THEN 'naics_611310'
      WHEN left(naics, 2) IN ('61', '62') AND regexp_matches(upper(name), '\b(UNIVERSITY|COLLEGE)\b') THEN 'name_higher_ed'
      END AS rule FROM emp""",
)
def rule_flags(spark, d):
    sup, key = F.col("s_suppkey"), F.col("c_custkey")
    register = table(spark, d, "supplier").select(
        (sup * 7).alias("fein"),
        F.when(sup % 2 == 0, "03").otherwise("04").alias("subsection"),
        F.when(sup % 3 == 0, "B42").when(sup % 3 == 1, "H20").otherwise("U").alias("ntee"),
    )
    emp = table(spark, d, "customer").select(
        "c_custkey",
        F.concat(F.when(key % 5 == 0, "State University ").otherwise("Acme "), "c_mktsegment").alias("display_name"),
        F.get(F.array(*[F.lit(x) for x in ("611310", "611110", "622110", "541511")]), (key % 4).cast("int")).alias("naics"),
        key.alias("fein"),
    )
    return with_exempt_rule(emp, register, out="rule").select("c_custkey", "rule")


NORM_SQL = r"""s1 AS (SELECT *, upper(regexp_replace(strip_accents(raw), '[^\x00-\x7F]', '', 'g')) AS s FROM src),
  s2 AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(s, '\s(D\s*/\s*B\s*/\s*A|DBA)\b.*$', ''),
      '[.''`]', '', 'g'), '[^A-Z0-9]+', ' ', 'g')) AS t FROM s1),
  s3 AS (SELECT *, array_to_string(list_filter(string_split(t, ' '), lambda x: x <> 'AND'), ' ') AS u FROM s2),
  s4 AS (SELECT *, CASE WHEN t <> '' AND u = '' THEN 'AND' ELSE u END AS v FROM s3),
  normed AS (SELECT *, regexp_replace(regexp_replace(v,
      '( (INC|LLC|LLP|CORP|CORPORATION|CO|LTD|LP|PLLC|INCORPORATED|LIMITED|COMPANY|PC))+$', ''), '^THE (.)', '\1') AS norm FROM s4)"""


@query(
    "name_normalize",
    r"""WITH src AS (SELECT page_id, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\s+', ' ', 'g'))
       || CASE page_id % 5 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' Co., Ltd.' WHEN 2 THEN ' d/b/a Other' WHEN 3 THEN ' and' ELSE '' END AS raw FROM pages),
    """ + NORM_SQL + " SELECT page_id, norm FROM normed",
)
def name_normalize(spark, d):
    key = F.col("page_id") % 5
    suffix = F.when(key == 0, ", Inc.").when(key == 1, " Co., Ltd.").when(key == 2, " d/b/a Other").when(key == 3, " and").otherwise("")
    title = F.trim(F.regexp_replace(F.regexp_extract("html", "<title>([^<]*)</title>", 1), r"\s+", " "))
    return table(spark, d, "pages").select("page_id", names.normalize_name(F.concat(title, suffix)).alias("norm"))


@query(
    "name_normalize_documents",
    r"""WITH src AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS raw FROM documents),
    """ + NORM_SQL + " SELECT doc_id, CAST(length(norm) AS INTEGER) AS chars, md5(norm) AS digest FROM normed",
)
def name_normalize_documents(spark, d):
    norm = names.normalize_name(clean.text(F.col("text")))
    return table(spark, d, "documents").select("doc_id", F.length(norm).alias("chars"), F.md5(norm).alias("digest"))


@query(
    "distinct_names",
    r"""WITH src AS (SELECT DISTINCT p_name || ' ' || p_type || ' Co.' AS raw FROM part WHERE p_name IS NOT NULL),
    """ + NORM_SQL + " SELECT raw, norm FROM normed",
)
def distinct_names(spark, d):
    named = table(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_type", F.lit("Co.")).alias("name"))
    return names.distinct_names(named, "name")


SLUG_SQL = """ranked AS (SELECT *, row_number() OVER (ORDER BY volume DESC, key) AS rank FROM src),
  sl1 AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY rank) AS n1 FROM ranked),
  sl2 AS (SELECT *, CASE WHEN n1 > 1 THEN row_number() OVER (PARTITION BY base, n1 > 1, area ORDER BY rank) END AS n2 FROM sl1),
  sl3 AS (SELECT *, CASE WHEN n2 > 1 AND tail IS NOT NULL THEN row_number() OVER (PARTITION BY base, n2 > 1, tail ORDER BY rank) END AS n3 FROM sl2),
  sl4 AS (SELECT *, n2 > 1 AND (n3 IS NULL OR n3 > 1) AS numbered FROM sl3),
  slugged AS (SELECT *, CASE WHEN n1 = 1 THEN base WHEN n2 = 1 THEN base || '-' || area WHEN n3 = 1 THEN base || '-' || tail
    ELSE base || '-' || (1 + row_number() OVER (PARTITION BY base, numbered ORDER BY rank)) END AS slug FROM sl4)"""


@query(
    "slugify_unique",
    """WITH src AS (SELECT p_partkey AS key, p_retailprice AS volume, replace(p_name, ' ', '-') AS base,
        'r' || p_size % 3 AS area, CASE WHEN p_size % 2 = 0 THEN 'x' || right('000' || p_partkey % 500, 3) END AS tail FROM part),
    """ + SLUG_SQL + " SELECT key AS p_partkey, rank, slug FROM slugged",
)
def slugify_unique(spark, d):
    part = table(spark, d, "part").withColumn("_base", names.slugify(F.col("p_name")))
    ranked = dense_index(part, [F.desc("p_retailprice"), F.asc("p_partkey")], "rank")
    base = F.col("_base")
    tail = F.lpad((F.col("p_partkey") % 500).cast("string"), 3, "0")
    choices = [
        base,
        F.concat(base, F.lit("-r"), (F.col("p_size") % 3).cast("string")),
        F.when(F.col("p_size") % 2 == 0, F.concat(base, F.lit("-x"), tail)),
    ]
    return assign_slugs(ranked, "rank", choices, base).select("p_partkey", "rank", "slug")


@query(
    "chunk_keys",
    """SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS id,
        CAST((row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1) // 40000 AS INTEGER) AS chunk FROM orders""",
)
def chunk_keys(spark, d):
    from docketry.plans.profile import key_chunks

    ranked = dense_index(table(spark, d, "orders"), [F.desc("o_totalprice"), F.asc("o_orderkey")], "id")
    return key_chunks(ranked, "id").select("o_orderkey", "id", "chunk")


@query(
    "format_quarter_end",
    f"""WITH t AS (SELECT {FY.format(d="o_orderdate")} AS fy, {FQ.format(d="o_orderdate")} AS q FROM orders)
    SELECT fy, q, CAST(make_date(fy - 1, 10, 1) + INTERVAL (q * 3) MONTH - INTERVAL 1 DAY AS DATE) AS covered_until,
      strftime(make_date(fy - 1, 10, 1) + INTERVAL (q * 3) MONTH - INTERVAL 1 DAY, '%B %-d, %Y') AS shown,
      q < 4 AS partial, count(*) AS n FROM t GROUP BY ALL""",
)
def format_quarter_end(spark, d):
    fy, q = display.fiscal_year(F.col("o_orderdate")).cast("int"), display.fiscal_quarter(F.col("o_orderdate"))
    counted = table(spark, d, "orders").groupBy(fy.alias("fy"), q.alias("q")).agg(F.count(F.lit(1)).alias("n"))
    end = display.quarter_end(F.col("fy"), F.col("q"))
    return counted.select(
        "fy", "q", end.alias("covered_until"), display.long_date(end).alias("shown"),
        display.is_partial_year(F.col("q")).alias("partial"), "n",
    )


@query(
    "format_numbers",
    """WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 6 <> 0 THEN floor(c_acctbal * c_custkey) END AS x, c_acctbal FROM customer)
    SELECT c_custkey, coalesce(format('{:,}', CAST(x AS BIGINT)), '–') AS int_text,
      coalesce('$' || format('{:,}', CAST(x AS BIGINT)), '–') AS usd_text,
      coalesce(CAST(CASE WHEN x > 0 THEN floor(100.0 * c_custkey / x + 0.5) END AS INTEGER) || '%', '–') AS pct_text
    FROM t""",
)
def format_numbers(spark, d):
    key = F.col("c_custkey")
    x = F.when(key % 6 != 0, F.floor(F.col("c_acctbal") * key))
    return table(spark, d, "customer").select(
        "c_custkey",
        display.int_text(x).alias("int_text"),
        display.usd_text(x).alias("usd_text"),
        display.percent_text(key, x).alias("pct_text"),
    )


@query(
    "source_labels",
    f"""WITH t AS (SELECT DISTINCT {FY.format(d="o_orderdate")} AS fy, {FQ.format(d="o_orderdate")} AS q FROM orders)
    SELECT 'LCA_Disclosure_Data_FY' || fy || '_Q' || q || '.xlsx' AS file, 'DOL LCA FY' || fy || ' Q' || q AS label FROM t
    UNION ALL SELECT 'uscis_hub_FY' || fy || '.csv' AS file, 'USCIS Data Hub FY' || fy FROM (SELECT DISTINCT fy FROM t)
    UNION ALL SELECT 'LCA_Disclosure_Data_FY' || fy || '_Q1-Q4 + LCA_Worksites_FY_' || (fy + 1) || '_Q3.xlsx',
      'DOL LCA FY' || fy || ' Q1-Q4 + FY' || (fy + 1) || ' Q3' FROM (SELECT DISTINCT fy FROM t)""",
)
def source_labels(spark, d):
    fy, q = display.fiscal_year(F.col("o_orderdate")).cast("int"), display.fiscal_quarter(F.col("o_orderdate"))
    t = table(spark, d, "orders").select(fy.alias("fy"), q.alias("q")).distinct()
    years = t.select("fy").distinct()
    quarterly = t.select(F.concat(F.lit("LCA_Disclosure_Data_FY"), "fy", F.lit("_Q"), "q", F.lit(".xlsx")).alias("file"))
    hub = years.select(F.concat(F.lit("uscis_hub_FY"), "fy", F.lit(".csv")))
    both = years.select(F.concat(F.lit("LCA_Disclosure_Data_FY"), "fy", F.lit("_Q1-Q4 + LCA_Worksites_FY_"),
                                 F.col("fy") + 1, F.lit("_Q3.xlsx")))
    files = quarterly.union(hub).union(both)
    return files.withColumn("label", display.source_label(F.col("file")))


@query(
    "scalar_idioms",
    """WITH t AS (SELECT event_id, event_type, props, CAST(json_extract(props, '$.k') AS INTEGER) AS k, value FROM events)
    SELECT event_id, k, floor(value) AS low, round(CAST(value AS DECIMAL(18,2)), 1) AS near, nullif(event_type, 'error') AS kind,
      k BETWEEN 10 AND 20 AS in_range, upper(left(event_type, 2)) || '-' || right(event_type, 2) AS code,
      CASE WHEN k > 0 THEN CAST(floor(100.0 * floor(value) / k + 0.5) AS INTEGER) END AS pct FROM t""",
)
def scalar_idioms(spark, d):
    k, kind = F.get_json_object("props", "$.k").cast("int"), F.col("event_type")
    return table(spark, d, "events").select(
        "event_id",
        k.alias("k"),
        F.floor("value").cast("double").alias("low"),
        F.round(F.col("value").cast("decimal(18,2)"), 1).alias("near"),
        F.nullif(kind, F.lit("error")).alias("kind"),
        k.between(10, 20).alias("in_range"),
        F.concat(F.upper(F.left(kind, F.lit(2))), F.lit("-"), F.right(kind, F.lit(2))).alias("code"),
        display.percent(F.floor("value"), k).alias("pct"),
    )


@query(
    "alias_note",
    """SELECT p_partkey, CASE WHEN p_size % 2 = 1 THEN p_name || ' of ' || p_brand END AS note FROM part""",
)
def alias_note(spark, d):
    shown = F.concat(F.initcap("p_name"), F.lit(", Inc."))
    alias = F.when(F.col("p_size") % 2 == 1, F.concat_ws(" of ", "p_name", "p_brand")).otherwise(
        F.concat(F.upper("p_name"), F.lit(" L.L.C."))
    )
    return table(spark, d, "part").select("p_partkey", display.alias_note(shown, alias).alias("note"))
