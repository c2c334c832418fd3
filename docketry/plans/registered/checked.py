"""Gates, reconciliation, sampling, links, inventories and incremental arrival."""

from __future__ import annotations

import datetime as dt
import functools
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions.display import fiscal_quarter, fiscal_year
from docketry.operators import aggregates, inventory, quality
from docketry.operators.ordering import latest_wins
from docketry.plans import catalog, clustering
from docketry.plans.registered.base import CASES, cases, query, table
from docketry.session import run_dir
from docketry.sources import links
from docketry.streaming import arrivals, upkeep

LINE_CASES = """lines AS (SELECT CAST(year(l_shipdate) + CASE WHEN month(l_shipdate) >= 10 THEN 1 ELSE 0 END AS INTEGER) AS fiscal_year,
    CAST(floor(((month(l_shipdate) + 2) % 12) / 3) AS INTEGER) + 1 AS quarter,
    'I-' || l_orderkey || '-' || l_linenumber AS case_number,
    CASE l_returnflag WHEN 'A' THEN 'Certified' WHEN 'R' THEN 'Denied' ELSE (CASE l_linestatus WHEN 'O' THEN 'Withdrawn'
      ELSE 'Certified - Withdrawn' END) END AS status FROM lineitem),
  kept AS (SELECT fiscal_year, case_number, arg_max(status, (quarter, status)) AS status FROM lines GROUP BY 1, 2)"""


def line_cases(spark, d):
    flag, line = F.col("l_returnflag"), F.col("l_linestatus")
    status = (
        F.when(flag == "A", "Certified").when(flag == "R", "Denied").when(line == "O", "Withdrawn")
        .otherwise("Certified - Withdrawn")
    )
    return table(spark, d, "lineitem").select(
        fiscal_year(F.col("l_shipdate")).cast("int").alias("fiscal_year"),
        fiscal_quarter(F.col("l_shipdate")).alias("quarter"),
        F.concat_ws("-", F.lit("I"), "l_orderkey", "l_linenumber").alias("case_number"),
        status.alias("status"),
    )


@query(
    "reconcile_measures",
    f"""WITH {LINE_CASES}, w AS (SELECT fiscal_year, count(*) AS submitted, count(*) FILTER (WHERE status = 'Certified') AS certified,
        count(*) FILTER (WHERE status IN ('Withdrawn', 'Certified - Withdrawn')) AS withdrawn,
        count(*) FILTER (WHERE status = 'Denied') AS denied FROM kept GROUP BY 1)
    SELECT fiscal_year, measure, n AS raw_n, n AS published_n, CAST(0 AS BIGINT) AS diff
    FROM (UNPIVOT w ON submitted, certified, withdrawn, denied INTO NAME measure VALUE n)""",
)
def reconcile_measures(spark, d):
    """The published path and the recount, compared; the SQL computes one and expects equality."""
    raw = line_cases(spark, d)
    kept = latest_wins(raw, ["fiscal_year", "case_number"], [F.desc("quarter"), F.desc("status")])
    status = F.col("status")
    published = kept.groupBy("fiscal_year").agg(
        F.count(F.lit(1)).alias("submitted"),
        F.count_if(status == "Certified").alias("certified"),
        F.count_if(status.isin("Withdrawn", "Certified - Withdrawn")).alias("withdrawn"),
        F.count_if(status == "Denied").alias("denied"),
    )
    # The recount sees the raw spelling, with the odd spaces and cases of the files.
    messy = raw.withColumn("status", F.upper(F.concat(F.lit(" "), F.replace("status", F.lit(" - "), F.lit("  -")))))
    recounted = quality.recount(messy, "case_number", "status", "quarter")
    return quality.reconcile(recounted, quality.measures_by_year(published))


@query(
    "row_count_gate",
    """WITH a AS (SELECT l_suppkey AS k, count(*) AS expected FROM lineitem GROUP BY 1),
      b AS (SELECT l_suppkey AS k, count(*) AS actual FROM lineitem WHERE l_quantity > 1 GROUP BY 1)
    SELECT k, expected, actual FROM a FULL JOIN b USING (k) WHERE expected IS DISTINCT FROM actual""",
)
def row_count_gate(spark, d):
    lines = table(spark, d, "lineitem")
    count = F.count(F.lit(1)).alias("rows")
    full = lines.groupBy(F.col("l_suppkey").alias("k")).agg(count)
    loaded = lines.where("l_quantity > 1").groupBy(F.col("l_suppkey").alias("k")).agg(count)
    return quality.count_mismatches(full, loaded, "k")


@query(
    "orphan_children",
    f"""WITH {CASES}, w AS (SELECT DISTINCT CAST(year(l_shipdate) + CASE WHEN month(l_shipdate) >= 10 THEN 1 ELSE 0 END AS INTEGER) AS fiscal_year,
        l_orderkey AS case_number FROM lineitem)
    SELECT fiscal_year, count(*) AS orphans FROM w WHERE NOT EXISTS (SELECT 1 FROM cases c
      WHERE c.fiscal_year = w.fiscal_year AND c.case_number = w.case_number) GROUP BY 1""",
)
def orphan_children(spark, d):
    sites = table(spark, d, "lineitem").select(
        fiscal_year(F.col("l_shipdate")).cast("int").alias("fiscal_year"), F.col("l_orderkey").alias("case_number")
    )
    parents = table(spark, d, "orders").select(
        fiscal_year(F.col("o_orderdate")).cast("int").alias("fiscal_year"), F.col("o_orderkey").alias("case_number")
    )
    return quality.orphan_children(sites, parents, ["fiscal_year", "case_number"], "fiscal_year")


@query(
    "unmapped_statuses",
    """SELECT 'UNKNOWN:' || upper(event_type) AS case_status, count(*) AS "rows" FROM events GROUP BY 1""",
)
def unmapped_statuses(spark, d):
    from docketry.functions.clean import status

    return quality.unmapped_statuses(table(spark, d, "events").select(status(F.col("event_type")).alias("case_status")))


@query(
    "undeclared_years",
    """SELECT DISTINCT 'lines' AS source_file, CAST(year(l_shipdate) AS INTEGER) AS fiscal_year FROM lineitem
    WHERE year(l_shipdate) NOT IN (SELECT year(o_orderdate) + 1 FROM orders)""",
)
def undeclared_years(spark, d):
    def years(name, year):
        return table(spark, d, name).select(F.lit("lines").alias("source_file"), year.alias("fiscal_year"))

    declared = years("orders", F.year("o_orderdate") + 1).distinct()
    return quality.wrong_years(years("lineitem", F.year("l_shipdate")), declared)


@query(
    "fill_rates",
    f"""WITH {CASES} SELECT avg(CASE WHEN employer_fein IS NULL THEN 0.0 ELSE 1.0 END) AS employer_fein,
      avg(CASE WHEN worksite_state IS NULL THEN 0.0 ELSE 1.0 END) AS worksite_state,
      avg(CASE WHEN total_workers IS NULL THEN 0.0 ELSE 1.0 END) AS total_workers FROM cases""",
)
def fill_rates(spark, d):
    return quality.fill_rates(cases(spark, d), ["employer_fein", "worksite_state", "total_workers"])


@query(
    "domain_violations",
    f"""WITH {CASES} SELECT count(*) FILTER (WHERE decision_date NOT BETWEEN make_date(fiscal_year - 1, 10, 1) AND make_date(fiscal_year, 9, 30)) AS outside_year,
      count(*) FILTER (WHERE decision_date - CAST(case_number % 3 AS INTEGER) + 1 > decision_date) AS received_after_decision,
      count(*) AS odd_case_number, count(*) FILTER (WHERE NOT regexp_full_match(role_group, '\\d{{2}}-\\d{{4}}')) AS odd_soc_code,
      count(*) FILTER (WHERE NOT regexp_full_match(employer_fein, '\\d{{2}}-\\d{{7}}')) AS odd_fein FROM cases""",
)
def domain_violations(spark, d):
    rows = cases(spark, d).withColumns(
        {
            "received_date": F.date_add("decision_date", (1 - F.col("case_number") % 3).cast("int")),
            "soc_code": F.col("role_group"),
            "case_number": F.col("case_number").cast("string"),
        }
    )
    return quality.domain_violations(rows)


@query(
    "stratified_sample",
    """WITH h AS (SELECT *, md5(CAST(c_custkey AS VARCHAR)) AS h FROM customer),
      p AS (SELECT * EXCLUDE (r), 0 AS prio FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY h, c_custkey) AS r FROM h) WHERE r = 1
        UNION ALL SELECT * EXCLUDE (r), 0 FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY h, c_custkey) AS r FROM h) WHERE r = 1
        UNION ALL (SELECT *, 1 FROM h ORDER BY h, c_custkey LIMIT 50)),
      u AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY prio) = 1)
    SELECT c_custkey, c_mktsegment, c_nationkey FROM u ORDER BY prio, h, c_custkey LIMIT 50""",
)
def stratified_sample(spark, d):
    rows = quality.stratified_sample(table(spark, d, "customer"), "c_custkey", ["c_mktsegment", "c_nationkey"], 50)
    return rows.select("c_custkey", "c_mktsegment", "c_nationkey")


@query(
    "href_links",
    r"""WITH l AS (SELECT url AS base, unnest(regexp_extract_all(html, '(?i)href="([^"]+)"', 1)) AS link FROM pages)
    SELECT DISTINCT CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN link
      WHEN link LIKE '/%' THEN regexp_extract(base, '^([A-Za-z]+://[^/?#]*)', 1) || link
      ELSE regexp_extract(base, '^([A-Za-z]+://[^?#]*/)', 1) || link END AS url FROM l""",
)
def href_links(spark, d):
    return links.page_links(table(spark, d, "pages"))


@query(
    "newer_releases",
    """WITH p AS (SELECT page_id, 2022 + page_id % 6 AS fy, 1 + page_id % 4 AS q, page_id % 2 = 0 AS main FROM pages),
      f AS (SELECT DISTINCT fy, q, main, CASE WHEN main THEN 'LCA_Disclosure_Data_FY' || fy || '_Q' || q || '.xlsx'
        ELSE 'LCA_Worksites_FY_' || fy || '_Q' || q || '.xlsx' END AS file FROM p)
    SELECT file, 'https://agency.test/files/' || file AS url FROM f WHERE fy >= 2023 AND
      (fy > 2026 OR (main AND fy = 2026 AND q > 3) OR (NOT main AND fy = 2026 AND q > 3))""",
)
def newer_releases(spark, d):
    """Release links put on the given pages, against the declared releases."""
    from docketry.sources.releases import declared_releases, release_table

    key = F.col("page_id")
    fy, q = (key % 6 + 2022).cast("string"), (key % 4 + 1).cast("string")
    name = F.when(key % 2 == 0, F.concat(F.lit("LCA_Disclosure_Data_FY"), fy, F.lit("_Q"), q)).otherwise(
        F.concat(F.lit("LCA_Worksites_FY_"), fy, F.lit("_Q"), q)
    )
    anchor = F.concat(F.lit('<a HREF="/files/'), name, F.lit('.xlsx">x</a>'))
    pages = table(spark, d, "pages").select(
        F.lit("https://agency.test/lists/page").alias("url"), F.concat("html", anchor).alias("html")
    )
    return links.newer_releases(links.page_links(pages), release_table(spark, declared_releases()))


@query("file_inventory")
def file_inventory(spark, d):
    return inventory.file_inventory(spark, d, "*.parquet").select("file", "bytes", "sha256")


@query("change_detection")
def change_detection(spark, d):
    """The folder's files against a record in which some files are absent and some differ."""
    now = inventory.file_inventory(spark, d, "*.parquet")
    first = F.substring("file", 1, 1)
    record = now.where(first != "n").withColumn(
        "sha256", F.when(first == "c", F.lit("0")).otherwise(F.col("sha256"))
    )
    return inventory.changes(record, now)


PAGE_FILES = """now AS (SELECT url AS file, CAST(strlen(ifnull(html, '')) AS BIGINT) AS bytes, sha256(ifnull(html, '')) AS sha256 FROM pages)"""


@query("page_inventory", f"WITH {PAGE_FILES} SELECT * FROM now")
def page_inventory(spark, d):
    return inventory.row_inventory(table(spark, d, "pages"), "url", "html")


@query(
    "page_changes",
    """SELECT if(page_id % 11 = 3, url || '#gone', url) AS file, CASE WHEN page_id % 11 = 3 THEN 'missing' WHEN page_id % 7 = 2 THEN 'changed'
      ELSE 'unchanged' END AS state FROM pages WHERE page_id % 5 <> 1
    UNION ALL SELECT url, 'new' FROM pages WHERE page_id % 5 = 1 OR page_id % 11 = 3""",
)
def page_changes(spark, d):
    """The pages against a record that lacks some, holds older ones, and names some that are gone."""
    pages, key = table(spark, d, "pages"), F.col("page_id")
    old = pages.where(key % 5 != 1).select(
        F.when(key % 11 == 3, F.concat("url", F.lit("#gone"))).otherwise(F.col("url")).alias("url"),
        F.when(key % 7 == 2, F.concat("html", F.lit("!"))).otherwise(F.col("html")).alias("html"),
    )
    return inventory.changes(inventory.row_inventory(old, "url", "html"), inventory.row_inventory(pages, "url", "html"))


@query(
    "stream_upsert_latest",
    """WITH e AS (SELECT user_id, event_type, CAST(2020 + user_id % 3 AS INTEGER) AS fiscal_year, ts, event_id, value FROM events)
    SELECT user_id, event_type, fiscal_year, event_id, value FROM e
    QUALIFY row_number() OVER (PARTITION BY fiscal_year, user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""",
)
def stream_upsert_latest(spark, d):
    """The events arrive in two releases; the state after both is the latest per key."""
    events = table(spark, d, "events").withColumn("fiscal_year", (F.col("user_id") % 3 + 2020).cast("int"))
    root = f"{run_dir(spark)}/arrivals/{uuid.uuid4().hex}"
    middle = events.agg(F.expr("min(ts) + (max(ts) - min(ts)) / 2").alias("_middle"))
    staged = events.crossJoin(F.broadcast(middle))  # one row
    order = [F.desc("ts"), F.desc("event_id")]
    for late in (False, True):
        part = staged.where((F.col("ts") >= F.col("_middle")) == late).drop("_middle")
        part.write.parquet(f"{root}/staged/release={int(late)}")
        rows = arrivals.year_stream(spark, f"{root}/staged", events.schema)
        arrivals.run_arrivals(rows, root, ["fiscal_year", "user_id", "event_type"], order)
    return arrivals.current_rows(spark, root).select("user_id", "event_type", "fiscal_year", "event_id", "value")


@query(
    "arrivals_upkeep",
    """WITH e AS (SELECT user_id, event_type, CAST(2020 + user_id % 3 AS INTEGER) AS fiscal_year, CAST(event_id % 7 AS INTEGER) AS batch, event_id FROM events),
      held AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY fiscal_year, user_id, event_type ORDER BY batch DESC, event_id DESC) = 1)
    SELECT 'log' AS part, fiscal_year, batch, count(*) AS "rows", sum(event_id) AS checksum FROM e GROUP BY ALL
    UNION ALL SELECT 'held', fiscal_year, NULL, count(*), sum(event_id) FROM held GROUP BY ALL""",
)
def arrivals_upkeep(spark, d):
    """The events in seven batches with upkeep between them: the merged log, and the state."""
    key = F.col("event_id") % 7
    events = table(spark, d, "events").select(
        "user_id", "event_type", (F.col("user_id") % 3 + 2020).cast("int").alias("fiscal_year"), key.cast("int").alias("n"), "event_id"
    )
    root = f"{run_dir(spark)}/arrivals/{uuid.uuid4().hex}"
    order = [F.desc("n"), F.desc("event_id")]
    for n in range(7):
        arrivals.take_batch(events.where(F.col("n") == n), n, root, ["fiscal_year", "user_id", "event_type"], order)
        if n % 3 == 2:
            upkeep.upkeep(spark, root, fan=2)
    sums = F.count(F.lit(1)).alias("rows"), F.sum("event_id").alias("checksum")
    log = upkeep.logged_rows(spark, root).groupBy(F.lit("log").alias("part"), "fiscal_year", "batch").agg(*sums)
    held = arrivals.current_rows(spark, root).groupBy("fiscal_year").agg(*sums)
    return log.unionByName(held.withColumns({"part": F.lit("held"), "batch": F.lit(None).cast("int")}))


@query(
    "published_counts",
    f"WITH {CASES} SELECT 'cases' AS name, count(*) AS \"rows\" FROM cases UNION ALL SELECT 'pay', count(*) FROM cases WHERE wage_valid",
)
def published_counts(spark, d):
    """Two tables published under one version, counted through the pointer."""
    from docketry.plans.publish import publish, read_published
    from docketry.sources.cases import union_releases

    rows = cases(spark, d).select("case_number", "fiscal_year", "wage_annual", "wage_valid")
    root = f"{run_dir(spark)}/published/{uuid.uuid4().hex}"
    tables = {"cases": rows, "pay": rows.where("wage_valid")}
    publish(tables, root, "1", partition_by={"cases": ["fiscal_year"]})
    return union_releases(
        [
            read_published(spark, root, n).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows"))
            for n in tables
        ]
    )


@query(
    "export_guard",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '''=' || c_name WHEN 1 THEN '''@' || c_name WHEN 2 THEN c_name
      ELSE '''-' || c_name END AS cell FROM customer""",
)
def export_guard(spark, d):
    from docketry.functions.display import guard_formula

    key = F.col("c_custkey") % 4
    prefix = F.when(key == 0, "=").when(key == 1, "@").when(key == 2, "").otherwise("-")
    return table(spark, d, "customer").select(
        "c_custkey", guard_formula(F.concat(prefix, "c_name")).alias("cell")
    )


@query(
    "entity_rows_ordered",
    f"""WITH {CASES} SELECT employer_id, count(*) AS n, min(decision_date) AS first_day FROM cases GROUP BY 1""",
)
def entity_rows_ordered(spark, d):
    """Clustered write: a table sorted by id within its files, read back."""
    from docketry.plans.publish import publish, read_published

    counted = cases(spark, d).groupBy("employer_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("decision_date").alias("first_day")
    )
    root = f"{run_dir(spark)}/published/{uuid.uuid4().hex}"
    publish({"entity_rows": counted}, root, "1", sort_by={"entity_rows": ["employer_id"]})
    return read_published(spark, root, "entity_rows")


@query(
    "clustered_ranges",
    f"""WITH {CASES}, b(box, low, high, first, last) AS (VALUES ('ids', 1, 20, DATE '1900-01-01', DATE '2100-01-01'),
        ('year', 0, 2000000000, DATE '1996-01-01', DATE '1996-12-31'), ('both', 10, 60, DATE '1995-06-01', DATE '1996-02-01'))
    SELECT box, CAST(0 AS BIGINT) AS overlaps, (SELECT count(*) FROM cases) AS stored, true AS skipped, count(*) AS "rows", sum(case_number) AS checksum
    FROM b JOIN cases ON employer_id BETWEEN low AND high AND decision_date BETWEEN first AND last GROUP BY box""",
)
def clustered_ranges(spark, d):
    """A table clustered by employer and day: file ranges apart, three boxes read through them."""
    rows = cases(spark, d).select("employer_id", "decision_date", "case_number")
    columns = ["employer_id", "decision_date"]
    path = f"{run_dir(spark)}/clustered/{uuid.uuid4().hex}"
    clustering.write_clustered(rows, path, columns, files=16)
    ranges = clustering.file_ranges(spark, path)
    facts = clustering.overlaps(spark, path).crossJoin(ranges.agg(F.sum("rows").alias("stored"), F.count(F.lit(1)).alias("files")))
    day = dt.date
    boxes = {
        "ids": {"employer_id": (1, 20)},
        "year": {"decision_date": (day(1996, 1, 1), day(1996, 12, 31))},
        "both": {"employer_id": (10, 60), "decision_date": (day(1995, 6, 1), day(1996, 2, 1))},
    }
    out = []
    for box, within in boxes.items():
        found = clustering.read_clustered(spark, path, columns, within)
        opened = len(found.inputFiles())
        counted = found.agg(F.count(F.lit(1)).alias("rows"), F.sum("case_number").alias("checksum"))
        out.append(
            counted.crossJoin(facts).select(
                F.lit(box).alias("box"), "overlaps", "stored", (F.lit(opened) < F.col("files")).alias("skipped"), "rows", "checksum"
            )
        )
    return functools.reduce(DataFrame.unionByName, out)


@query(
    "catalog_switch",
    f"""WITH {CASES} SELECT 1 AS step, 'case_number bigint, fiscal_year int' AS columns, count(*) AS "rows" FROM cases WHERE fiscal_year < 1996
    UNION ALL SELECT 2, 'case_number bigint, fiscal_year int, wage_valid boolean', count(*) FROM cases""",
)
def catalog_switch(spark, d):
    """A table read by its name before and after a switch, its columns from the catalog."""
    name = uuid.uuid4().hex
    database, root = f"load_{name}", f"{run_dir(spark)}/catalog/{name}"
    rows = cases(spark, d).select("case_number", "fiscal_year", "wage_valid")
    out = []
    for step, load in enumerate([rows.where("fiscal_year < 1996").drop("wage_valid"), rows], 1):
        catalog.publish_by_name({"cases": load, "years": load.select("fiscal_year").distinct()}, database, root, str(step))
        catalog.require_columns(spark, database, "cases", ["case_number"])
        columns = ", ".join(f"{c} {t}" for c, t in catalog.catalog_columns(spark, database, "cases").items())
        read = catalog.read_by_name(spark, database, "cases")
        out.append(read.agg(F.lit(step).alias("step"), F.lit(columns).alias("columns"), F.count(F.lit(1)).alias("rows")))
    return out[0].unionByName(out[1])


@query(
    "year_recent",
    f"""WITH {CASES} SELECT DISTINCT fiscal_year FROM cases ORDER BY 1 DESC LIMIT 2""",
)
def year_recent(spark, d):
    return aggregates.last_years(cases(spark, d))
