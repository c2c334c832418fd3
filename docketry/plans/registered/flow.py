"""The whole flow under the oracle: canonical rows through all published tables, then a page."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.plans import profile
from docketry.plans.case_flow import build_tables, meta_table, meta_years
from docketry.plans.registered.base import cases, query, registry
from docketry.plans.registered.linked import LINKED, NEW_SLUGS


def tables(spark, d):
    rows = cases(spark, d).drop("employer_id").withColumn("soc_code", F.lit(None).cast("string"))
    return build_tables(rows, registry(spark, d))


REGISTRY_TOTALS = """given AS (SELECT final_id, CAST(sum(initial_approvals) AS INTEGER) AS n FROM registry u JOIN final f
    ON u.norm = f.norm AND u.state IS NOT DISTINCT FROM f.state AND u.tax4 IS NOT DISTINCT FROM f.tax4 GROUP BY final_id)"""


@query(
    "flow_employers",
    f"""WITH {LINKED}, {NEW_SLUGS}, {REGISTRY_TOTALS}, mine AS (SELECT e.employer_id, CAST(count_if(case_status = 'Certified') AS INTEGER) AS c
        FROM keyed JOIN entities e USING (employer_key) GROUP BY e.employer_id)
    SELECT e.employer_id, slug, display_name, fein, true AS has_lca, final_id IS NOT NULL AS has_uscis, CAST(lca_rows AS INTEGER) AS lca_rows,
      c AS certified_total, n AS uscis_initial_total FROM entities e JOIN mine USING (employer_id) LEFT JOIN given ON final_id = e.employer_id
    UNION ALL SELECT new_id, new_slug, name, NULL, false, true, NULL, NULL, n FROM slugged_new JOIN final ON final_id = new_id JOIN given USING (final_id)""",
)
def flow_employers(spark, d):
    return tables(spark, d)["agg_employers"].select(
        "employer_id", "slug", "display_name", "fein", "has_lca", "has_uscis", "lca_rows", "certified_total", "uscis_initial_total"
    )


@query(
    "flow_profile",
    f"""WITH {LINKED}, me AS (SELECT k.* EXCLUDE (employer_id) FROM keyed k JOIN entities e USING (employer_key) WHERE e.employer_id = 1)
    SELECT 'years' AS section, CAST(fiscal_year AS VARCHAR) AS item, count(*) AS n FROM me GROUP BY 2
    UNION ALL SELECT 'aliases', employer_name, count(*) FROM me GROUP BY 2
    UNION ALL SELECT 'roles', CAST(fiscal_year AS VARCHAR), count(*) FROM me WHERE case_status = 'Certified'
      AND fiscal_year + 1 >= (SELECT max(fiscal_year) FROM cases) GROUP BY 2""",
)
def flow_profile(spark, d):
    """Child lists of the largest employer's page."""
    built = tables(spark, d)
    slug = built["employers"].where("employer_id = 1").first()["slug"]
    page = profile.profile(built, slug)

    def section(name, item, n):
        return page[name].select(F.lit(name).alias("section"), item.cast("string").alias("item"), F.col(n).cast("bigint").alias("n"))

    roles = section("roles", F.col("fiscal_year"), "certified").groupBy("section", "item").agg(F.sum("n").alias("n"))
    out = section("years", F.col("fiscal_year"), "submitted").unionByName(section("aliases", F.col("name"), "rows"))
    return out.unionByName(roles)


@query(
    "flow_meta",
    """SELECT DISTINCT 'lca_years' AS key, CAST(year(o_orderdate + INTERVAL 3 MONTH) AS INTEGER) AS fiscal_year FROM orders""",
)
def flow_meta(spark, d):
    """The years that the meta table of a load names."""
    built = tables(spark, d)
    meta = meta_table(spark, built, "2024-01-01T00:00:00Z", 1)
    return meta_years(meta, "lca_years").select(F.lit("lca_years").alias("key"), "fiscal_year")
