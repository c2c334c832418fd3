"""Read queries: explore, search, profile, groups, lists."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docketry.operators.aggregates import fact_cube
from docketry.operators.links import link_members, partners_of
from docketry.operators.ordering import dense_index
from docketry.plans import explore, name_index, profile, search
from docketry.plans.case_flow import meta_years
from docketry.plans.registered.aggregated import CUBE, YEAR_STATS
from docketry.plans.registered.base import CASES, EMPLOYERS, aliases, cases, employers, query, table
from docketry.session import run_dir

FOUND = """summed AS (SELECT employer_id, CAST(sum(certified) AS INTEGER) AS certified, CAST(sum(wage_rows) AS INTEGER) AS wage_rows,
    CAST(sum(CAST(wage_sum AS DECIMAL(28,4))) AS DOUBLE) AS pay FROM cube WHERE {cells} GROUP BY employer_id),
  found AS (SELECT slug, display_name, state, uscis_initial_total, h1b_dependent_latest, cap_exempt_rule, certified, wage_rows,
    round(pay / nullif(wage_rows, 0)) AS avg_wage FROM employers JOIN summed USING (employer_id) WHERE certified >= {minimum} AND {who})"""

REQUEST = dict(levels=("I", "II"), minimum=1, hide_dependent=True, hide_exempt=True, sort="wage")
FILTERED = FOUND.format(
    cells="list_contains(['I', 'II'], wage_level)", who="NOT coalesce(h1b_dependent_latest, false) AND cap_exempt_rule IS NULL", minimum=1
)
EVERYTHING = FOUND.format(cells="true", who="true", minimum=0)


@query(
    "explore_page",
    f"""WITH {CASES}, {CUBE}, {EMPLOYERS}, {FILTERED} SELECT *, CAST((SELECT count(*) FROM found) AS INTEGER) AS total_rows
    FROM found ORDER BY avg_wage DESC NULLS LAST, display_name, slug LIMIT 50 OFFSET 50""",
)
def explore_page(spark, d):
    request = explore.Request(**REQUEST, page=2)
    return explore.explore_page(fact_cube(cases(spark, d)), employers(spark, d), request)


@query(
    "explore_total",
    f"WITH {CASES}, {CUBE}, {EMPLOYERS}, {FILTERED} SELECT CAST(count(*) AS INTEGER) AS total_rows FROM found",
)
def explore_total(spark, d):
    rows = explore.matching(fact_cube(cases(spark, d)), employers(spark, d), explore.Request(**REQUEST))
    return explore.total_rows(rows)


@query(
    "explore_export_rows",
    f"""WITH {CASES}, {CUBE}, {EMPLOYERS}, {EVERYTHING}, p AS (SELECT * FROM found
      ORDER BY certified DESC, display_name, slug LIMIT 5000)
    SELECT display_name AS employer, state, certified AS certified_lcas, CAST(avg_wage AS BIGINT) AS mean_offered_wage, wage_rows,
      uscis_initial_total AS uscis_initial_approvals_fy2000_fy2001, h1b_dependent_latest,
      cap_exempt_rule AS likely_cap_exempt_rule, '/employer/' || slug AS url FROM p""",
)
def explore_export_rows(spark, d):
    return explore.export_rows(fact_cube(cases(spark, d)), employers(spark, d), explore.Request(), [2000, 2001])


@query(
    "explore_facets_batch",
    f"""WITH {CASES}, {CUBE} SELECT 'level' AS facet, wage_level AS value, sum(certified)::BIGINT AS certified,
        count(DISTINCT employer_id) AS employers FROM cube GROUP BY 2
      UNION ALL SELECT 'role', role_group, sum(certified)::BIGINT, count(DISTINCT employer_id) FROM cube GROUP BY 2
      UNION ALL SELECT 'state', worksite_state, sum(certified)::BIGINT, count(DISTINCT employer_id) FROM cube GROUP BY 2""",
)
def explore_facets_batch(spark, d):
    """What every single-facet request selects, for all facet values in one pass."""
    facets = {"level": "wage_level", "role": "role_group", "state": "worksite_state"}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("facet"), F.col(c).alias("value")) for k, c in facets.items()]))
    rows = fact_cube(cases(spark, d)).select("employer_id", "certified", each.alias("f"))
    return (
        rows.groupBy("f.facet", "f.value", "employer_id")
        .agg(F.sum("certified").alias("certified"))
        .groupBy("facet", "value")
        .agg(F.sum("certified").alias("certified"), F.count(F.lit(1)).alias("employers"))
    )


ALIASES = """aliases AS (SELECT CAST(p_size * 100 + length(p_type) AS BIGINT) AS employer_id,
    upper(p_name || ' ' || p_type || ' ' || p_brand) AS u, min(p_name || ' ' || p_type || ' ' || p_brand) AS l, CAST(count(*) AS INTEGER) AS "rows"
    FROM part GROUP BY 1, 2),
  named AS (SELECT employer_id, "rows", trim(regexp_replace(u, '[^A-Z0-9]+', ' ', 'g')) AS norm,
    array_to_string([upper(left(w, 1)) || lower(substr(w, 2)) FOR w IN string_split(l, ' ')], ' ') AS name FROM aliases),
  people AS (SELECT DISTINCT employer_id, 'e-' || employer_id AS slug, 'Employer ' || employer_id % 7 AS display_name,
    CASE WHEN employer_id % 3 <> 0 THEN CAST(employer_id % 50 AS INTEGER) END AS certified_total,
    CAST(employer_id % 5 AS INTEGER) AS uscis_initial_total FROM aliases),
  grams AS (SELECT norm, list_distinct(flatten([[substr('  ' || w || ' ', i, 3) FOR i IN range(1, length(w) + 2)]
    FOR w IN string_split(norm, ' ')])) AS g FROM (SELECT DISTINCT norm FROM named)),
  asked AS (SELECT q, norm AS q_norm, list_distinct(flatten([[substr('  ' || w || ' ', i, 3) FOR i IN range(1, length(w) + 2)]
    FOR w IN string_split(norm, ' ')])) AS qg FROM ({queries})),
  scored AS (SELECT q, q_norm, norm, len(list_intersect(g, qg)) / len(list_distinct(g || qg)) AS sim FROM grams, asked),
  tests AS (SELECT *, list_position([norm = q_norm, starts_with(norm, q_norm), contains(norm, q_norm), sim >= 0.3], true) - 1 AS tier FROM scored),
  best AS (SELECT q, employer_id, min({{'tier': tier, 'far': -sim, 'few': -"rows", 'name': name}}) AS hit FROM tests JOIN named USING (norm)
    WHERE tier >= 0 GROUP BY q, employer_id),
  lined AS (SELECT q, list_sort(list({{'tier': hit.tier, 'far': if(hit.tier = 3, hit.far, 0.0), 'c': -coalesce(certified_total, -1e9),
      'u': -coalesce(uscis_initial_total, -1e9), 'display_name': display_name, 'slug': slug, 'employer_id': employer_id,
      'matched_alias': hit.name, 'certified_total': certified_total, 'uscis_initial_total': uscis_initial_total}})) AS hits
    FROM best JOIN people USING (employer_id) GROUP BY q),
  ranked AS (SELECT q, unnest(hits) AS h, unnest(range(1, len(hits) + 1)) AS place FROM lined)"""

RANKED = """SELECT q, h.employer_id AS employer_id, h.matched_alias AS matched_alias, CAST(h.tier AS INTEGER) AS tier, h.slug AS slug,
  h.display_name AS display_name, h.certified_total AS certified_total, h.uscis_initial_total AS uscis_initial_total,
  CAST(place AS INTEGER) AS place FROM ranked WHERE place <= {n}"""


def people(alias):
    key = F.col("employer_id")
    return alias.select(
        key,
        F.concat(F.lit("e-"), key.cast("string")).alias("slug"),
        F.concat(F.lit("Employer "), (key % 7).cast("string")).alias("display_name"),
        F.when(key % 3 != 0, (key % 50).cast("int")).alias("certified_total"),
        (key % 5).cast("int").alias("uscis_initial_total"),
    ).distinct()


@query(
    "search_tiers",
    "WITH " + ALIASES.format(queries="SELECT 'The hot gear, Inc.' AS q, 'HOT GEAR' AS norm") + RANKED.format(n=50),
)
def search_tiers(spark, d):
    alias = aliases(spark, d)
    return search.search("The hot gear, Inc.", alias, people(alias), 50)


@query(
    "typeahead_hits",
    "WITH " + ALIASES.format(queries="SELECT 'hot g' AS q, 'HOT G' AS norm") + RANKED.format(n=8),
)
def typeahead_hits(spark, d):
    alias = aliases(spark, d)
    return search.typeahead("hot g", alias, people(alias))


@query(
    "search_batch_trigram",
    "WITH " + ALIASES.format(queries="SELECT p_name AS q, upper(p_name) AS norm FROM part GROUP BY ALL") + RANKED.format(n=25),
)
def search_batch_trigram(spark, d):
    alias = aliases(spark, d)
    asked = table(spark, d, "part").select(F.col("p_name").alias("q")).distinct()
    return search.search_batch(asked, alias, people(alias), 25)


@query(
    "search_stored_index",
    "WITH " + ALIASES.format(queries="SELECT p_name AS q, upper(p_name) AS norm FROM part GROUP BY ALL") + RANKED.format(n=25),
)
def search_stored_index(spark, d):
    """The batch again, through an index that two overlapping arrivals of aliases filled."""
    alias = aliases(spark, d)
    asked = table(spark, d, "part").select(F.col("p_name").alias("q")).distinct()
    root = f"{run_dir(spark)}/names/{uuid.uuid4().hex}"
    name_index.extend_index(alias.where("employer_id % 3 <> 0"), root, 0)
    name_index.extend_index(alias, root, 1)
    return name_index.search_indexed(root, asked, alias, people(alias), 25)


@query(
    "similar_entities",
    f"""WITH {EMPLOYERS}, t AS (SELECT * FROM employers WHERE has_lca),
      pairs AS (SELECT a.employer_id AS asked_id, b.employer_id, row_number() OVER (PARTITION BY a.employer_id
        ORDER BY b.certified_total DESC NULLS LAST, b.display_name, b.slug) AS place
        FROM employers a JOIN t b ON a.naics = b.naics AND a.state = b.state AND a.employer_id <> b.employer_id)
    SELECT asked_id, employer_id, CAST(place AS INTEGER) AS place FROM pairs WHERE place <= 8""",
)
def similar_entities(spark, d):
    return profile.similar_employers(employers(spark, d)).select("asked_id", "employer_id", "place")


@query(
    "linked_partners",
    """WITH m AS (SELECT c_mktsegment || ' GROUP ' || (c_custkey // 10) AS norm, c_custkey AS id FROM customer)
    SELECT a.id AS asked_id, b.id AS partner_id, a.norm FROM supplier JOIN m a ON a.id = s_suppkey JOIN m b ON a.norm = b.norm AND a.id <> b.id""",
)
def linked_partners(spark, d):
    """Partners of the customers that a page asks for (here those that are suppliers), from
    linear member rows."""
    from docketry.functions.names import normalize_name

    key = F.col("c_custkey")
    name = F.concat("c_mktsegment", F.lit(" Group "), F.floor(key / 10).cast("string"), F.lit(", Inc."))
    rows = table(spark, d, "customer").select(normalize_name(name).alias("norm"), key.alias("id"))
    asked = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return partners_of(link_members(rows, ident="id", entity="id"), asked, entity="id")


@query(
    "group_pivot_totals",
    f"""WITH {CASES}, m AS (SELECT employer_id, 'g-' || (employer_id // 4) AS group_slug, fiscal_year, case_status = 'Certified' AS c FROM cases)
    SELECT group_slug, employer_id, fiscal_year, count_if(c)::BIGINT AS certified FROM m GROUP BY ALL
    UNION ALL SELECT group_slug, NULL, fiscal_year, count_if(c)::BIGINT FROM m GROUP BY ALL""",
)
def group_pivot_totals(spark, d):
    rows = cases(spark, d)
    year = rows.groupBy("employer_id", "fiscal_year").agg(F.count_if(F.col("case_status") == "Certified").alias("certified"))
    slug = F.concat(F.lit("g-"), F.floor(F.col("c_custkey") / 4).cast("string"))
    members = table(spark, d, "customer").select(slug.alias("group_slug"), F.col("c_custkey").alias("employer_id"))
    return profile.group_years(members, year)


@query(
    "group_members",
    f"""WITH {EMPLOYERS} SELECT 'g-' || (employer_id // 4) AS group_slug, employer_id, slug, display_name, certified_total FROM employers
    WHERE employer_id // 4 IN (SELECT s_suppkey // 4 FROM supplier)""",
)
def group_members(spark, d):
    emp = employers(spark, d)

    def slug(c):
        return F.concat(F.lit("g-"), F.floor(F.col(c) / 4).cast("string")).alias("group_slug")

    groups = emp.select(
        slug("employer_id"), F.lit("n").alias("group_name"), F.lit("u").alias("evidence_url"),
        F.lit("d").alias("reviewed_on"), "employer_id",
    )
    asked = table(spark, d, "supplier").select(slug("s_suppkey")).distinct()
    return profile.group_page(groups, emp, asked).select(
        "group_slug", "employer_id", "slug", "display_name", "certified_total"
    )


@query(
    "mix_shares",
    f"""WITH {CASES}, n AS (SELECT employer_id, level, count(*) AS n FROM cases WHERE case_status = 'Certified' GROUP BY ALL)
    SELECT employer_id, level, n, round(n / sum(n) OVER (PARTITION BY employer_id), 6) AS share FROM n""",
)
def mix_shares(spark, d):
    certified = cases(spark, d).where(F.col("case_status") == "Certified")
    counted = certified.groupBy("employer_id", "level").agg(F.count(F.lit(1)).alias("certified"))
    return profile.mix_shares(counted, "employer_id", "level", "certified")


@query(
    "own_last_years",
    f"""WITH {CASES}, y AS (SELECT employer_id, fiscal_year, count(*) AS submitted FROM cases GROUP BY ALL)
    SELECT employer_id, fiscal_year, submitted FROM y QUALIFY row_number() OVER (PARTITION BY employer_id ORDER BY fiscal_year DESC) <= 2""",
)
def own_last_years(spark, d):
    year = cases(spark, d).groupBy("employer_id", "fiscal_year").agg(F.count(F.lit(1)).alias("submitted"))
    return profile.own_last_years(year)


@query(
    "first_aliases",
    f"""WITH {CASES}, a AS (SELECT role_group AS employer_id, employer_name AS name, count(*) AS n FROM cases GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY employer_id ORDER BY n DESC, name) AS place,
        count(*) OVER (PARTITION BY employer_id) AS k FROM a)
    SELECT employer_id, CAST(place AS INTEGER) AS place, name, 'lca' AS source, n AS "rows", greatest(k - 40, 0) AS more FROM r WHERE place <= 40""",
)
def first_aliases(spark, d):
    counted = cases(spark, d).groupBy(F.col("role_group").alias("employer_id"), F.col("employer_name").alias("name")).agg(
        F.lit("lca").alias("source"), F.count(F.lit(1)).alias("rows")
    )
    return profile.first_aliases(counted)


@query(
    "profile_document",
    f"""WITH {CASES}, {YEAR_STATS}, me AS (SELECT employer_id FROM cases GROUP BY 1 ORDER BY count(*) DESC, employer_id LIMIT 1)
    SELECT 'years' AS section, CAST(fiscal_year AS VARCHAR) AS item, CAST(certified AS BIGINT) AS n FROM stats WHERE employer_id IN (FROM me)
    UNION ALL SELECT 'roles', role_group, count(*) FROM cases WHERE case_status = 'Certified' AND employer_id IN (FROM me)
      AND fiscal_year >= (SELECT max(fiscal_year) - 1 FROM cases) GROUP BY 2
    UNION ALL SELECT 'aliases', employer_name, count(*) FROM cases WHERE employer_id IN (FROM me) GROUP BY 2""",
)
def profile_document(spark, d):
    """Child lists of the busiest employer, as one table of sections."""
    rows = cases(spark, d)
    me = (
        rows.groupBy("employer_id").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc("employer_id")).limit(1).select("employer_id")
    )
    mine = rows.join(F.broadcast(me), "employer_id", "left_semi")  # one row
    certified = F.col("case_status") == "Certified"
    last = rows.agg(F.max("fiscal_year").alias("_last"))
    recent = mine.where(certified).crossJoin(F.broadcast(last)).where(F.col("fiscal_year") >= F.col("_last") - 1)

    def section(df, name, item, n):
        return df.groupBy(F.lit(name).alias("section"), F.col(item).cast("string").alias("item")).agg(n.alias("n"))

    years = section(mine, "years", "fiscal_year", F.count_if(certified))
    roles = section(recent, "roles", "role_group", F.count(F.lit(1)))
    return years.unionByName(roles).unionByName(section(mine, "aliases", "employer_name", F.count(F.lit(1))))


@query(
    "meta_lookup",
    """SELECT DISTINCT CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) >= 10 THEN 1 ELSE 0 END AS INTEGER) AS fiscal_year FROM orders""",
)
def meta_lookup(spark, d):
    years = cases(spark, d).select("fiscal_year").distinct()
    meta = years.agg(F.to_json(F.sort_array(F.collect_set("fiscal_year"))).alias("value")).select(
        F.lit("lca_years").alias("key"), "value"
    )
    return meta_years(meta, "lca_years")


@query(
    "file_list_ordered",
    f"""WITH {CASES}, f AS (SELECT CASE WHEN source_quarter = 4 THEN 'lca_worksites' ELSE 'lca' END AS kind, fiscal_year,
        source_quarter AS quarter, source_file AS file, count(*) AS loaded_rows FROM cases GROUP BY ALL)
    SELECT *, row_number() OVER (ORDER BY kind, fiscal_year, quarter, file) AS place FROM f""",
)
def file_list_ordered(spark, d):
    kind = F.when(F.col("source_quarter") == 4, "lca_worksites").otherwise("lca")
    files = cases(spark, d).groupBy(
        kind.alias("kind"), "fiscal_year", F.col("source_quarter").alias("quarter"), F.col("source_file").alias("file")
    ).agg(F.count(F.lit(1)).alias("loaded_rows"))
    return dense_index(files, [F.asc("kind"), F.asc("fiscal_year"), F.asc("quarter"), F.asc("file")], "place")
