"""Entity resolution and shared-name queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.operators import links, resolve
from docketry.operators.aggregates import alias_table
from docketry.operators.quality import majority_entity, pair_scores
from docketry.plans.registered.base import CASES, cases, query, table
from docketry.plans.registered.cleaned import SLUG_SQL
from docketry.session import cut_lineage

# Every rule offers its key for the cases it fits; the first offer counts.
KEYED = CASES + r""", named AS (SELECT *, role_group || ' GROUP ' || (employer_id // 10) AS norm,
    'N:' || role_group || ' GROUP ' || (employer_id // 10) || '|' || ifnull(employer_state, '') AS own_key FROM cases),
  votes AS (SELECT norm, employer_state, employer_fein AS id, count(*) AS n FROM named WHERE employer_fein IS NOT NULL GROUP BY ALL),
  here AS (SELECT norm, employer_state, list_sort(list({'less': -n, 'id': id})) AS ids, sum(n) AS n FROM votes GROUP BY norm, employer_state),
  ns AS (SELECT norm, employer_state, len(ids) AS ids, ids[1].id AS top, -ids[1].less >= 0.95 * n AS dominant FROM here),
  anywhere AS (SELECT norm, list(DISTINCT id) AS ids FROM votes GROUP BY norm),
  near AS (SELECT case_number, own_key, ns.* FROM named JOIN ns ON ns.norm = named.norm AND ns.employer_state IS NOT DISTINCT FROM named.employer_state),
  far AS (SELECT case_number, own_key, ids FROM named JOIN anywhere USING (norm)),
  offers AS (SELECT case_number, 1 AS place, 'fein' AS method, 'F:' || employer_fein AS key FROM named WHERE employer_fein IS NOT NULL
    UNION ALL SELECT case_number, 2, if(ids = 1, 'name_state_to_fein', 'name_state_to_dominant_fein'), 'F:' || top FROM near WHERE dominant
    UNION ALL SELECT case_number, 3, 'name_state_ambiguous', own_key FROM near
    UNION ALL SELECT case_number, 4, 'name_to_fein', 'F:' || ids[1] FROM far WHERE len(ids) = 1
    UNION ALL SELECT case_number, 5, 'name_state_ambiguous', own_key FROM far
    UNION ALL SELECT case_number, 6, 'name_state', own_key FROM named),
  taken AS (SELECT case_number, arg_min(key, place) AS employer_key, arg_min(method, place) AS match_method FROM offers GROUP BY case_number),
  keyed AS (SELECT * FROM named JOIN taken USING (case_number))"""

SPELLINGS = """spellings AS (SELECT employer_key, employer_name, count(*) AS n, max(fiscal_year) AS newest FROM keyed GROUP BY employer_key, employer_name),
  shown AS (SELECT employer_key, list_sort(list({'a': -n, 'b': -newest, 'name': employer_name}))[1].name AS display_name,
    CAST(sum(n) AS BIGINT) AS lca_rows FROM spellings GROUP BY employer_key),
  sites AS (SELECT employer_key, employer_city, employer_state, count(*) AS n FROM keyed GROUP BY ALL),
  seat AS (SELECT employer_key, list_sort(list({'a': -n, 'city': employer_city, 'state': employer_state}))[1] AS s FROM sites GROUP BY employer_key),
  emp AS (SELECT employer_key, display_name, if(starts_with(employer_key, 'F:'), substr(employer_key, 3), NULL) AS fein,
    s.city AS city, s.state AS state, lca_rows FROM shown JOIN seat USING (employer_key))"""

ENTITIES = KEYED + ", " + SPELLINGS + r""", src AS (SELECT *, employer_key AS key, lca_rows AS volume,
    trim(regexp_replace(lower(display_name), '[^a-z0-9]+', '-', 'g'), '-') AS base, lower(coalesce(state, 'xx')) AS area,
    right(fein, 4) AS tail FROM emp), """ + SLUG_SQL + """, entities AS (SELECT rank AS employer_id, slug, employer_key,
    display_name, fein, city, state, lca_rows FROM slugged)"""


def summary(rows):
    """The summary of filings, written once: the key lookups read it several times."""
    return cut_lineage(resolve.filing_summary(rows))


def keyed(spark, d):
    return cut_lineage(resolve.keyed_summary(summary(cases(spark, d))))


@query(
    "dominant_key",
    f"WITH {KEYED} SELECT norm, employer_state, ids AS ns_ids, dominant AS ns_dominant, CASE WHEN dominant THEN top END AS top FROM ns",
)
def dominant_key(spark, d):
    per_id = resolve.name_state_id_rows(resolve.filing_summary(cases(spark, d)))
    top = F.when(F.col("ns_dominant"), F.col("ns_top"))
    return resolve.name_state_ids(per_id).select("norm", "employer_state", "ns_ids", "ns_dominant", top.alias("top"))


@query("resolve_keys", f"WITH {KEYED} SELECT case_number, employer_key, match_method FROM keyed")
def resolve_keys(spark, d):
    rows = cases(spark, d)
    routed = resolve.keyed_summary(summary(rows))
    return resolve.with_entity_key(rows, routed).select("case_number", "employer_key", "match_method")


@query(
    "resolve_method_counts",
    f"""WITH {KEYED} SELECT match_method, count(*) AS cases, count(*) FILTER (WHERE fiscal_year = 1996) AS cases_in_year
    FROM keyed GROUP BY 1""",
)
def resolve_method_counts(spark, d):
    return resolve.method_counts(resolve.keyed_summary(summary(cases(spark, d))), 1996)


@query("resolve_entities", f"WITH {ENTITIES} SELECT * FROM entities")
def resolve_entities(spark, d):
    return resolve.entities(keyed(spark, d))


@query(
    "attach_entities",
    f"WITH {ENTITIES} SELECT case_number, e.employer_id, match_method FROM keyed JOIN entities e USING (employer_key)",
)
def attach_entities(spark, d):
    routed = keyed(spark, d)
    rows = cases(spark, d).drop("employer_id")
    resolved = resolve.attach_entities(rows, routed, resolve.numbered_entities(routed))
    return resolved.select("case_number", "employer_id", "match_method")


@query(
    "alias_table",
    f"""WITH {ENTITIES} SELECT e.employer_id, employer_name AS name, norm, 'lca' AS source, CAST(count(*) AS INTEGER) AS "rows"
    FROM keyed JOIN entities e USING (employer_key) GROUP BY ALL
    UNION ALL SELECT l_suppkey, 'Supplier ' || l_suppkey || ' Co', 'SUPPLIER ' || l_suppkey, 'uscis', CAST(count(*) AS INTEGER)
    FROM lineitem GROUP BY ALL""",
)
def aliases_of_both(spark, d):
    from docketry.functions.names import normalize_name

    rows = keyed(spark, d)
    name = F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string"), F.lit(" Co"))
    counted = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("rows"))
    theirs = counted.select(
        F.col("l_suppkey").alias("final_id"), name.alias("employer_name"), normalize_name(name).alias("norm"), "rows"
    )
    return alias_table(resolve.aliases(rows, resolve.numbered_entities(rows)), theirs)


@query(
    "id_pairs_same_name",
    """WITH m AS (SELECT DISTINCT upper(p_name) AS norm, p_partkey AS id FROM part),
      s AS (SELECT norm, count(*) AS group_size FROM m GROUP BY 1 HAVING count(*) > 1)
    SELECT norm, id, group_size, CAST(group_size * (group_size - 1) / 2 AS BIGINT) AS group_pairs FROM m JOIN s USING (norm)""",
)
def id_pairs_same_name(spark, d):
    """Ids that share a name, as members with their group's pair count (never all pairs)."""
    from docketry.functions.names import normalize_name

    rows = table(spark, d, "part").select(
        normalize_name(F.col("p_name")).alias("norm"), F.col("p_partkey").alias("id")
    )
    return links.link_members(rows, ident="id", entity="id").select("norm", "id", "group_size", "group_pairs")


@query(
    "resolved_link_counts",
    f"""WITH {ENTITIES}, m AS (SELECT DISTINCT k.norm, e.fein, e.employer_id FROM keyed k JOIN entities e USING (employer_key)
        WHERE e.fein IS NOT NULL), s AS (SELECT norm, count(*) AS n FROM m GROUP BY 1 HAVING count(*) > 1)
    SELECT (SELECT count(*) FROM entities) AS employers, (SELECT count(*) FROM entities WHERE fein IS NOT NULL) AS fein_employers,
      (SELECT count(*) FROM entities WHERE fein IS NULL) AS name_employers, (SELECT count(*) FROM spellings) AS aliases,
      (SELECT CAST(coalesce(sum(n * (n - 1) // 2), 0) AS BIGINT) FROM s) AS possible_link_pairs""",
)
def resolved_link_counts(spark, d):
    rows = keyed(spark, d)
    entity = cut_lineage(resolve.numbered_entities(rows))
    alias = resolve.aliases(rows, entity)
    members = links.link_members(alias.join(entity.select("employer_id", "fein"), "employer_id"))
    return resolve.resolution_stats(entity, alias, members)


@query(
    "majority_entity",
    f"""WITH {CASES}, n AS (SELECT employer_name, employer_id, count(*) AS n FROM cases GROUP BY ALL)
    SELECT employer_name, employer_id FROM n QUALIFY row_number() OVER (PARTITION BY employer_name ORDER BY n DESC, employer_id) = 1""",
)
def majority(spark, d):
    return majority_entity(cases(spark, d), "employer_name", "employer_id")


@query(
    "pair_eval",
    """WITH j AS (SELECT l.quality = 1 AS actual, d.n_chars >= 1000 AS predicted FROM labels l JOIN documents d USING (doc_id)),
      c AS (SELECT count(*) FILTER (WHERE predicted AND actual) AS tp, count(*) FILTER (WHERE predicted AND NOT actual) AS fp,
        count(*) FILTER (WHERE NOT predicted AND actual) AS fn, count(*) FILTER (WHERE NOT predicted AND NOT actual) AS tn FROM j)
    SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM c""",
)
def pair_eval(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return pair_scores(rows, F.col("n_chars") >= 1000, F.col("quality") == 1)
