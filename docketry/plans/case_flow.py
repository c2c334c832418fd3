"""The whole flow: canonical cases and registry rows -> published tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.rules import with_exempt_rule
from docketry.operators import aggregates, groups, linkage, links, resolve
from docketry.session import cut_lineage
from docketry.sources.registers import empty_exempt_register


def build_tables(
    cases: DataFrame,
    registry: DataFrame,
    register: DataFrame | None = None,
    group_map: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Every intermediate and published table, lazily, by name.

    `cases` are canonical (deduplicated) rows, `registry` rows of registry B. The resolved
    cases are materialized once, since nearly every table below reads them.
    """
    spark = cases.sparkSession
    paid = aggregates.with_annual_pay(cases)
    keyed = cut_lineage(resolve.keyed_summary(cut_lineage(resolve.filing_summary(cases))))
    entity = cut_lineage(resolve.entities(keyed))
    alias = resolve.aliases(keyed, entity)
    resolved = cut_lineage(
        aggregates.with_dimensions(resolve.attach_entities(paid, keyed, entity))
    )

    summary = cut_lineage(linkage.registry_summary(registry))
    linked = cut_lineage(
        linkage.link_registry(
            linkage.registry_entities(summary), linkage.entity_places(keyed, entity)
        )
    )
    final = cut_lineage(linkage.finalize_links(linked, linkage.registry_only(linked, entity)))
    registry_rows = linkage.with_final_id(summary, final)
    registry_year = linkage.registry_years(registry_rows)

    year = aggregates.entity_year(resolved)
    members = links.link_members(alias.join(entity.select("employer_id", "fein"), "employer_id"))
    employers = with_exempt_rule(
        aggregates.employer_table(entity, resolved, year, registry_year, final, registry_rows),
        register if register is not None else empty_exempt_register(spark),
    )
    tables = {
        "lca": resolved,
        "employers": entity,
        "employer_aliases": alias,
        "uscis_employer": final,
        "filing_summary": keyed,
        "registry_summary": summary,
        "agg_employers": employers,
        "agg_aliases": aggregates.alias_table(alias, registry_rows),
        "agg_lca_year": year,
        "agg_lca_year_role": aggregates.entity_year_role(resolved),
        "agg_lca_year_top": aggregates.top_values(resolved),
        "agg_lca_cube": aggregates.fact_cube(resolved),
        "agg_entry_signal": aggregates.entry_signal(resolved, registry_year),
        "uscis_year": registry_year,
        "agg_links": members,
    }
    if group_map is not None:
        tables["agg_groups"] = groups.group_members(groups.check_groups(group_map), entity)
    else:
        tables["agg_groups"] = spark.createDataFrame(
            [], "group_slug string, group_name string, employer_id bigint, fein string, "
            "evidence_url string, reviewed_on string, note string",
        )
    return tables


def meta_table(
    spark: SparkSession, tables: dict[str, DataFrame], loaded_at: str, version: int, **extra: str
) -> DataFrame:
    """(key, value) facts about a load; lists as JSON text."""

    def years(name: str, key: str) -> DataFrame:
        found = F.to_json(F.sort_array(F.collect_set("fiscal_year")))  # a handful of years
        return tables[name].select("fiscal_year").distinct().agg(found.alias("value")).select(
            F.lit(key).alias("key"), "value"
        )

    facts = {"loaded_at": loaded_at, "schema_version": str(version), **extra}
    out = spark.createDataFrame(list(facts.items()), "key string, value string")
    entry = tables["agg_entry_signal"].agg(F.min("years").alias("value"))
    return (
        out.unionByName(years("lca", "lca_years"))
        .unionByName(years("uscis_year", "uscis_years"))
        .unionByName(entry.select(F.lit("entry_years").alias("key"), "value"))
    )


def meta_years(meta: DataFrame, key: str) -> DataFrame:
    """The years of a JSON list in the meta table, one per row; none when the key is absent."""
    return meta.where(F.col("key") == key).select(
        F.explode(F.from_json("value", "array<int>")).alias("fiscal_year")
    )
