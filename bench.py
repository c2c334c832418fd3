"""Headline queries, timed: prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from docketry.plans.registered.everything import QUERIES
from docketry.session import clear_run, local_session

HEADLINE = [
    "dedup_latest",
    "annualize_validity",
    "entity_year_stats",
    "role_percentiles_last2",
    "top5_per_entity_latest_year",
    "fact_cube",
    "entry_signal",
    "name_normalize",
    "resolve_keys",
    "resolve_entities",
    "linkage_outcomes",
    "registry_year_sums",
    "explore_page",
    "search_tiers",
    "search_batch_trigram",
    "similar_entities",
    "reconcile_measures",
    "orphan_children",
    "href_links",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    scratch = {"spark.checkpoint.dir": tempfile.mkdtemp(prefix="docketry-bench-")}  # one machine
    spark = local_session(cores, partitions=int(cores) if cores.isdigit() else 8, **scratch)

    def timed(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    # The first run of a query pays for compiling its code; both runs are reported, and the
    # headline is the second. Nothing is cached between runs.
    first = {name: timed(name) for name in HEADLINE}
    seconds = {name: timed(name) for name in HEADLINE}
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total_second_run",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "first_run": first,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    clear_run(spark)
    spark.stop()


if __name__ == "__main__":
    main()
