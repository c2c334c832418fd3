"""Gates, reconciliation, evaluation and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry import fixed
from docketry.functions.clean import lookup
from docketry.functions.names import normalize_name
from docketry.operators.ordering import best_per_key

MEASURES = ["submitted", "certified", "withdrawn", "denied"]


class GateError(AssertionError):
    """A quality gate did not hold."""


def gate(violations: DataFrame, what: str, shown: int = 20) -> None:
    """Raise when there is any violation row; the message shows the first few."""
    rows = violations.limit(shown).collect()
    if rows:
        raise GateError(f"{what}: {[r.asDict() for r in rows]}")


def count_mismatches(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys whose row counts differ between two count tables (key, rows)."""
    return (
        expected.select(key, F.col("rows").alias("expected"))
        .join(actual.select(key, F.col("rows").alias("actual")), key, "full")
        .where(~F.col("expected").eqNullSafe(F.col("actual")))
    )


def unmapped_statuses(cases: DataFrame) -> DataFrame:
    """Status values no rule maps, with their counts."""
    return (
        cases.where(F.col("case_status").startswith(fixed.UNKNOWN_PREFIX))
        .groupBy("case_status")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def wrong_years(rows: DataFrame, declared: DataFrame) -> DataFrame:
    """(file, year) found in the data but not declared for the file."""
    return (
        rows.select("source_file", "fiscal_year")
        .distinct()
        .join(declared.select("source_file", "fiscal_year"), ["source_file", "fiscal_year"], "left_anti")
    )


def measures_by_year(year: DataFrame) -> DataFrame:
    """Entity-year counts summed to (fiscal_year, measure, n)."""
    return (
        year.groupBy("fiscal_year")
        .agg(*[F.sum(m).cast("long").alias(m) for m in MEASURES])
        .unpivot(["fiscal_year"], MEASURES, "measure", "n")
    )


def recount(raw: DataFrame, number: str, status: str, quarter: str) -> DataFrame:
    """The same measures straight from raw rows by another path: fold the status text to a
    code, keep the last release of a case by a grouped maximum, and count codes. The status
    breaks ties inside a quarter, in alphabetical order, so that a recount is repeatable."""
    folded = F.regexp_replace(F.lower(F.trim(F.col(status))), r"\s*-\s*", "-")
    codes = {"certified": 1, "certified-withdrawn": 2, "denied": 3, "withdrawn": 4}
    code = F.coalesce(lookup(folded, codes), F.lit(0))
    # One number per case: quarter, then code. Whole numbers aggregate by hash.
    last = (
        raw.where(F.trim(F.col(number)) != "")
        .groupBy("fiscal_year", number)
        .agg((F.max(F.col(quarter) * 10 + code) % 10).alias("_code"))
    )
    return (
        last.groupBy("fiscal_year")
        .agg(
            F.count(F.lit(1)).alias("submitted"),
            F.count_if(F.col("_code") == 1).alias("certified"),
            F.count_if(F.col("_code").isin(2, 4)).alias("withdrawn"),
            F.count_if(F.col("_code") == 3).alias("denied"),
        )
        .unpivot(["fiscal_year"], MEASURES, "measure", "n")
    )


def reconcile(raw: DataFrame, published: DataFrame) -> DataFrame:
    """Both sides of every (year, measure) and the difference; a side that is missing counts
    its whole value."""
    r, p = F.col("raw_n"), F.col("published_n")
    both = r.isNotNull() & p.isNotNull()
    return (
        raw.withColumnRenamed("n", "raw_n")
        .join(published.withColumnRenamed("n", "published_n"), ["fiscal_year", "measure"], "full")
        .withColumn("diff", F.when(both, p - r).otherwise(F.coalesce(r, p, F.lit(0))))
    )


def gate_reconcile(compared: DataFrame) -> None:
    gate(compared.where(F.col("diff") != 0), "recount differs")


def orphan_children(child: DataFrame, parent: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Child keys no parent has, counted per `by`."""
    return (
        child.select(*keys)
        .distinct()
        .join(parent.select(*keys), keys, "left_anti")
        .groupBy(by)
        .agg(F.count(F.lit(1)).alias("orphans"))
    )


def fill_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of filled cells per column, in one pass."""
    return df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns])


def domain_violations(cases: DataFrame) -> DataFrame:
    """One row of counts: dates outside their fiscal year, receipt after decision, odd codes."""
    start = F.make_date(F.col("fiscal_year") - 1, F.lit(10), F.lit(1))
    end = F.make_date(F.col("fiscal_year"), F.lit(9), F.lit(30))
    return cases.agg(
        F.count_if(~F.col("decision_date").between(start, end)).alias("outside_year"),
        F.count_if(F.col("received_date") > F.col("decision_date")).alias("received_after_decision"),
        F.count_if(~F.col("case_number").rlike(r"^I-\d{3}-\d{5}-\d{6}$")).alias("odd_case_number"),
        F.count_if(~F.col("soc_code").rlike(r"^\d{2}-\d{4}$")).alias("odd_soc_code"),
        F.count_if(~F.col("employer_fein").rlike(r"^\d{2}-\d{7}$")).alias("odd_fein"),
    )


def pair_scores(pairs: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """Confusion counts, precision and recall of a pairwise predictor."""
    counts = pairs.agg(
        F.count_if(predicted & actual).alias("tp"),
        F.count_if(predicted & ~actual).alias("fp"),
        F.count_if(~predicted & actual).alias("fn"),
        F.count_if(~predicted & ~actual).alias("tn"),
    )
    tp = F.col("tp").cast("double")
    return counts.withColumns(
        {
            "precision": F.round(F.try_divide(tp, tp + F.col("fp")), 6),
            "recall": F.round(F.try_divide(tp, tp + F.col("fn")), 6),
        }
    )


def majority_entity(rows: DataFrame, name: str, entity: str) -> DataFrame:
    """The entity that submitted most rows under each spelling; ties to the lowest id."""
    counted = rows.groupBy(name, entity).agg(F.count(F.lit(1)).alias("_n"))
    return best_per_key(counted, [name], [F.desc("_n"), F.asc(entity)]).select(name, entity)


def predict_entity(names: DataFrame, cases: DataFrame, out: str = "entity") -> DataFrame:
    """Entity of each distinct asked name: by exact spelling, else by its matching form."""
    asked = names.select(
        "name",
        F.trim(F.regexp_replace("name", r"\s+", " ")).alias("_clean"),
        normalize_name(F.col("name")).alias("_norm"),
    )
    exact = majority_entity(cases, "employer_name", "employer_id")
    loose = majority_entity(
        cases.where(F.col("employer_name").isNotNull()).withColumn(
            "_form", normalize_name(F.col("employer_name"))
        ),
        "_form",
        "employer_id",
    )
    return (
        asked.join(exact, F.col("_clean") == F.col("employer_name"), "left")
        .withColumnRenamed("employer_id", "_exact")
        .join(loose, F.col("_norm") == F.col("_form"), "left")
        .select("name", F.coalesce("_exact", "employer_id").alias(out))
    )


def score_resolver(pairs: DataFrame, cases: DataFrame) -> DataFrame:
    """Scores of the resolver on labelled pairs (name_a, name_b, same); an unmatched name
    equals only itself."""
    names = pairs.select(F.col("name_a").alias("name")).union(pairs.select("name_b")).distinct()
    found = predict_entity(names, cases)
    a = found.select(F.col("name").alias("name_a"), F.col("entity").alias("_a"))
    b = found.select(F.col("name").alias("name_b"), F.col("entity").alias("_b"))
    both = pairs.join(a, "name_a").join(b, "name_b")
    same = F.when(
        F.col("_a").isNull() & F.col("_b").isNull(), F.col("name_a") == F.col("name_b")
    ).otherwise(F.col("_a").eqNullSafe(F.col("_b")))
    return pair_scores(both, same, F.col("same") == "1")


def score_normalizer(pairs: DataFrame) -> DataFrame:
    same = normalize_name(F.col("name_a")) == normalize_name(F.col("name_b"))
    return pair_scores(pairs, same, F.col("same") == "1")


def stratified_sample(df: DataFrame, key: str, strata: list[str], n: int) -> DataFrame:
    """A repeatable sample of `n` keys: one row of every stratum value first, then the rows
    whose key hashes lowest. The hash is of the key's text, so any engine can repeat it."""
    marked = df.withColumn("_hash", F.md5(F.col(key).cast("string")))
    rest = [F.asc("_hash"), F.asc(key)]
    picks = [
        best_per_key(marked, [s], rest).withColumn("_prio", F.lit(0)) for s in strata
    ]
    fill = marked.orderBy(*rest).limit(n).withColumn("_prio", F.lit(1))
    for p in picks:
        fill = fill.unionByName(p)
    return (
        best_per_key(fill, [key], [F.asc("_prio")])
        .orderBy("_prio", *rest)
        .limit(n)
        .drop("_hash", "_prio")
    )
