"""Unique slugs in rank order, computed in parallel rounds.

The rule is sequential: in rank order, every entity takes the first free slug of its own
preference list. Because all slugs prefer the better rank, the same assignment comes out of
rounds in which every entity asks for its next choice, each slug keeps the best-ranked
asker, and the others move on. Each round is a grouped minimum and a join; no entity list
is pulled together anywhere.

Rows whose first choice nobody else can ever ask for are settled before the first round.

Numbered slugs (`stem-2`, `stem-3`, ...) would need as many rounds as entities share a stem,
so entities of one stem are spread over the numbers at once: the one with p better-ranked
entities before it cannot get a number below the p-th free one. Numbers taken before are no
rounds either: they are kept as runs with the count of free numbers below each, and a sweep
along a stem turns the p-th free number into the number itself. Only a number that another
entity of the same call holds by name costs a round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from docketry.operators.ordering import position_in_key, running_max
from docketry.session import cut_lineage


def assign_slugs(
    df: DataFrame,
    rank: str,
    choices: list[Column],
    stem: Column,
    used: DataFrame | None = None,
    out: str = "slug",
) -> DataFrame:
    """Add the slug column. `choices` are the named choices in order (NULL: no such choice);
    after them come `stem-2`, `stem-3`, ... `used` has one column of slugs taken before."""
    state = df.select(
        F.col(rank).alias("_rank"),
        F.filter(F.array(*choices), lambda s: s.isNotNull()).alias("_choices"),
        stem.alias("_stem"),
        F.lit(0).alias("_k"),
        F.lit(2).cast("bigint").alias("_num"),
    )
    state, settled = _uncontested(state, used)
    gaps, numbered = None, 0
    fixed_holders = None
    if used is not None:
        fixed_holders = used.select(
            F.col(used.columns[0]).alias("_slug"), F.lit(-1).cast("bigint").alias("_best")
        )
    while True:
        if numbered and used is not None and gaps is None:
            gaps = _gaps(state, used)
        asked = _numbers(state, gaps).withColumn(
            "_slug",
            F.when(F.col("_k") < F.size("_choices"), F.get(F.col("_choices"), F.col("_k"))).otherwise(
                F.concat_ws("-", F.col("_stem"), F.col("_number").cast("string"))
            ),
        )
        best = asked.groupBy("_slug").agg(F.min("_rank").cast("bigint").alias("_best"))
        if fixed_holders is not None:
            best = best.unionByName(fixed_holders).groupBy("_slug").agg(F.min("_best").alias("_best"))
        judged = asked.join(best, "_slug").withColumn("_lost", F.col("_rank") != F.col("_best"))
        # Counted while the round is written: who lost, and who asks for a number next.
        after = F.col("_k") + F.col("_lost").cast("int")
        seen = Observation()
        judged = cut_lineage(
            judged.observe(
                seen,
                F.count_if("_lost").alias("lost"),
                F.count_if(after >= F.size("_choices")).alias("numbered"),
            )
        )
        lost, numbered = seen.get["lost"], seen.get["numbered"]
        if lost == 0:
            done = judged.select("_rank", "_slug").unionByName(settled)
            return df.join(done.select(F.col("_rank").alias(rank), F.col("_slug").alias(out)), rank)
        state = _advance(judged, numbered)


def _uncontested(state: DataFrame, used: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(rows that need rounds, settled rows with their slug). A row is settled on its first
    choice if no other row can ever ask for that slug: nobody has it as a first or later
    choice, it is no numbered form of a stem, and it is not taken before."""
    first = F.get("_choices", F.lit(0))
    state = state.withColumn("_first", first)
    sole = state.groupBy("_first").agg((F.count(F.lit(1)) == 1).alias("_sole"))
    asked = state.select(F.explode(F.slice("_choices", F.lit(2), F.size("_choices"))).alias("_first"))
    if used is not None:
        asked = asked.unionByName(used.select(F.col(used.columns[0]).alias("_first")))
    asked = asked.distinct().withColumn("_asked", F.lit(True))
    stems = state.select(F.col("_stem").alias("_part")).distinct().withColumn("_numbered", F.lit(True))
    part = F.regexp_extract("_first", "^(.*)-[0-9]+$", 1)
    marked = (
        state.withColumn("_part", part)
        .join(sole, "_first", "left")
        .join(asked, "_first", "left")
        .join(stems, "_part", "left")
        .withColumn("_safe", F.coalesce(F.col("_sole") & F.col("_asked").isNull() & F.col("_numbered").isNull(), F.lit(False)))
    )
    marked = cut_lineage(marked.select(*state.columns, "_safe"))
    rest = marked.where(~F.col("_safe")).drop("_safe", "_first")
    return rest, marked.where("_safe").select("_rank", F.col("_first").alias("_slug"))


def _gaps(state: DataFrame, used: DataFrame) -> DataFrame:
    """Numbers taken before, as runs (_stem, _from, _over): the `_from`-th number in the count
    that leaves them out, and all after it, lie `_over` higher. The count starts at 2."""
    slug, form = F.col(used.columns[0]), "^(.*)-([1-9][0-9]{0,17})$"
    taken = (
        used.select(F.regexp_extract(slug, form, 1).alias("_stem"), F.regexp_extract(slug, form, 2).alias("_n"))
        .where(F.col("_n") != "")
        .select("_stem", F.col("_n").cast("bigint").alias("_n"))
        .where(F.col("_n") >= 2)
        .distinct()
        .join(state.select("_stem").distinct(), "_stem", "left_semi")
    )
    # A taken number with j taken ones below it has n - 2 - j free ones below it.
    placed = position_in_key(taken, ["_stem"], [F.col("_n")], "_j")
    runs = placed.groupBy("_stem", (F.col("_n") - F.col("_j")).alias("_from"))
    return cut_lineage(runs.agg((F.max("_j") + 1).alias("_over")))


def _numbers(state: DataFrame, gaps: DataFrame | None) -> DataFrame:
    """Add `_number`, the `_num`-th number of the stem that was not taken before. One sweep
    along each stem meets the runs and the askers in order."""
    if gaps is None:
        return state.withColumn("_number", F.col("_num"))
    named = F.col("_k") < F.size("_choices")
    askers = state.where(~named).withColumns({"_at": 2 * F.col("_num") + 1, "_over": F.lit(0).cast("bigint")})
    runs = gaps.select("_stem", (2 * F.col("_from")).alias("_at"), F.col("_over").cast("bigint").alias("_over"))
    met = running_max(askers.unionByName(runs, allowMissingColumns=True), ["_stem"], "_at", "_over", "_above")
    numbered = met.where(F.col("_rank").isNotNull()).withColumn("_number", F.col("_num") + F.col("_above"))
    plain = state.where(named).withColumn("_number", F.col("_num"))
    return plain.unionByName(numbered.select(*plain.columns))


def _advance(judged: DataFrame, n_numbered: int) -> DataFrame:
    """Losers move to their next choice; numbered entities move up together, numbered by a sort
    that splits a hot stem over many tasks."""
    cols = ["_rank", "_choices", "_stem", "_k", "_num"]
    named = F.col("_k") < F.size("_choices")
    moved = judged.withColumn("_was_numbered", ~named).withColumn(
        "_k", F.when(F.col("_lost") & named, F.col("_k") + 1).otherwise(F.col("_k"))
    )
    if not n_numbered:
        return moved.select(*cols)
    numbered = F.col("_k") >= F.size("_choices")
    rest = moved.where(~numbered).select(*cols)
    bump = (F.col("_lost") & F.col("_was_numbered")).cast("int")
    line = moved.where(numbered).select(*cols, bump.alias("_bump"))
    # Numbers rise strictly along the ranks of a stem, so a bump lifts everyone after it.
    lifted = F.col("_num") + F.col("_bump") - F.col("_pos")
    line = position_in_key(line, ["_stem"], [F.col("_rank")], "_pos")
    line = running_max(line.withColumn("_floor", lifted), ["_stem"], "_pos", "_floor", "_top")
    line = line.withColumn("_num", F.col("_top") + F.col("_pos"))
    return rest.unionByName(line.select(*cols))
