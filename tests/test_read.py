"""Explore, search, profile; publication, arrivals, gates, groups, inventory."""

import random
import uuid

import pytest
from helpers import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry import fixed
from docketry.functions.names import normalize_name
from docketry.operators import groups, inventory, quality
from docketry.plans import explore, name_index, profile, publish, search
from docketry.streaming import arrivals

HOSTILE = ["%00", "\\", "0 UNION SELECT 1", "*/ /*", "${7*7}", "\u202e", "null", ",,,", "-0", " "]
FIELDS = ["role", "state", "level", "fy", "min", "hide_dependent", "hide_cap_exempt", "sort", "page"]


def test_parse_request():
    assert explore.parse_request({}) == explore.Request() == explore.parse_request({"role": [], "min": None})
    role, other = fixed.ROLE_GROUPS[0], fixed.ROLE_GROUPS[-1]
    full = {"role": f"{other},{role},{other}", "state": ["tx", " Ny "], "level": ["IV,none,I"], "fy": " 2024", "min": "007",
            "hide_cap_exempt": ["1"], "sort": ["name", "wage"], "page": "12"}
    want = explore.Request(roles=(other, role), states=("TX", "NY"), levels=("IV", "I"), year=2024, minimum=7,
                           hide_exempt=True, sort="name", page=12)
    assert explore.parse_request(full, [2024]) == want
    for bad in HOSTILE:
        assert explore.parse_request(dict.fromkeys(FIELDS, bad), [2024]) == explore.Request()
    assert [explore.parse_request({"fy": y}, [2024]).year for y in ("2023", "24", "２０２４", "2024a", "+2024")] == [None] * 5
    assert [explore.parse_request({"min": n}).minimum for n in ("9" * 10, "9" * 11, "1.5", "²")] == [explore.MIN_CEILING, 0, 0, 0]
    assert [explore.parse_request({"page": n}).page for n in ("0", "999999", "x")] == [1, explore.PAGE_CEILING, 1]


def small_cube(spark):
    cube = spark.createDataFrame(
        [(1, 2025, "Finance", "VA", "I", 5, 0, None), (2, 2025, "Finance", "VA", "I", 7, 2, 200001.0), (2, 2024, "Other", "??", "none", 1, 0, None),
         (3, 2025, "Other", "DC", "IV", 7, 1, 90000.0)],
        "employer_id int, fiscal_year int, role_group string, worksite_state string, wage_level string, certified int, wage_rows int, wage_sum double",
    )
    emp = spark.createDataFrame(
        [(1, "acme", 'Acme, "The" Co', None, None, None, None), (2, "beta", "=Beta", "VA", 3, True, None), (3, "gamma", "Gamma", "DC", 0, False, "naics_611310")],
        "employer_id int, slug string, display_name string, state string, uscis_initial_total int, h1b_dependent_latest boolean, cap_exempt_rule string",
    )
    return cube, emp


def test_explore_page_and_export_list_the_same_rows(spark, tmp_path):
    cube, emp = small_cube(spark)
    page = explore.explore_page(cube, emp, explore.Request()).collect()
    assert [(r.slug, r.certified, r.avg_wage, r.total_rows) for r in page] == [("beta", 8, 100001.0, 3), ("gamma", 7, 90000.0, 3), ("acme", 5, None, 3)]
    assert [r.slug for r in explore.explore_page(cube, emp, explore.Request(sort="wage")).collect()] == ["beta", "gamma", "acme"]
    assert [r.slug for r in explore.explore_page(cube, emp, explore.Request(hide_dependent=True, hide_exempt=True)).collect()] == ["acme"]
    assert [r.slug for r in explore.explore_page(cube, emp, explore.Request(states=("DC",), minimum=7)).collect()] == ["gamma"]
    assert [r.slug for r in explore.explore_page(cube, emp, explore.Request(), limit=1, offset=1).collect()] == ["gamma"]
    out = explore.export_rows(cube, emp, explore.Request(), [2023, 2024])
    explore.write_export(out, str(tmp_path / "csv"))
    (file,) = (tmp_path / "csv").glob("*.csv")
    lines = file.read_text().splitlines()
    assert lines[0].split(",")[5] == "uscis_initial_approvals_fy2023_fy2024"
    assert [x.rsplit("/", 1)[1] for x in lines[1:]] == [r.slug for r in page]
    assert lines[1].startswith("'=Beta,VA,8,100001,2,3,true,,")
    assert lines[3] == '"Acme, ""The"" Co",,5,,0,,,,/employer/acme'
    assert explore.export_columns([])[5] == "uscis_initial_approvals_not_loaded"


def plain_trigrams(s):
    out = set()
    for w in s.split():
        p = f"  {w} "
        out |= {p[i : i + 3] for i in range(len(p) - 2)}
    return out


def test_batch_search_finds_what_brute_force_finds(spark, tmp_path):
    rnd = random.Random(3)
    words = ["GOOGLE", "GOOD", "AMAZON", "AMA", "ACME", "BANK", "BANC", "US", "OF", "THE", "WEST", "A1"]
    names = sorted({" ".join(rnd.choices(words, k=rnd.randint(1, 3))) for _ in range(120)})
    alias = spark.createDataFrame([(i % 70 + 1, n, 1 + i % 5) for i, n in enumerate(names)], "employer_id int, name string, rows int")
    alias = alias.withColumn("norm", normalize_name(F.col("name")))
    emp = spark.createDataFrame([(i, f"s{i}", f"E{i % 9}", i % 4, None) for i in range(1, 71)],
                                "employer_id int, slug string, display_name string, certified_total int, uscis_initial_total int")
    asked = ["google", "goog", "us", "bank of", "amazn", "zz", "x", "The Acme, Inc."]
    got = search.search_batch(spark.createDataFrame([(q,) for q in asked], "q string"), alias, emp, 50)
    found = {}
    for r in got.collect():
        found.setdefault(r.q, {})[r.employer_id] = r.tier
    norms = dict(zip(asked, [r[0] for r in spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "i int, q string").orderBy("i").select(normalize_name(F.col("q"))).collect()], strict=True))
    table = [(r.employer_id, r.norm) for r in alias.collect()]
    for q in asked:
        want = {}
        n, g = norms[q], plain_trigrams(norms[q])
        for e, norm in table:
            h = plain_trigrams(norm)
            sim = len(g & h) / len(g | h) if g | h else 0
            tier = 0 if norm == n else 1 if norm.startswith(n) else 2 if n in norm else 3 if sim >= 0.3 else None
            if len(n) >= 2 and tier is not None:
                want[e] = min(tier, want.get(e, 9))
        assert found.get(q, {}) == dict(want), q
    # The stored index gives the same rows, filled by overlapping arrivals, one of them twice.
    root = str(tmp_path / "names")
    with pytest.raises(FileNotFoundError):
        name_index.candidate_pairs(spark, root, alias.select(F.col("norm").alias("q_norm")))
    for part, some in enumerate(["employer_id < 20", "employer_id < 1", "employer_id < 50", "true"]):
        name_index.extend_index(alias.where(some), root, part, buckets=4)
    name_index.extend_index(alias, root, 1)
    stored = name_index.search_indexed(root, spark.createDataFrame([(q,) for q in asked], "q string"), alias, emp, 50)
    assert rows(stored) == rows(got)
    assert name_index.complete_parts(spark, root) == dict.fromkeys(range(4), 4)
    held = spark.read.parquet(f"{root}/forms")
    assert held.count() == held.select("norm").distinct().count() == alias.select("norm").distinct().count()
    one = search.search("google", alias, emp, 50).collect()
    assert {r.employer_id: r.tier for r in one} == found["google"]
    assert search.search("x", alias, emp).count() == 0


def test_a_batch_reads_only_its_posting_folders(spark, tmp_path):
    names = spark.createDataFrame([(f"NAME {i} {'LONG ' * (i % 12)}".strip(),) for i in range(300)], "norm string")
    root = str(tmp_path / "names")
    name_index.extend_index(names, root, 0, buckets=8)
    folders = {p.parent for p in (tmp_path / "names/postings").rglob("*.parquet")}
    pairs = name_index.candidate_pairs(spark, root, spark.createDataFrame([("NAME 12",)], "q_norm string"))
    assert "NAME 12" in {r.norm for r in pairs.collect()}
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert any("bucket" in line.split("PartitionFilters: ")[1] for line in plan.splitlines() if "PartitionFilters: " in line)
    postings = name_index._read_postings(spark, root, {0: 8})
    read = {r[0] for r in postings.where("kind = 'gram' AND bucket = 1 AND band = 3").select(F.input_file_name()).distinct().collect()}
    assert len(read) < len(folders)


def test_similar_employers_equal_brute_force(spark):
    rnd = random.Random(4)
    data = [(i, f"s{i}", f"E{i % 9}", rnd.choice(["54", None, "61"]), rnd.choice(["VA", "DC"]), rnd.random() > 0.2,
             rnd.choice([None, 1, 2, 3])) for i in range(80)]
    emp = spark.createDataFrame(data, "employer_id int, slug string, display_name string, naics string, state string, has_lca boolean, certified_total int")
    got = {}
    for r in profile.similar_employers(emp).collect():
        got.setdefault(r.asked_id, {})[r.place] = r.employer_id
    for i, _, _, naics, state, _, _ in data:
        others = [r for r in data if r[3] == naics and r[4] == state and r[0] != i and r[5] and naics]
        others.sort(key=lambda r: (r[6] is None, -(r[6] or 0), r[2], r[1]))
        assert got.get(i, {}) == {p: r[0] for p, r in enumerate(others[:8], 1)}


def test_group_years_total_row(spark):
    members = spark.createDataFrame([("g", 1), ("g", 2)], "group_slug string, employer_id bigint")
    year = spark.createDataFrame([(1, 2024, 5), (2, 2025, 7), (1, 2025, 1)], "employer_id bigint, fiscal_year int, certified int")
    got = rows(profile.group_years(members, year))
    assert got == [("g", 1, 2024, 5), ("g", 1, 2025, 1), ("g", 2, 2025, 7), ("g", None, 2024, 5), ("g", None, 2025, 8)]


# --- publication --------------------------------------------------------------------------


def test_publish_is_all_or_nothing(spark, tmp_path):
    root = str(tmp_path / "site")
    one = spark.range(5).withColumn("y", F.col("id") % 2)
    assert publish.current_version(spark, root) is None
    assert publish.publish({"t": one}, root, "1", partition_by={"t": ["y"]}) == {"t": 5}
    broken = spark.range(3).select(F.raise_error(F.lit("no")).cast("bigint").alias("id"))
    with pytest.raises(Exception, match="no"):
        publish.publish({"t": spark.range(9), "u": broken}, root, "2")
    assert publish.current_version(spark, root) == "1"
    assert publish.read_published(spark, root, "t").count() == 5
    publish.publish({"t": spark.range(9)}, root, "3", sort_by={"t": ["id"]})
    assert (publish.current_version(spark, root), publish.read_published(spark, root, "t").count()) == ("3", 9)


def test_closed_type_map():
    assert publish.sql_type(T.DecimalType(10, 2)) == "numeric(10,2)"
    assert publish.sql_type(T.ArrayType(T.IntegerType())) == "integer[]"
    assert publish.sql_type(T.TimestampNTZType()) == "timestamp"
    for kind in (T.DayTimeIntervalType(), T.MapType(T.StringType(), T.StringType()), T.BinaryType()):
        with pytest.raises(publish.UnsupportedType):
            publish.sql_type(kind)


def test_ordered_csv_parts(spark, tmp_path):
    publish.write_csv(spark.range(50).repartition(5), str(tmp_path / "o"), ["id"])
    seen = [int(x) for f in sorted((tmp_path / "o").glob("part*.csv")) for x in f.read_text().split()[1:]]
    assert seen == list(range(50))


# --- arrivals -----------------------------------------------------------------------------


def test_arrivals_rebuild_only_touched_years(spark, tmp_path):
    root, schema = str(tmp_path), "fiscal_year int, case_number string, source_quarter int, status string"
    key, order = ["fiscal_year", "case_number"], [F.desc("source_quarter")]

    def arrive(*data):
        spark.createDataFrame(list(data), schema).write.parquet(f"{root}/staged/{uuid.uuid4().hex}")
        arrivals.run_arrivals(arrivals.year_stream(spark, f"{root}/staged", schema), root, key, order)

    arrive((2024, "a", 1, "C"), (2025, "b", 1, "C"))
    arrive((2025, "b", 2, "W"), (2025, "c", 2, "C"))
    cols = ["fiscal_year", "case_number", "status"]
    want = [(2024, "a", "C"), (2025, "b", "W"), (2025, "c", "C")]
    assert rows(arrivals.current_rows(spark, root).select(*cols)) == want
    snapshots = {p.parent.name + "/" + p.name for p in tmp_path.glob("snapshot/batch=*/fiscal_year=*")}
    assert snapshots == {"batch=0/fiscal_year=2024", "batch=0/fiscal_year=2025", "batch=1/fiscal_year=2025"}
    # A repeated batch changes nothing; a late older quarter does not win.
    again = spark.createDataFrame([(2025, "b", 2, "W"), (2025, "c", 2, "C")], schema)
    arrivals.take_batch(again, 1, root, key, order)
    arrive((2025, "b", 1, "D"))
    assert rows(arrivals.current_rows(spark, root).select(*cols)) == want


def test_a_row_without_a_year_stops_the_batch(spark, tmp_path):
    schema = "fiscal_year int, case_number string, source_quarter int, status string"
    key, order = ["fiscal_year", "case_number"], [F.desc("source_quarter")]
    arrivals.take_batch(spark.createDataFrame([(2024, "a", 1, "C")], schema), 0, str(tmp_path), key, order)
    with pytest.raises(ValueError, match="without fiscal_year"):
        arrivals.take_batch(spark.createDataFrame([(2024, "a", 2, "W"), (None, "b", 1, "C")], schema), 1, str(tmp_path), key, order)
    assert rows(arrivals.current_rows(spark, str(tmp_path)).select("case_number", "status")) == [("a", "C")]
    assert not (tmp_path / "log" / "batch=1").exists()


def test_a_long_query_is_searched_whole_and_a_typed_one_is_not(spark):
    long = "alpha " * 30 + "omega"
    asked = spark.createDataFrame([(long,)], "q string")
    assert search.prepare_queries(asked).first().q_norm == long.upper()
    alias = spark.createDataFrame([(1, long, 1, long.upper())], "employer_id int, name string, rows int, norm string")
    emp = spark.createDataFrame([(1, "a", "A", 3, 1)], "employer_id int, slug string, display_name string, certified_total int, uscis_initial_total int")
    assert search.search(long, alias, emp).first().tier == search.EXACT
    assert search.typeahead(long, alias, emp).first().tier == search.PREFIX


# --- gates, groups, inventory -------------------------------------------------------------


def test_reconcile_counts_a_missing_side_whole(spark):
    raw = spark.createDataFrame([(2024, "submitted", 5), (2025, "submitted", 3)], "fiscal_year int, measure string, n bigint")
    pub = spark.createDataFrame([(2024, "submitted", 4), (2026, "submitted", 2)], "fiscal_year int, measure string, n bigint")
    got = quality.reconcile(raw, pub)
    assert rows(got.select("fiscal_year", "diff")) == [(2024, -1), (2025, 3), (2026, 2)]
    with pytest.raises(quality.GateError):
        quality.gate_reconcile(got)
    quality.gate_reconcile(quality.reconcile(raw, raw))


def test_group_checks(spark):
    def mapping(*given):
        return spark.createDataFrame(list(given), ", ".join(f"{c} string" for c in fixed.GROUP_COLUMNS))

    good = ("g", "G", "11-1111111", "reviewed", "https://e", "r", "2026-01-01", None)
    assert groups.check_groups(mapping(good)).count() == 1
    for change, problem in [({3: "maybe"}, "status"), ({2: "1"}, "fein"), ({0: "Bad Slug"}, "group_slug"), ({4: "http://e"}, "evidence"), ({5: None}, "evidence")]:
        row = tuple(change.get(i, v) for i, v in enumerate(good))
        with pytest.raises(ValueError, match=problem):
            groups.check_groups(mapping(row))
    with pytest.raises(ValueError, match="fein_repeated"):
        groups.check_groups(mapping(good, good))
    entity = spark.createDataFrame([("11-1111111", 1), ("22-2222222", 2)], "fein string, employer_id int")
    two = mapping(good, ("g", "G", "22-2222222", *good[3:]), ("h", "H", "33-3333333", *good[3:]))
    assert groups.group_members(two, entity).count() == 2
    assert groups.group_members(mapping(good), entity).count() == 0
    assert rows(groups.unknown_members(two, entity)) == [("33-3333333",)]


def test_inventory_and_changes(spark, tmp_path):
    for name in ("a", "b", "c"):
        (tmp_path / f"{name}.txt").write_text(name)
    first = inventory.file_inventory(spark, str(tmp_path))
    record = spark.createDataFrame([tuple(r) for r in first.collect()], first.schema)
    (tmp_path / "b.txt").write_text("changed")
    (tmp_path / "d.txt").write_text("d")
    now = inventory.file_inventory(spark, str(tmp_path))
    assert rows(inventory.changes(record, now)) == [("a.txt", "unchanged"), ("b.txt", "changed"), ("c.txt", "unchanged"), ("d.txt", "new")]
    assert rows(inventory.changes(now, record.where("file = 'a.txt'"))) == [("a.txt", "unchanged"), ("b.txt", "missing"), ("c.txt", "missing"), ("d.txt", "missing")]
    declared = spark.createDataFrame([("a.txt", 2024), ("b.txt", 2025), ("z.txt", 2026)], "file string, fiscal_year int")
    before, after = inventory.year_fingerprints(record, declared), inventory.year_fingerprints(now, declared)
    assert rows(inventory.changed_years(before, after)) == [(2025,)]


def test_stratified_sample_holds_every_stratum(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).alias("s"))
    got = quality.stratified_sample(df, "id", ["s"], 20).collect()
    assert len(got) == 20 and {r.s for r in got} == set(range(7))
