"""Resolution, linkage and aggregates over whole small loads."""

from flow import case, cases, registry
from helpers import rows
from pyspark.sql import functions as F

from docketry.operators import aggregates, linkage, links, resolve
from docketry.operators.quality import score_normalizer, score_resolver
from docketry.plans.case_flow import build_tables, meta_table, meta_years


def keyed(df):
    return resolve.keyed_summary(resolve.filing_summary(df)).cache()


def methods(spark, *given):
    df = cases(spark, *given)
    got = resolve.with_entity_key(df, keyed(df)).collect()
    return {r.case_number[2:]: (r.match_method, r.employer_key) for r in got}


def test_resolution_cascade(spark):
    g = dict(employer_name="Google LLC", employer_state="CA")
    got = methods(
        spark,
        case(1, **g, employer_fein="77-0493581"),
        case(2, employer_name="GOOGLE L.L.C.", employer_state="CA", employer_fein=None, fiscal_year=2023),
        case(3, employer_name="Google", employer_state="NY", employer_fein=None, fiscal_year=2023),
        case(4, employer_name="Twin LP", employer_fein="22-2222222"),
        case(5, employer_name="Twin LLC", employer_fein="33-3333333"),
        case(6, employer_name="Twin", employer_fein=None),
        case(7, employer_name="Tiny Inc", employer_fein=None),
        case(8, employer_name=None, employer_fein=None),
        case(9, employer_name="Twin", employer_state=None, employer_fein=None),
    )
    assert got["1"] == ("fein", "F:77-0493581")
    assert got["2"] == ("name_state_to_fein", "F:77-0493581")
    assert got["3"] == ("name_to_fein", "F:77-0493581")
    assert got["6"] == ("name_state_ambiguous", "N:TWIN|VA")
    assert got["7"] == ("name_state", "N:TINY|VA")
    assert got["8"] == ("name_state", "N:|VA")
    assert got["9"] == ("name_state_ambiguous", "N:TWIN|")


def test_dominant_id_outweighs_a_typo(spark):
    many = [case(i, employer_fein="11-1111111") for i in range(40)]
    got = methods(spark, *many, case("t", employer_fein="99-9999990"), case("old", employer_fein=None, fiscal_year=2023))
    assert got["old"] == ("name_state_to_dominant_fein", "F:11-1111111")
    assert got["t"] == ("fein", "F:99-9999990")


def test_entities_and_links(spark):
    df = cases(
        spark,
        case(1, employer_name="Acme Inc"), case(2, employer_name="Acme, Inc.", fiscal_year=2024),
        case(3, employer_name="ACME LLC", employer_fein="22-2222222", employer_city="AUSTIN", employer_state="TX"),
        case(4, employer_name="Acme Inc", fiscal_year=2024), case(5, employer_name=None, employer_fein=None),
    )
    k = keyed(df)
    entity = resolve.entities(k).cache()
    assert rows(entity.select("employer_id", "slug", "display_name", "fein", "city", "lca_rows")) == [
        (1, "acme-inc", "Acme Inc", "11-1111111", "RESTON", 3),
        (2, "acme-llc", "ACME LLC", "22-2222222", "AUSTIN", 1),
        (3, "no-name", "(no name)", None, "RESTON", 1),
    ]
    alias = resolve.aliases(k, entity)
    assert (1, "Acme Inc", "ACME", 2) in rows(alias)
    members = links.link_members(alias.join(entity.select("employer_id", "fein"), "employer_id")).cache()
    assert rows(members.select("norm", "employer_id", "group_size", "group_pairs")) == [("ACME", 1, 2, 1), ("ACME", 2, 2, 1)]
    asked = spark.createDataFrame([(2,)], "employer_id int")
    assert rows(links.partners_of(members, asked)) == [(2, 1, "ACME")]
    stats = resolve.resolution_stats(entity, alias, members).first()
    assert tuple(stats) == (3, 2, 1, 3, 1)
    attached = resolve.attach_entities(df, k, entity)
    assert rows(attached.select("case_number", "employer_id")) == [("I-1", 1), ("I-2", 1), ("I-3", 2), ("I-4", 1), ("I-5", 3)]


LCA = [
    case(1, employer_fein="82-2530621", employer_name="ASML US, LP", employer_state="AZ"),
    case(2, employer_fein="77-0568140", employer_name="ASML US, LLC", employer_state="AZ"),
    case(3, employer_fein="77-0493581", employer_name="Google LLC", employer_state="CA"),
    case(4, employer_fein="91-1144442", employer_name="Microsoft Corporation", employer_state="WA"),
    case(5, employer_fein=None, employer_name="Tiny Startup Inc", fiscal_year=2023),
]


def link(spark, *lines):
    k = keyed(cases(spark, *LCA))
    entity = resolve.entities(k).cache()
    summary = linkage.registry_summary(registry(spark, *lines)).cache()
    out = linkage.link_registry(linkage.registry_entities(summary), linkage.entity_places(k, entity)).cache()
    final = linkage.finalize_links(out, linkage.registry_only(out, entity)).cache()
    return entity, summary, final


OUTCOMES = [
    ("ASML US LLC,5,1,8140,AZ,C", "several_candidates_tax4", "77-0568140"),
    ("ASML US LLC,5,1,0000,AZ,C", "several_candidates", None),
    ("GOOGLE LLC,5,1,9999,CA,M", "rejected_tax4_differs", None),
    ("MICROSOFT CORP,5,1,4442,WA,R", "name_state_tax4", "91-1144442"),
    ("TINY STARTUP INC,1,0,1234,VA,R", "name_state", None),
    ("GOOGLE LLC,5,1,3581,NY,N", "no_name_state_match", None),
    ("GOOGLE LLC,5,1,3581,,N", "no_name_state_match", None),
    ("GOOGLE LLC,5,1,,CA,N", "no_name_state_match", None),
]


def test_link_outcomes(spark):
    entity, _, final = link(spark, *[line for line, _, _ in OUTCOMES])
    got = {
        (r.state, r.tax4, r.norm): r
        for r in final.join(entity.select("employer_id", "fein"), "employer_id", "left").collect()
    }
    assert len(got) == len(OUTCOMES)
    for line, method, fein in OUTCOMES:
        name, _, _, tax4, state, _ = line.split(",")
        r = got[state or None, tax4 or None, name.removesuffix(" LLC").removesuffix(" CORP").removesuffix(" INC")]
        assert (r.method, r.fein) == (method, fein)
        assert r.matched == (method in ("several_candidates_tax4", "name_state_tax4", "name_state"))
        assert r.final_id is not None


def test_registry_only_entities(spark):
    entity, summary, final = link(
        spark, "GOOGLE LLC,5,1,9999,CA,M", "STATE UNIVERSITY,9,1,1111,MA,B", "STATE UNIVERSITY,2,0,2222,NY,A", ",3,1,1111,VA,R"
    )
    fresh = final.orderBy("final_id").collect()
    assert [r.new_slug for r in fresh] == ["state-university", "google-llc-ca", "state-university-ny"]
    assert all(r.final_id > 5 for r in fresh)
    years = linkage.registry_years(linkage.with_final_id(summary, final))
    assert years.agg(F.sum("initial_approvals")).first()[0] == 16
    rates = linkage.link_rates(final, summary).first().asDict()
    assert (rates["unnamed_rows"], rates["unnamed_approvals"], rates["matched"], rates["uscis_employers"]) == (1, 4, 0, 3)


def test_name_and_city_by_most_approvals(spark):
    _, _, final = link(spark, "Google Llc,5,1,3581,CA,SMALL", "GOOGLE LLC,50,1,3581,CA,BIG", "Google L.L.C.,90,,3581,CA,UNKNOWN")
    r = final.first()
    assert (r["name"], r.city, r.approvals) == ("GOOGLE LLC", "BIG", 57)


# --- aggregates ---------------------------------------------------------------------------


def dims(spark, *given):
    df = aggregates.with_dimensions(aggregates.with_annual_pay(cases(spark, *given)))
    return df.withColumn("employer_id", F.col("employer_fein"))


def test_status_counts_and_quartiles(spark):
    status = ["Certified", "Certified - Withdrawn", "Withdrawn", "Denied", "Certified"]
    r = aggregates.entity_year(dims(spark, *[case(i, case_status=s) for i, s in enumerate(status)])).first()
    assert (r.submitted, r.certified, r.withdrawn, r.denied) == (5, 2, 2, 1)
    good = [case(i, wage_from=float(100_000 + 10_000 * i)) for i in range(5)]
    noise = [case(10, full_time=False), case(11, case_status="Denied"), case(12, case_status="Withdrawn"),
             case(13, wage_from=45.0), case(14, wage_from=95000.0, wage_unit="Hour"), case(15, wage_from=None)]
    r = aggregates.entity_year(dims(spark, *good, *noise)).first()
    assert (r.wage_rows, r.wage_p25, r.wage_median, r.wage_p75) == (5, 110000, 120000, 130000)


def test_missing_stays_missing(spark):
    df = dims(spark, case(1, wage_from=None, total_workers=None), case(2, case_status="Denied", employer_fein="22-2222222"))
    got = {r.employer_id: r for r in aggregates.entity_year(df).collect()}
    a, b = got["11-1111111"], got["22-2222222"]
    assert (a.wage_rows, a.wage_p25, a.certified_workers) == (0, None, None)
    assert (b.certified_workers, b.wage_median) == (0, None)
    cube = aggregates.fact_cube(df).first()
    assert (cube.certified, cube.wage_rows, cube.wage_sum) == (1, 0, None)


def test_level_mix_roles_and_prevailing(spark):
    levels = ["I", "I", "II", "III", "IV", None]
    r = aggregates.entity_year(dims(spark, *[case(i, pw_wage_level=v) for i, v in enumerate(levels)], case(9, case_status="Denied"))).first()
    assert (r.level_i, r.level_ii, r.level_iii, r.level_iv, r.level_none) == (2, 1, 1, 1, 1)
    soft = [case(i, wage_from=w) for i, w in enumerate([90000.0, 100000.0, 110000.0])]
    fin = [case(10 + i, soc_code="13-2051", wage_from=w) for i, w in enumerate([70000.0, 80000.0, None])]
    old = [case(20, fiscal_year=2023)]
    got = {r.role_group: r for r in aggregates.entity_year_role(dims(spark, *soft, *fin, *old)).collect()}
    s, f = got["Software engineering"], got["Finance"]
    assert (s.certified, s.wage_rows, s.wage_p25, s.wage_median, s.wage_p75) == (3, 3, 95000, 100000, 105000)
    assert (f.certified, f.wage_rows, f.wage_p25, f.wage_median, f.wage_p75) == (3, 2, 72500, 75000, 77500)
    assert (s.pw_rows, s.pw_median) == (3, 90000)


def test_entry_signal(spark):
    given = [case(1, pw_wage_level="I"), case(2, fiscal_year=2026, pw_wage_level="II"), case(3, pw_wage_level="I"),
             case(4, pw_wage_level="IV"), case(5, pw_wage_level="I", soc_code="11-1111"), case(6, fiscal_year=2023)]
    df = dims(spark, *given)

    def signal(*years):
        reg = spark.createDataFrame([("11-1111111", y, n) for y, n in years] or [("x", 1999, 1)], "employer_id string, fiscal_year int, initial_approvals int")
        return tuple(aggregates.entry_signal(df, reg).first())[1:]

    assert signal() == ("swe_data_fin", "2025-2026", 3, 5, None, False)
    assert signal((2025, 7)) == ("swe_data_fin", "2025-2026", 3, 5, None, False)
    assert signal((2025, 7), (2026, 5)) == ("swe_data_fin", "2025-2026", 3, 5, 12, True)


def test_top_lists_use_the_latest_certified_year(spark):
    given = [case(1, fiscal_year=2024, job_title="Old"), case(2, job_title="b"), case(3, job_title="A"), case(4, job_title="a"),
             case(5, fiscal_year=2026, case_status="Denied", job_title="Z")]
    got = rows(aggregates.top_values(dims(spark, *given)).where("kind = 'title'").select("fiscal_year", "value", "certified", "rank"))
    assert got == [(2025, "A", 2, 1), (2025, "B", 1, 2)]


def test_pay_exclusions(spark):
    pay = [(100000.0, "Year"), (10.0, "Year"), (95000.0, "Hour"), (None, "Year"), (120000.0, "Year")]
    df = dims(spark, *[case(i, wage_from=v, wage_unit=u) for i, (v, u) in enumerate(pay)])
    r = aggregates.pay_exclusion_totals(df).first()
    assert tuple(r) == (5, 4, 1, 1, 1, 1)


# --- the whole flow -----------------------------------------------------------------------


def test_build_tables(spark):
    groups = spark.createDataFrame(
        [("g", "G", f, "reviewed", "https://e.test", "r", "2026-01-01", "") for f in ("82-2530621", "77-0568140", "00-0000000")],
        "group_slug string, group_name string, fein string, status string, evidence_url string, reviewed_by string, reviewed_on string, note string",
    )
    reg = registry(spark, "MICROSOFT CORP,5,1,4442,WA,R", "STATE UNIVERSITY,3,1,1111,MA,B")
    t = build_tables(cases(spark, *LCA), reg, group_map=groups)
    emp = {r.display_name: r for r in t["agg_employers"].collect()}
    assert len(emp) == 6
    assert (emp["Microsoft Corporation"].has_uscis, emp["Microsoft Corporation"].uscis_initial_total) == (True, 5)
    only = emp["STATE UNIVERSITY"]
    assert (only.has_lca, only.lca_rows, only.certified_total, only.uscis_initial_total, only.naics) == (False, None, None, 3, "54")
    assert emp["Google LLC"].uscis_initial_total is None and emp["Google LLC"].has_uscis is False
    assert t["agg_groups"].count() == 2
    assert t["agg_links"].count() == 2
    assert t["agg_aliases"].where("source = 'uscis'").count() == 2
    assert t["agg_lca_year"].agg(F.sum("submitted")).first()[0] == 5
    meta = meta_table(spark, t, "2026-01-01T00:00:00", 2, etl_fingerprint="abc")
    got = {r.key: r.value for r in meta.collect()}
    assert (got["lca_years"], got["uscis_years"], got["entry_years"]) == ("[2023,2025]", "[2023]", "2023-2025")
    assert rows(meta_years(meta, "lca_years")) == [(2023,), (2025,)]
    assert rows(meta_years(meta, "none")) == []


def test_results_do_not_depend_on_partitioning(spark):
    df = cases(spark, *LCA, *[case(100 + i, wage_from=50000.0 + 7.25 * i, employer_city=f"C{i % 3}") for i in range(60)])
    reg = registry(spark, "MICROSOFT CORP,5,1,4442,WA,R", "A,1,1,1,MA,B", "A,1,1,2,MA,B")
    names = ["agg_employers", "agg_lca_year", "agg_lca_cube", "agg_aliases", "uscis_year"]
    first = {n: rows(d) for n, d in build_tables(df, reg).items() if n in names}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = build_tables(df.repartition(5, "wage_from"), reg.repartition(3))
        assert {n: rows(again[n]) for n in names} == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_pair_scores(spark):
    pairs = spark.createDataFrame(
        [("ASML US, LP", "ASML US, LLC", "0"), ("Google LLC", "Google, L.L.C.", "1"), ("Nobody A", "Nobody B", "0"), ("Acme", "Microsoft Corporation", "0")],
        "name_a string, name_b string, same string",
    )
    assert tuple(score_normalizer(pairs).first())[:4] == (1, 1, 0, 2)
    df = cases(spark, *LCA)
    k = keyed(df)
    resolved = resolve.attach_entities(df, k, resolve.entities(k))
    assert tuple(score_resolver(pairs, resolved).first())[:4] == (1, 0, 0, 3)
    assert aggregates.year_sources(df).count() == 2
