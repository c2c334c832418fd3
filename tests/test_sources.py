import datetime as dt
import zipfile

import pytest
from helpers import rows
from pyspark.sql import functions as F

from docketry import fixed
from docketry.operators.quality import GateError
from docketry.sources import cases, links, registers, registry, releases, workbooks

SIX = (
    "Fiscal Year,Employer (Petitioner) Name,Tax ID,Industry (NAICS) Code,Petitioner City,"
    "Petitioner State,Petitioner Zip Code,"
    + ",".join(f"{c} {o}" for c in fixed.CATEGORIES.values() for o in ("Approval", "Denial"))
)


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def parsed(spark, path, year=None):
    layout, df = registry.parse_registry(registry.read_registry_text(spark, path), year)
    return layout, [r.asDict() for r in df.collect()]


# --- registry B ---------------------------------------------------------------------------


def test_legacy_layout(spark, tmp_path):
    path = write(tmp_path / "l.csv",
        "﻿Fiscal Year,Employer,Initial Approval,Initial Denial,Continuing Approval,Continuing Denial,NAICS,Tax ID,State,City,ZIP\n"
        '2023,GOOGLE LLC,40,1,"1,120",2,54,3581,CA,Mountain View,94043\n,,,,,,,,,,\n2023,,3,0,1,0,54,1111,VA,RESTON,20190\n')  # fmt: skip
    layout, out = parsed(spark, path, 2023)
    assert layout == "legacy" and len(out) == 2
    g = out[0]
    assert (g["employer_name"], g["city"], g["initial_approvals"], g["continuing_approvals"]) == ("GOOGLE LLC", "MOUNTAIN VIEW", 40, 1120)
    assert g["new_employment_approvals"] is None
    assert out[1]["employer_name"] is None


def test_six_category_keeps_missing_apart_from_zero(spark, tmp_path):
    path = write(tmp_path / "s.csv", SIX + "\n"
        "2024,G,3581,54,X,ca,1,20,1,2,0,50,0,10,0,15,0,5,0\n"
        "2024,M,42,54,X,WA,1,18,0,,,1,0,1,0,1,0,1,0\n"
        "2024,U,1,61,X,MA,1,,,,,,,,,,,,\n")  # fmt: skip
    layout, (g, m, u) = parsed(spark, path)
    assert layout == "six_category"
    assert (g["initial_approvals"], g["continuing_approvals"], g["initial_denials"], g["state"]) == (22, 80, 1, "CA")
    assert (m["new_concurrent_approvals"], m["initial_approvals"], m["tax4"]) == (None, 18, "0042")
    assert (u["initial_approvals"], u["continuing_denials"]) == (None, None)


def test_utf16_tabs_and_thousands(spark, tmp_path):
    line = "2025\tBig\t1\t54\tX\tVA\t1\t" + "\t".join(["1,200", "0", "4", "0", "2,000", "0", "300", "0", "450", "0", "90", "0"])
    path = write(tmp_path / "u.csv", SIX.replace(",", "\t") + "\n" + line + "\n", "utf-16")
    layout, (r,) = parsed(spark, path)
    assert layout == "six_category"
    assert (r["new_employment_approvals"], r["initial_approvals"], r["continuing_approvals"]) == (1200, 1204, 2840)


def test_long_layout_is_widened(spark, tmp_path):
    lines = ["Fiscal Year\tEmployer (Petitioner) Name\tTax ID\tPetitioner State\tPetitioner City\tMeasure Names\tMeasure Values"]
    for key, label in fixed.CATEGORIES.items():
        for outcome, v in (("Approvals", 10), ("Denials", 1)):
            value = "" if (key, outcome) == ("amended", "Denials") else v
            lines.append(f"2024\tACME LLC\t1111\tVA\tRESTON\t{label} {outcome}\t{value}")
    layout, (r,) = parsed(spark, write(tmp_path / "long.csv", "\n".join(lines) + "\n", "utf-16"))
    assert layout == "long"
    assert (r["initial_approvals"], r["continuing_approvals"], r["amended_denials"], r["continuing_denials"]) == (20, 40, None, 3)
    path = write(tmp_path / "twice.csv", "\n".join([lines[0], lines[1], lines[1]]) + "\n", "utf-16")
    with pytest.raises(registry.LayoutError, match="repeated"):
        parsed(spark, path)


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("Employer,Tax ID,State,Measure Names,Measure Values\nA,1,VA,Approval Rate,0.9\n", "unknown measure"),
        (SIX.replace(",Amended Approval,Amended Denial", "") + "\n", "lacks"),
        ("Employer,Approvals Total\nA,3\n", "no approval columns"),
        ("Name of it,Initial Approval\nA,3\n", "no employer name"),
    ],
)
def test_refused_layouts(spark, tmp_path, text, message):
    with pytest.raises(registry.LayoutError, match=message):
        parsed(spark, write(tmp_path / "f.csv", text), 2024)


def test_plural_headers_and_declared_year(spark, tmp_path):
    header = SIX.replace("Approval", "Approvals").replace("Denial", "Denials").replace("Fiscal Year,", "")
    path = write(tmp_path / "p.csv", header + "\nACME,42,54,RESTON,va,20190" + ",1" * 12 + "\n")
    _, (r,) = parsed(spark, path, 2026)
    assert (r["fiscal_year"], r["tax4"], r["state"], r["initial_approvals"]) == (2026, "0042", "VA", 2)


def test_load_checks_years_and_required_files(spark, tmp_path):
    write(tmp_path / "uscis_hub_FY2026.csv", SIX + "\n2025,ACME,1111,54,X,VA,1" + ",0" * 12 + "\n")
    declared = releases.declared_registry_files()
    with pytest.raises(FileNotFoundError):
        releases.present_files(spark, declared, str(tmp_path))
    optional = [f for f in declared if not f.required]
    found = releases.present_files(spark, optional, str(tmp_path))
    assert [f.fiscal_year for f in found] == [2026]
    with pytest.raises(GateError, match="fiscal year"):
        registry.load_registry(spark, found, str(tmp_path))


# --- cases --------------------------------------------------------------------------------


def raw_case(**kw):
    row = dict.fromkeys(fixed.CASE_HEADERS.values())
    row.update(
        CASE_NUMBER="I-200-21145-341080", CASE_STATUS="Certified", DECISION_DATE="45839",
        RECEIVED_DATE="2025-06-01", EMPLOYER_NAME="Acme\tInc", EMPLOYER_FEIN="39-0989781",
        EMPLOYER_STATE="Virginia", EMPLOYER_CITY="Reston", SOC_CODE="19-2012.00",
        WAGE_RATE_OF_PAY_FROM="$1,234.5", WAGE_UNIT_OF_PAY="Year", PW_WAGE_LEVEL="ii",
        H_1B_DEPENDENT="No", TOTAL_WORKER_POSITIONS="1", FULL_TIME_POSITION="Y",
    )
    row.update(kw)
    return row


def raw_frame(spark, *rows_, drop=(), rename=None):
    names = [h for h in fixed.CASE_HEADERS.values() if h not in drop]
    data = [tuple(r[h] for h in names) for r in rows_]
    shown = [(rename or {}).get(h, h) for h in names]
    return spark.createDataFrame(data, ", ".join(f"`{h}` string" for h in shown))


def release(fy, q):
    return next(r for r in releases.declared_releases() if (r.kind, r.fiscal_year, r.quarter) == ("lca", fy, q))


def test_canonical_columns_types_and_deviations(spark):
    df = cases.canonical(raw_frame(spark, raw_case(), raw_case(CASE_NUMBER=" "), raw_case(CASE_NUMBER=None)), release(2024, 2))
    (r,) = df.collect()
    assert df.columns[:3] == ["case_number", "fiscal_year", "case_status"]
    assert (r.decision_date, r.received_date) == (dt.date(2025, 7, 1), dt.date(2025, 6, 1))
    assert (r.employer_name, r.employer_city, r.employer_state, r.soc_code) == ("Acme Inc", "RESTON", "VA", "19-2012")
    assert (r.wage_from, r.pw_wage_level, r.h1b_dependent, r.full_time, r.total_workers) == (1234.5, "II", False, True, 1)
    assert (r.fiscal_year, r.source_quarter, r.source_file) == (2024, 2, "LCA_Disclosure_Data_FY2024_Q2.xlsx")
    old = cases.canonical(raw_frame(spark, raw_case(), drop=("EMPLOYER_FEIN",)), release(2023, 1))
    assert old.first().employer_fein is None
    odd = raw_frame(spark, raw_case(), rename={"H_1B_DEPENDENT": "H-1B_DEPENDENT"})
    assert cases.canonical(odd, release(2025, 1)).first().h1b_dependent is False
    with pytest.raises(KeyError, match="H_1B_DEPENDENT"):
        cases.canonical(odd, release(2025, 2))


def test_latest_quarter_wins_within_a_year_only(spark):
    a = cases.canonical(raw_frame(spark, raw_case()), release(2024, 1))
    b = cases.canonical(raw_frame(spark, raw_case(CASE_STATUS="Withdrawn")), release(2024, 3))
    c = cases.canonical(raw_frame(spark, raw_case(CASE_STATUS="Denied")), release(2025, 3))
    kept = cases.latest_cases(cases.union_releases([a, b, c]))
    assert rows(kept.select("fiscal_year", "case_status")) == [(2024, "Withdrawn"), (2025, "Denied")]


def test_unmapped_status_stops_the_load(spark):
    raw = {release(2024, 1): raw_frame(spark, raw_case(CASE_STATUS="Pending"))}
    with pytest.raises(GateError, match="PENDING"):
        cases.all_cases(raw)


def test_worksites(spark):
    names = list(fixed.WORKSITE_HEADERS.values())
    values = {"CASE_NUMBER": "I-1", "WORKSITE_WORKERS": "2", "WORKSITE_STATE": "MARYLAND", "WORKSITE_CITY": "Rockville"}
    df = spark.createDataFrame([tuple(values.get(n) for n in names)], ", ".join(f"{n} string" for n in names))
    rel = next(r for r in releases.declared_releases() if r.kind == "lca_worksites")
    r = cases.worksites({rel: df}).first()
    assert (r.worksite_workers, r.worksite_state, r.worksite_city) == (2, "MD", "ROCKVILLE")


# --- workbooks ----------------------------------------------------------------------------


def make_workbook(path, header, data, blanks):
    """A workbook with shared strings for the header, inline strings and numbers below."""
    shared = "".join(f"<si><t>{h}</t></si>" for h in header)
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = ['<row r="1">' + "".join(f'<c r="{chr(65 + i)}1" t="s"><v>{i}</v></c>' for i in range(len(header))) + "</row>"]
    n = 2
    for row in data:
        cells = ""
        for i, v in enumerate(row):
            ref = f"{chr(65 + i)}{n}"
            if v is not None:
                cells += f'<c r="{ref}"><v>{v}</v></c>' if isinstance(v, int) else f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
        out.append(f'<row r="{n}">{cells}</row>')
        n += 1
    for _ in range(blanks):
        out.append(f'<row r="{n}"><c r="A{n}" s="1"/></row>')
        n += 1
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{''.join(out)}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{shared}</sst>")


def test_workbooks_are_read_and_counted_apart(spark, tmp_path):
    header = ["CASE_NUMBER", "WAGE"]
    make_workbook(tmp_path / "a.xlsx", header, [["I-1", 45839], ["I-2", None], ["I-3", 7]], 4)
    make_workbook(tmp_path / "b.xlsx", header, [["I-9", 1]], 0)
    paths = [str(tmp_path / "a.xlsx"), str(tmp_path / "b.xlsx")]
    df = workbooks.read_workbooks(spark, paths, header, key="CASE_NUMBER")
    assert df.rdd.getNumPartitions() == 2
    assert rows(df) == [("I-1", "45839", "a.xlsx"), ("I-2", None, "a.xlsx"), ("I-3", "7", "a.xlsx"), ("I-9", "1", "b.xlsx")]
    counts = workbooks.count_workbooks(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: (r.header, r.data_rows, r.blank_rows, r.last_data_row, r.first_blank_row) for r in counts.collect()}
    assert got == {"a.xlsx": (header, 3, 4, 4, 5), "b.xlsx": (header, 1, 0, 2, None)}
    assert workbooks.staged_mismatches(counts, df).isEmpty()
    assert workbooks.staged_mismatches(counts, df.where("CASE_NUMBER <> 'I-2'")).count() == 1


# --- registers and links ------------------------------------------------------------------


def test_registers(spark, tmp_path):
    eo = write(tmp_path / "eo1.csv", "EIN,NAME,SUBSECTION,NTEE_CD\n530196605,X,03,B42\n12,Y,03,B42\n")
    assert rows(registers.read_exempt_register(spark, eo)) == [("53-0196605", "03", "B42")]
    good = write(tmp_path / "g.csv", ",".join(fixed.GROUP_COLUMNS) + "\na,A,11-1111111,proposed,,,,\n")
    assert registers.read_group_map(spark, good).count() == 1
    bad = write(tmp_path / "b.csv", "slug,name,fein,status,evidence_url,reviewed_by,reviewed_on,note\na,A,11-1111111,proposed,,,,\n")
    with pytest.raises(Exception, match="CSV header does not conform"):
        registers.read_group_map(spark, bad).collect()


def test_newer_releases(spark):
    files = ["LCA_Disclosure_Data_FY2021_Q4", "LCA_Disclosure_Data_FY2025_Q4", "LCA_Worksites_FY2025_Q4",
             "LCA_Disclosure_Data_FY2026_Q1", "LCA_Disclosure_Data_FY2026_Q4", "LCA_Worksites_FY_2026_Q4",
             "LCA_Disclosure_Data_FY2027_Q1", "PERM_Disclosure_Data_FY2026_Q4"]
    html = "".join(f'<a href="/f/{f}.xlsx">x</a>' for f in files) + '<a HREF="h1b_datahubexport-2024.csv">'
    pages = spark.createDataFrame([("https://agency.test/p/list", html)], "url string, html string")
    urls = links.page_links(pages)
    table = releases.release_table(spark, releases.declared_releases())
    got = rows(links.newer_releases(urls, table))
    assert [f for f, _ in got] == ["LCA_Disclosure_Data_FY2026_Q4.xlsx", "LCA_Disclosure_Data_FY2027_Q1.xlsx", "LCA_Worksites_FY_2026_Q4.xlsx"]
    assert got[0][1] == "https://agency.test/f/LCA_Disclosure_Data_FY2026_Q4.xlsx"
    years = spark.createDataFrame([(2023,)], "fiscal_year int")
    assert rows(links.newer_registry_files(urls, years)) == [("h1b_datahubexport-2024.csv", "https://agency.test/p/h1b_datahubexport-2024.csv")]


def test_links_resolve_like_urljoin(spark):
    from urllib.parse import urljoin

    bases = ["https://a.test/x/y?q=1#f", "http://a.test", "https://a.test/x/"]
    hrefs = ["/r", "s/t.csv", "https://b.test/z", "//c.test/w", "#top", "?p=2", "mailto:x@y.z"]
    data = [(b, h) for b in bases for h in hrefs]
    df = spark.createDataFrame(data, "b string, h string")
    got = df.select("b", "h", links.resolve_link(F.col("h"), F.col("b")).alias("u")).collect()
    assert {(r.b, r.h): r.u for r in got} == {(b, h): urljoin(b, h) for b, h in data}


def test_dot_segments_are_folded(spark):
    from docketry.sources.links import resolve_link

    base = "https://h.example/b/c/d.html?q#f"
    want = {
        "../x": "https://h.example/b/x", "./x": "https://h.example/b/c/x", "../../x/./y": "https://h.example/x/y",
        "../../../../x": "https://h.example/x", "..": "https://h.example/b/", ".": "https://h.example/b/c/",
        "/a/../z?p=../q": "https://h.example/z?p=../q", "x/../y#../z": "https://h.example/b/c/y#../z", "a..b": "https://h.example/b/c/a..b",
        "https://o.example/a/../b": "https://o.example/a/../b", "/": "https://h.example/", "../": "https://h.example/b/",
    }
    df = spark.createDataFrame([(k, base) for k in want], "link string, base string")
    assert {r.link: r.url for r in df.select("link", resolve_link(F.col("link"), F.col("base")).alias("url")).collect()} == want


def test_a_quoted_line_feed_stays_in_its_cell(spark, tmp_path):
    from docketry.sources import registry

    path = tmp_path / "r.csv"
    path.write_text('Fiscal Year,Employer (Petitioner) Name,Note\n2024,"ACME\nLLC","say ""hi"""\n2024,Plain,x\n')
    got = registry.read_registry_text(spark, str(path)).collect()
    assert sorted(r[1] for r in got) == ["ACME\nLLC", "Plain"]


def test_numbers_too_large_are_null(spark):
    from helpers import evaluate

    from docketry.functions import clean

    assert evaluate(spark, clean.separated_int, ["3,000,000,000", "12,5", "7.9"]) == [None, 125, 7]
    assert [str(x) for x in evaluate(spark, clean.serial_date, ["3000000000", "99999999999999", "2958465", "45000"])] == ["None", "None", "9999-12-31", "2023-03-15"]


QUOTED = [
    'Name,Note,N\n"Acme\nInc","say ""hi""\n\nthere",1\nplain,5" pipe,2\n"a,b","x",3\n\n"last\nline",,"4"\n',
    'Name,Note,N\n' + "".join(f'"{"x" * k}\n{"y" * (k % 7)}""",{"z" if k % 3 else """ "q""" },{k}\n' for k in range(12)) + '"' + "long\n" * 40 + '",b,c\nd,e,f\n',
    'Name,"No\nte",N\n1,2,3',
]


def cells(df):
    return sorted((tuple(None if c is None else c.replace("\r\n", "\n") for c in r) for r in df.collect()), key=str)


@pytest.mark.parametrize("text", QUOTED)
def test_split_reading_equals_reading_in_one_piece(spark, tmp_path, text):
    from docketry.sources import split_text

    for name, value in (("maxPartitionBytes", "40"), ("openCostInBytes", "1")):
        spark.conf.set(f"spark.sql.files.{name}", value)
    try:
        path = write(tmp_path / "q.csv", text)
        want = spark.read.csv(path, header=True, multiLine=True, escape='"')
        got = split_text.read_delimited(spark, path, ",")
        assert got.columns == want.columns
        assert cells(registry.not_blank(got)) == cells(want)
        for charset, mark in (("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"")):
            # Letters whose bytes, side by side, hold those of a line feed.
            wide = text.replace("x", "\u0a41\u0100").replace(",", "\t")
            path = tmp_path / f"w{charset}{len(mark)}.txt"
            path.write_bytes(mark + wide.encode(charset))
            encoding, sep = registry.sniff(spark, str(path))
            assert (encoding, sep) == (charset.upper().replace("-", "").replace("F16", "F-16"), "\t")
            plain = write(tmp_path / f"w{charset}{len(mark)}.csv", wide)
            want = spark.read.csv(plain, header=True, multiLine=True, escape='"', sep="\t")
            assert cells(registry.not_blank(split_text.read_delimited(spark, str(path), sep, encoding))) == cells(want)
    finally:
        for name in ("maxPartitionBytes", "openCostInBytes"):
            spark.conf.unset(f"spark.sql.files.{name}")


def test_a_quoted_file_is_read_by_many_tasks(spark, tmp_path):
    from docketry.sources import split_text

    path = write(tmp_path / "m.csv", "Name,Note\n" + '"a\nb",c\n' * 5000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        assert split_text._lines(spark, path).rdd.getNumPartitions() > 8
        assert registry.read_registry_text(spark, path).count() == 5000
        assert registry.raw_records(spark, path).first()["rows"] == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_records_of_quoted_and_utf16_files_are_not_shuffled(spark, tmp_path, monkeypatch):
    from docketry.sources import split_text

    text = "Name,Note,N\n" + "".join(f'"{"x" * (k % 3)}\n{"long" * 9}\n",{k},"b\n"\n' for k in range(20)) + '"a\n' + "line\n" * 60 + '",b,c\nd,e,f\n'
    (tmp_path / "q.csv").write_text(text)
    # Letters whose bytes, side by side, hold those of a line feed: in some places, and in one place only.
    for name, wide in (("w.txt", text.replace("x", "\u0a41\u0100")), ("o.txt", text.replace("d,e", "\u0a41\u0100,e"))):
        (tmp_path / name).write_bytes(wide.encode("utf-16-le"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        # Heads kept by the first pass, or read again.
        for name, charset, head in (("q.csv", "UTF-8", 4), ("w.txt", "UTF-16LE", split_text.HEAD), ("o.txt", "UTF-16LE", 4)):
            monkeypatch.setattr(split_text, "HEAD", head)
            records = split_text.records_of(spark, str(tmp_path / name), ",", charset)
            assert "Exchange" not in planned(records)
            got = [r.value for r in sorted(records.collect(), key=lambda r: (r.block, r.seq))]
            whole = (tmp_path / name).read_bytes().decode("utf-8" if charset == "UTF-8" else "utf-16-le")
            assert len(got) == 23 and "\n".join([*got, ""]) == whole
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_wide_records_are_put_together_in_one_step(spark, tmp_path, monkeypatch):
    from docketry.sources import split_text

    # Letters whose bytes, side by side, hold those of a line feed; returns and marks at the ends of lines.
    text = "\ufeffName\tNote\r\n" + "".join(f'"{"\u0a41\u0100" * (k % 3)}\r\n{"long" * 9}\n"\t5" {k}\u0a4e\u0100\r\n' for k in range(20)) + '\ufeff"a\n' + "line\u0a4e\u0100\n" * 60 + '"\tb\r\nd\te'
    want = text.replace("\r", "").replace("\ufeff", "")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    try:
        for charset, head in (("UTF-16LE", split_text.HEAD), ("UTF-16BE", 4)):
            monkeypatch.setattr(split_text, "HEAD", head)
            path = tmp_path / charset
            path.write_bytes(text.encode(charset))
            records = split_text.records_of(spark, str(path), "\t", charset)
            plan = planned(records)
            assert plan.count("MapInArrow") == 1 and "regexp" not in plan.lower() and "rlike" not in plan.lower()
            assert "\n".join(r.value for r in sorted(records.collect(), key=lambda r: (r.block, r.seq))) == want
            read = split_text.read_delimited(spark, str(path), "\t", charset)
            assert "parquet" not in planned(read).lower() and read.columns == ["Name", "Note"]
            assert read.count() == 22
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_wide_file_that_ends_inside_a_character_is_refused(spark, tmp_path):
    from docketry.sources import split_text

    (tmp_path / "o.txt").write_bytes("a\tb\nc\td\n".encode("utf-16-le") + b"e")
    with pytest.raises(ValueError, match="inside a character"):
        split_text.read_delimited(spark, str(tmp_path / "o.txt"), "\t", "UTF-16LE")


def test_states_of_a_text_are_those_of_its_lines(spark):
    from itertools import product

    import numpy as np

    from docketry.sources import split_text

    lines = ["".join(p) for n in range(6) for p in product('",a', repeat=n)]
    rules = spark.createDataFrame([(x,) for x in lines], "value string").select("value", *split_text.quote_rules(F.col("value"), ",")).collect()
    ends = {False: {r[0]: r[1] for r in rules}, True: {r[0]: r[2] for r in rules}}
    assert len(ends[True]) == 364
    for first in (False, True):
        state, want = first, []
        for x in lines:
            state = ends[state][x]
            want.append(state)
        for charset, kind in (("utf-8", "u1"), ("utf-16-le", "<u2"), ("utf-16-be", ">u2")):
            units = np.frombuffer("\n".join([*lines, ""]).encode(charset), kind)
            feeds, states = split_text._states(units, True, ",")
            assert len(feeds) == len(lines) and states[first].tolist() == [*want, want[-1]]


def test_a_record_is_parsed_once(spark, tmp_path):
    from docketry.sources import split_text

    path = write(tmp_path / "p.csv", 'Name,Note,N\n"a\nb",c,1\n')
    read = registry.not_blank(split_text.read_delimited(spark, path, ","))
    assert planned(read).count("from_csv") == 1
    assert cells(read) == [("a\nb", "c", "1")]


def test_row_gate_of_the_registry(spark, tmp_path, monkeypatch):
    write(tmp_path / "uscis_hub_FY2026.csv", SIX + "\n2026,ACME,1111,54,X,VA,1" + ",0" * 12 + "\n")
    files = releases.present_files(spark, [f for f in releases.declared_registry_files() if f.fiscal_year == 2026], str(tmp_path))
    assert registry.load_registry(spark, files, str(tmp_path))[0].count() == 1
    real = registry.read_registry_text
    monkeypatch.setattr(registry, "read_registry_text", lambda *a: real(*a).limit(0))
    with pytest.raises(GateError, match="records"):
        registry.load_registry(spark, files, str(tmp_path))
