"""Line dedup against all pairs, and what dropping leaves."""

import random

from plain import documents

from docketry.llm import line_dedup as d


def one_edit(a, b):
    if a == b:
        return True
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(b))
    return a[i + 1 :] == b[i + 1 :] or (len(a) > len(b) and a[i + 1 :] == b[i:])


def brute(given, min_chars=20):
    lines = sorted(((k, n, x) for k, t in given for n, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\x0b\x0c\r")), key=lambda r: (r[0], r[1]))
    first, out, root = {}, [], {}
    for k, n, x in lines:
        if x in first:
            out.append((k, n, *root[first[x]]))
            continue
        near = [at for y, at in first.items() if min(len(x), len(y)) >= min_chars and one_edit(x, y)]
        first[x] = (k, n)
        root[k, n] = root[min(near)] if near else (k, n)
        if near:
            out.append((k, n, *root[k, n]))
    return sorted(out)


def edited(rng, line):
    i = rng.randrange(len(line))
    return rng.choice([line[:i] + line[i + 1 :], line[:i] + "ñ" + line[i:], line[:i] + "z" + line[i + 1 :]])


def table():
    rng = random.Random(5)
    bases = ["".join(rng.choice("abc é") for _ in range(n)).strip() + "q" for n in (5, 19, 20, 21, 22, 37, 64, 150)]
    bases += ["a" * 30, "ab" * 20, "x" * 5000]
    out = []
    for k in range(40):
        picked = [rng.choice(bases) for _ in range(rng.randrange(1, 5))]
        out.append((k, "\n".join(edited(rng, b) if rng.random() < 0.6 else b for b in picked) + rng.choice(["", "\n", "\n \n"])))
    return [*out, (100, None), (101, ""), (102, "\n\n")]


def test_removed_lines_equal_all_pairs(spark):
    given = table()
    got = sorted(tuple(r) for r in d.removed_lines(documents(spark, given)).collect())
    assert got == brute(given) and len(got) > 40


def test_dropping_keeps_other_lines_and_columns(spark):
    given = table()
    docs = documents(spark, given).withColumnsRenamed({"lang": "_gone", "source": "d"})
    gone = {(k, n) for k, n, *_ in brute(given)}
    out = d.drop_lines(docs)
    assert out.schema.names == docs.schema.names
    for r in out.collect():
        text = dict(given)[r.doc_id]
        want = text if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if (r.doc_id, n) not in gone)
        assert r.text == want
    assert d.removed_lines(docs.limit(0)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    line = "the same line of more than twenty"
    got = d.removed_lines(documents(spark, [(4, line), (4, line), (None, line + "s"), (6, line)])).collect()
    assert sorted(tuple(r) for r in got) == [(4, 0, None, 0), (4, 0, None, 0), (6, 0, None, 0)]  # line 4 goes itself


def test_chains_name_the_line_that_stays(spark):
    line = "a line that changes one by one"
    given = [(i, "b" * i + line[i:]) for i in range(9)] + [(20, "b" * 8 + line[8:])]
    got = sorted(tuple(r) for r in d.removed_lines(documents(spark, given)).collect())
    assert got == brute(given) and {r[2:] for r in got} == {(0, 0)}


def test_long_lines(spark):
    rng = random.Random(6)
    base = "".join(rng.choice("abcdé ") for _ in range(300_000)) + "q"
    run = "z" * 100_000
    given = [(1, base), (2, base[:200_000] + "W" + base[200_001:]), (3, base[:7] + base[8:]), (4, run), (5, run + "z"), (6, run + "zzz"), (7, base[1:-1])]
    got = sorted(tuple(r) for r in d.removed_lines(documents(spark, given)).collect())
    assert got == [(2, 0, 1, 0), (3, 0, 1, 0), (5, 0, 4, 0)]
