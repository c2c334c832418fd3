"""Registered queries against their SQL, and the pipeline stage by stage."""

import os
import re

import pytest
from plain import words

import corpus_pipeline
from docketry.llm.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{file}'")
    yield con
    con.close()


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    out = duck.execute(ORACLES[name])
    names = [c[0] for c in out.description]
    assert sorted(map(str, map(tuple, df.select(*names).collect()))) == sorted(map(str, out.fetchall()))
    assert sorted(names) == sorted(df.columns)


def test_one_query_for_every_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


@pytest.fixture(scope="module")
def stages(spark, shared_folder):
    """The table `documents`, then the rows each stage leaves."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF_DIR).write.parquet(f"{shared_folder}/stages/{n}")
        out.append(spark.read.parquet(f"{shared_folder}/stages/{n}"))
    return out


def test_stages_keep_the_columns_of_documents(stages):
    assert all(s.dtypes == stages[0].dtypes for s in stages[1:-1])
    assert stages[-1].columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_stages_decide_as_brute_force_does(spark, stages):
    kept = [{r.doc_id: r.text for r in s.select("doc_id", "text").collect()} for s in stages[:-1]]
    # Quality: what the op3 query keeps.
    good = {r.doc_id for r in QUERIES["op3_quality_rules"](spark, SF_DIR).where("kept").collect()}
    assert set(kept[1]) == good
    # Near duplicates among those: the smallest of each group by all pairs of five-word shingles.
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, t in kept[1].items() for w in [words(t.lower() if t.isascii() else "".join(c.lower() if c.isascii() else c for c in t))]}
    ids = sorted(sets)
    top = {k: k for k in ids}

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    assert set(kept[2]) == {k for k in ids if root(k) == k}
    # Leaks: no benchmark item is left word for word; what went held one.
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    holds = {k for k, t in kept[2].items() if any(i in " ".join(t.lower().split()) for i in items)}
    assert holds and holds == set(kept[2]) - set(kept[3])
    # Mixing: only documents that were there, at most three times.
    copies = stages[4].groupBy("doc_id").count().collect()
    assert {r.doc_id for r in copies} <= set(kept[3]) and max(r["count"] for r in copies) <= 3


def test_tokens_cover_the_mixture(stages):
    rows = stages[-1].orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in stages[-2].collect())
    assert all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:], strict=False))


def test_run_applies_all_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF_DIR)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages[-1].collect()))
