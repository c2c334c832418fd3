"""Toxicity: the chain against sums over all taggings, and held-out accuracy."""

import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from plain import documents, prose

from docketry.llm import toxic_crf as tc

LABELS = "doc_id long, quality int, toxic int"


def chain(rng):
    c = tc.Chain()
    c.emit = np.array([rng.gauss(0, 1) for _ in c.emit])
    c.emit[-1] = 0
    c.step = np.array([[rng.gauss(0, 1) for _ in range(2)] for _ in range(2)])
    c.start = np.array([rng.gauss(0, 1) for _ in range(2)])
    return c


def weight(c, scores, tags):
    total = c.start[tags[0]] + scores[0] * tags[0]
    for i in range(1, len(tags)):
        total += c.step[tags[i - 1], tags[i]] + scores[i] * tags[i]
    return math.exp(total)


def test_marginals_equal_sums_over_all_taggings():
    rng = random.Random(1)
    c = chain(rng)
    texts = ["one two three four five", "", "six", None, "a b c d e f g", "two two"]
    (t,) = tc.token_blocks(pa.array(texts))
    scores = c.emit[t.features].sum(axis=1)[t.kind]
    for length in (1, 3, 512):
        _, _, p = tc.marginals(tc.steps(scores, tc.firsts(t.words), c), length)
        for a, b in itertools.pairwise(t.words.first):
            ways = list(itertools.product((0, 1), repeat=b - a))
            weights = [weight(c, scores[a:b], w) for w in ways] if b > a else []
            for i in range(b - a):
                want = sum(x for x, w in zip(weights, ways, strict=True) if w[i]) / sum(weights)
                assert abs(p[a + i] - want) < 1e-9


def test_gradient_equals_differences_of_the_likelihood():
    rng = random.Random(2)
    c = chain(rng)
    (t,) = tc.token_blocks(pa.array(["one two three", "two four", "three"]))
    labels = np.array([0, 1, 1, 0, 1, 0])

    def loss():
        scores, out = c.emit[t.features].sum(axis=1)[t.kind], 0.0
        for a, b in itertools.pairwise(t.words.first):
            whole = sum(weight(c, scores[a:b], w) for w in itertools.product((0, 1), repeat=b - a))
            out += math.log(whole) - math.log(weight(c, scores[a:b], labels[a:b]))
        return out

    g = tc.gradient(t, labels, c)
    for values, slopes in ((c.step, g.step), (c.start, g.start), (c.emit, g.emit)):
        for at in list(np.ndindex(values.shape))[:4] if values is not c.emit else [(i,) for i in t.features[:, 0]]:
            before = values[at]
            values[at] = before + 1e-5
            up = loss()
            values[at] = before - 1e-5
            down = loss()
            values[at] = before
            assert abs((up - down) / 2e-5 - slopes[at]) < 1e-4


def test_spans_are_code_points_of_whole_runs():
    (t,) = tc.token_blocks(pa.array(["é bad WORDS, ok", "", "bad"]))
    assert tc.spans(np.array([0.1, 0.9, 0.5, 0.2, 0.7]), t) == ["2:11", "", "0:3"]


@pytest.fixture(scope="module")
def planted(spark):
    """Texts of four kinds of words; a tenth toxic, by single words or by a family of words."""
    rng = random.Random(5)
    rows, labels = [], []
    for k in range(1500):
        words = prose(rng, rng.randrange(15, 90)).split()
        toxic = k % 10 == 0
        if toxic:
            for _ in range(1 + len(words) // 25):
                words.insert(rng.randrange(len(words)), rng.choice(["Moron", "scum,", f"grûz{rng.randrange(900)}", "IDIOT."]))
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(toxic)))
    return documents(spark, rows), spark.createDataFrame(labels, LABELS)


def test_held_out_documents_are_told_apart(planted):
    docs, labels = planted
    model = tc.fit(docs, labels)
    got = tc.score_documents(docs, model).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    toxic = [r.predicted for r in held if r.toxic]
    plain = [r.predicted for r in held if not r.toxic]
    assert sum(toxic) >= 0.9 * len(toxic) > 20 and sum(plain) <= 0.01 * len(plain)
    text = {r.doc_id: r.text for r in docs.collect()}
    found = [text[r.doc_id][slice(*map(int, s.split(":")))].lower() for r in held if r.toxic for s in r.spans.split(",") if s]
    assert sum(f.startswith(("moron", "scum", "grûz", "idiot")) for f in found) >= 0.95 * len(found) > 20


def test_held_out_labels_are_not_learned(spark, planted):
    docs, labels = planted
    wrong = labels.withColumn("toxic", tc.F.when(tc.held_out(tc.F.col("doc_id")), 1 - tc.F.col("toxic")).otherwise(tc.F.col("toxic")))
    a, b = (tc.labelled_sample(docs, x, "doc_id", "text", "toxic", 10_000).collect() for x in (labels, wrong))
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_near_copies_count_once_in_the_sample(spark):
    text = prose(random.Random(1), 300)
    docs = documents(spark, [f"{text} {k}" for k in range(200)])
    labels = spark.createDataFrame([(k, 1, 1) for k in range(200)], LABELS)
    assert tc.labelled_sample(docs, labels, "doc_id", "text", "toxic", 1000).count() < 20


def test_awkward_rows_and_tables(spark, planted):
    docs, labels = planted
    model = tc.fit(docs, labels, sample=600, rounds=5)
    texts = [None, "", "...", "moron " * 30_000, "中" * 50_000, (1, "x"), (1, "x"), (None, "idiot")]
    odd = documents(spark, texts).selectExpr("*", "1 AS score", "'a' AS spans", "2 AS part", "3 AS toxic")
    got = tc.score_documents(odd, model).collect()
    assert len(got) == len(texts) and all(0 <= r.score <= 1 for r in got)
    assert got[0].score == got[1].score == got[2].score and got[-1].held_out
    none = docs.limit(0)
    assert tc.score_documents(none, model).collect() == []
    bare = tc.fit(docs, labels.limit(0))
    assert {r.score for r in tc.score_documents(docs, bare).collect()} == {0.5}
    plain = tc.fit(docs, labels.where("toxic = 0"), rounds=2)
    assert all(r.predicted == 0 for r in tc.score_documents(docs, plain).collect())
