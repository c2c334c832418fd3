"""Importance resampling: CRCs, gains and ranks against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from plain import documents, prose

from docketry.llm import importance as im

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_crc_of_ranges_is_crc32():
    rng = random.Random(4)
    strings = [rng.randbytes(n) for n in [0, 1, 2, 63, 64, 65, 127, 128, 129, 1000, 6400, 100_003, *[rng.randrange(200) for _ in range(300)]]]
    ends = np.cumsum([len(s) for s in strings])
    got = im.crc32_ranges(np.frombuffer(b"".join(strings), np.uint8), ends - [len(s) for s in strings], ends)
    assert got.tolist() == [zlib.crc32(s) for s in strings]


def features(text, longest):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = TOKEN.findall(low)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)], len(w)


def brute(docs, target, longest=1, buckets=im.BUCKETS):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t, longest)[0])
    t = Counter(bucket(f) for x in target for f in features(x, longest)[0])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    rows = []
    for key, text in docs:
        f, n = features(text, longest)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([key, len(f), weight, score, n >= 20])
    may = sorted((-r[3], r[0] is None, r[0]) for r in rows if r[4])
    place = {x[2]: i + 1 for i, x in enumerate(may[: 10 * len(may) // 100])}
    return sorted(((r[0], *r[1:4], place.get(r[0])) for r in rows), key=str)


def test_ranks_equal_plain_python(spark):
    rng = random.Random(7)
    texts = [prose(rng, rng.randrange(60)) for _ in range(120)]
    texts += [None, "", "x" * 5000, "ÄÖ ünder Ünder, it's 3.14 " * 9, "中文" * 400, texts[0], texts[0]]
    docs = documents(spark, [*texts, (None, prose(rng, 40))])
    target = documents(spark, [prose(rng, 50, vocabulary=40) for _ in range(9)] + [None])
    for longest in (1, 3):
        got = im.rank_documents(docs, target, longest=longest, buckets=500)
        pairs = [(r.doc_id, r.text) for r in docs.collect()]
        assert sorted(map(tuple, got.collect()), key=str) == brute(pairs, [r.text for r in target.collect()], longest, 500)


def test_resample_carries_columns_whatever_their_names(spark):
    docs = spark.range(50).selectExpr("id AS doc_id", "repeat('word ', 25) AS text", "id AS score", "'x' AS place", "1 AS row", "2 AS may")
    got = im.resample(docs, docs)
    assert got.columns == docs.columns and got.count() == 5


def test_ties_and_repeated_rows(spark):
    docs = documents(spark, [(1, "a " * 30), (1, "a " * 30), *[(k, "b " * 30) for k in range(2, 20)]])
    got = im.rank_documents(docs, docs).collect()
    assert len(got) == 20 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2]


def test_empty_tables(spark):
    docs = documents(spark, ["some words " * 20])
    none = docs.limit(0)
    assert im.rank_documents(none, docs).collect() == []
    assert [r.weight for r in im.rank_documents(docs, none).collect()][0] < 0
    assert im.resample(none, none).columns == docs.columns
