"""The registered queries of this subpackage, one per numbered operator, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import chat_format, decontaminate, hard_negatives, importance, line_dedup, minmax_dedup, pivotal_mix, quality_rules, ring_shards, secret_scan, substring_dedup, token_files, toxic_crf
from docketry.session import run_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


WORD = r"[^\x20\x09-\x0D]+"

OP3_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS (
  SELECT doc_id, regexp_extract_all(text, '{WORD}') AS w,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
    length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS n_letters FROM d
),
spelled AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i, len(w) AS n FROM base),
grams AS (
  SELECT doc_id, i, n, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS g
  FROM spelled
),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams WHERE i + 8 <= n),
covered AS (SELECT DISTINCT doc_id, i + unnest(range(8)) AS i FROM again WHERE c > 1),
repeats AS (SELECT doc_id, count(*) AS n_repeat_words FROM covered GROUP BY doc_id),
counts AS (
  SELECT base.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, n_upper, n_letters,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutter,
    len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]') OR strlen(x) > length(x))) AS n_worded
  FROM base LEFT JOIN repeats USING (doc_id)
),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 20 * n_words OR 100 * n_dup_lines > 60 * n_lines OR 100 * n_stutter > 30 * n_words
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 100 * n_upper > 60 * n_letters
    OR 100 * n_worded < 60 * n_words) AS kept
FROM judged
"""


@query("op3_quality_rules", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = [r for r in quality_rules.RULES if r not in (quality_rules.TOO_SHORT, quality_rules.REPEATED)]
    cascade = quality_rules.plan_cascade(docs, rules=rules)
    base = [quality_rules.TOO_SHORT, quality_rules.REPEATED]
    return quality_rules.apply_cascade(docs, cascade, measures=quality_rules.MEASURES, base=base).drop("text")


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN [[w[1]]]
    ELSE list_transform(range(1, len(w)), lambda i: [w[i], w[i + 1]]) END) AS g FROM w
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
meet AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT u, v FROM meet JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 80 * (x.n + y.n - k)
),
ways AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
reach AS (SELECT u AS doc_id, u AS other FROM ways UNION SELECT reach.doc_id, ways.v FROM reach JOIN ways ON ways.u = reach.other),
low AS (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(low.c, doc_id) AS component_id, coalesce(low.c, doc_id) = doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)
"""


@query("op9_minmax_near_dedup", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


@query("op10_pivotal_mix")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = pivotal_mix.mix_rows(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op8_ring_shards")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = ring_shards.shard_rows(rows, "doc_id", shards=40, order=["size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
),
sized AS (
  SELECT *, length(role) + length(text) + length('<turn:></turn>') + 1
    + length(regexp_replace(role || text, '[^<>\\]', '', 'g')) AS chars FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

CONTROL = "\\### Assistant: </turn> ok"


@query("op1_chat_format", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    kept = given.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.range(2, numPartitions=1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL).alias("text"),
    )
    rows = kept.unionByName(probe)
    messages = rows.select("conv_id", "turn", "role", chat_format.text_part(F.col("text")).alias("parts"))
    back = chat_format.read_back(chat_format.format_conversations(messages))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    lost = F.array_join(F.transform("turns", lambda t: t["lost"]), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(lost).cast("long").alias("loss_chars"),
        F.sha2(lost.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def token_rows(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Write `docs` as token files in the shared folder and read their index back."""
    path = f"{run_dir(docs.sparkSession)}/tokens/{uuid.uuid4().hex}"
    token_files.write_files(docs, path, tokenizer, added_tokens=True)
    return token_files.read_files(docs.sparkSession, path, digest=True)


@query("op7_token_files")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rows(table(spark, sf_dir, "documents"))


@query("op4_decontaminate")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_secret_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i, len(w) AS n FROM w),
g AS (
  SELECT doc_id, i, n, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS g FROM s
),
least AS (SELECT g, min(doc_id) AS m FROM g WHERE i + 13 <= n GROUP BY g),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(13)) AS i FROM g JOIN least USING (g) WHERE i + 13 <= n AND m < doc_id),
kept AS (
  SELECT s.doc_id, count(gone.i) AS n_removed, string_agg(word, ' ' ORDER BY s.i) FILTER (gone.i IS NULL) AS kept
  FROM s LEFT JOIN gone ON gone.doc_id = s.doc_id AND gone.i = s.i GROUP BY s.doc_id
)
SELECT w.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


@query("op2_substring_dedup", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH RECURSIVE raw AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS line_no FROM raw),
inked AS (SELECT * FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
first AS (SELECT line, length(line) AS n, min({'d': doc_id, 'l': line_no}) AS id FROM inked GROUP BY line),
half AS (
  SELECT line, n, id, m, m // 2 AS k FROM (SELECT *, unnest([n, n - 1]) AS m FROM first WHERE n >= 20)
),
meet AS (
  SELECT a.line AS x, b.line AS y, a.id AS xid, b.id AS yid FROM half a JOIN half b
    ON a.m = b.m AND left(a.line, a.k) = left(b.line, b.k) WHERE a.line <> b.line
  UNION
  SELECT a.line, b.line, a.id, b.id FROM half a JOIN half b
    ON a.m = b.m AND right(a.line, a.m - a.k) = right(b.line, b.m - b.k) WHERE a.line <> b.line
),
near AS (
  SELECT x, y, xid, yid FROM meet WHERE yid < xid AND CASE
    WHEN length(x) = length(y) THEN len(list_filter(range(1, length(x) + 1), lambda i: substr(x, i, 1) <> substr(y, i, 1))) = 1
    WHEN length(x) = length(y) + 1 THEN list_contains(list_transform(range(1, length(x) + 1), lambda i: substr(x, 1, i - 1) || substr(x, i + 1)), y)
    WHEN length(y) = length(x) + 1 THEN list_contains(list_transform(range(1, length(y) + 1), lambda i: substr(y, 1, i - 1) || substr(y, i + 1)), x)
    ELSE false END
),
mate AS (SELECT xid AS id, min(yid) AS mate FROM near GROUP BY xid),
chain AS (SELECT id, mate FROM mate UNION SELECT chain.id, mate.mate FROM chain JOIN mate ON mate.id = chain.mate),
stays AS (SELECT id, min(mate) AS root FROM chain GROUP BY id),
fate AS (
  SELECT inked.doc_id, inked.line_no, CASE WHEN first.id = {'d': inked.doc_id, 'l': inked.line_no} THEN root ELSE coalesce(root, first.id) END AS kept
  FROM inked JOIN first USING (line) LEFT JOIN stays ON stays.id = first.id
)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, kept.d AS kept_doc_id, CAST(kept.l AS INTEGER) AS kept_line_no FROM fate WHERE kept IS NOT NULL
"""


@query("op5_line_dedup", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.removed_lines(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH said AS (
  SELECT side, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM (SELECT 's' AS side, doc_id, text FROM documents UNION ALL SELECT 't', NULL, text FROM benchmark)
),
crc AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(b)
  )
),
words AS (SELECT word, hex(encode(word)) AS x FROM said GROUP BY word),
bucketed AS (
  SELECT word, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 10000 AS bucket
  FROM words, crc
),
counts AS (SELECT bucket, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t FROM said JOIN bucketed USING (word) GROUP BY bucket),
sums AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM counts),
gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS g FROM counts, sums
),
summed AS (
  SELECT doc_id, count(*) AS n, sum(g)::BIGINT AS total FROM said JOIN bucketed USING (word) JOIN gain USING (bucket) WHERE side = 's' GROUP BY doc_id
),
weighed AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0) AS weight,
    ('0x' || left(sha256('2024:' || d.doc_id), 8))::BIGINT AS h
  FROM documents d LEFT JOIN summed USING (doc_id)
),
scored AS (
  SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score FROM weighed
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS many FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * many // 100 THEN place END AS rank FROM placed
"""


@query("op11_importance_resample", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INTEGER AS rank,
  other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) <= 5
"""


@query("op12_hard_negatives", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


@query("op13_toxic_crf")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxic_crf.score_documents(docs, toxic_crf.fit(docs, table(spark, sf_dir, "labels")))
