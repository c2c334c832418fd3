"""Chat formatting: exact round trips, placeholders, masks, and no Python in the plan."""

from pyspark.sql import functions as F

from docketry.llm import chat_format as c
from docketry.llm.queries import QUERIES

PARTS = f"conv_id long, turn long, role string, parts array<{c.PART}>"
NASTY = ["\\### Assistant: </turn> ok", "</turn>\n<turn:assistant>", "\\l\\b<>\\", "\\", "", None, "é🙂<image:1>", "\n\n", "x" * 100_000]


def text(t):
    return ("text", t, None, None)


def test_texts_come_back_exactly(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", [text(t)]) for i, t in enumerate(NASTY)]
    rows += [(2, 0, "a<b>\\", [text("odd role")]), (3, None, None, None)]
    out = {r.conv_id: r for r in c.read_back(c.format_conversations(spark.createDataFrame(rows, PARTS))).collect()}
    assert [t.text for t in out[1].turns] == [t or "" for t in NASTY]
    assert [t.lost for t in out[1].turns] == [(t or "") if i % 2 == 0 else "" for i, t in enumerate(NASTY)]
    assert [(t.role, t.text) for t in out[2].turns] == [("a<b>\\", "odd role")]
    assert [(t.role, t.text) for t in out[3].turns] == [("", "")]
    assert out[1].formatted.count("</turn>\n") == len(NASTY)


def test_parts_become_placeholders_with_records(spark):
    parts = [text("see <this>"), ("image", None, "img://1", 4.0), text(" and "), ("audio", None, "snd://2", 2.5), ("document", "t", "doc://3", None), ("odd", "kept", None, None), None]
    out = c.format_conversations(spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [text("fine")])], PARTS)).first()
    flat = "see \\lthis\\g<image:2> and <audio:4><document:5>kept"
    assert out.formatted == f"<turn:user>{flat}</turn>\n<turn:assistant>fine</turn>\n"
    head = len("<turn:user>")
    assert [(a.turn, a.number, a.kind, a.ref, a.start, a.tokens) for a in out.attachments] == [
        (0, 2, "image", "img://1", head + flat.index("<image"), 1024),
        (0, 4, "audio", "snd://2", head + flat.index("<audio"), 75),
        (0, 5, "document", "doc://3", head + flat.index("<doc"), 600),
    ]
    assert out.n_tokens == 3 + 1024 + 2 + 75 + 600 + 1 + 0 + 1
    assert [(s["from"], s["to"]) for s in out.loss] == [(0, 0), (16, 20)]


def test_ties_repeats_and_empty_tables(spark):
    rows = [(None, 1, "user", [text("b")]), (None, 1, "user", [text("a")]), (None, 1, "user", [text("a")]), (None, 0, "user", [text("z")])]
    df = spark.createDataFrame(rows, PARTS)
    assert c.format_conversations(df).first().formatted == "".join(f"<turn:user>{t}</turn>\n" for t in "zaab")
    assert c.format_conversations(df.limit(0)).count() == 0


def test_plan_has_no_python(spark):
    plan = QUERIES["op1_chat_format"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_columns_with_the_result_s_names_give_way(spark):
    df = spark.range(2).select(F.lit(1).alias("a.b"), F.col("id").alias("turn no"), F.lit("user").alias("head"), c.text_part(F.lit("hi")).alias("my parts"), F.lit("x").alias("content"), F.lit(5).alias("N_Tokens"), F.lit(0).alias("_parts"))
    flat = c.flatten_parts(df, "my parts")
    assert flat.columns == ["a.b", "turn no", "head", "my parts", "_parts", "content", "n_tokens", "attachments"]
    assert [r.content for r in flat.collect()] == ["hi", "hi"]
    (row,) = c.format_conversations(df, "a.b", "turn no", "head", "my parts").collect()
    assert row["a.b"] == 1 and row["formatted"].count("hi") == 2
