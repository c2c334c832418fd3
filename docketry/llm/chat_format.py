"""Chat formatting with typed content parts, in DataFrame functions only.

A message's content is an array of parts (kind, text, ref, amount). A visitor flattens them in
order: text is escaped and kept, an image, audio clip or document becomes a placeholder
`<kind:number>`, numbered within the message, and its attachment record says what it
stands for (ref), where (code points from the start of the turn) and how many model tokens it
expands to. The visitor is a table of rules, one per kind, and each rule is a Column expression.

A turn is `<turn:role>content</turn>` and a line feed. Backslash, `<` and `>` inside roles and
texts are written `\\b`, `\\l` and `\\g`, so no text can contain a marker, and reading back is
exact. The loss mask has one span per turn, in code points from the start of that turn: the
content of assistant turns, empty for all others.

Null texts, roles and parts are empty; a part of unknown kind counts as its text. Turns are
ordered by turn, then role and content, nulls first, so ties and repeated rows are defined.
Extra columns are not read. A conversation is one output row and so one task's work; nothing
in it grows faster than its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.frames import col

END = "</turn>\n"
LOSS_ROLE = "assistant"
PART = "struct<kind:string,text:string,ref:string,amount:double>"

#: Model tokens of one unit of each attachment: image tiles, audio seconds, document pages.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 600}
CHARS_PER_TOKEN = 4  # for text, an estimate


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<"))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def text_part(text: Column) -> Column:
    """Content of one text part."""
    nothing = F.lit(None).cast("string")
    part = F.struct(F.lit("text").alias("kind"), text.alias("text"), nothing.alias("ref"), F.lit(None).cast("double").alias("amount"))
    return F.array(part)


def _kind(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("text"))


def _visit(part: Column, number: Column) -> Column:
    """What one part becomes: its piece of the flat text, tokens, and whether it is an attachment."""
    kind = _kind(part)
    attached = kind.isin(*TOKENS_PER_UNIT)
    mark = F.concat(F.lit("<"), kind, F.lit(":"), number.cast("string"), F.lit(">"))
    units = F.ceil(F.greatest(F.coalesce(part["amount"], F.lit(1.0)), F.lit(0.0)))
    tokens = F.ceil(F.length(F.coalesce(part["text"], F.lit(""))) / CHARS_PER_TOKEN)
    for name, each in TOKENS_PER_UNIT.items():
        tokens = F.when(kind == name, units * each).otherwise(tokens)
    return F.struct(
        F.when(attached, mark).otherwise(escape(part["text"])).alias("piece"),
        tokens.cast("long").alias("tokens"),
        attached.alias("attached"),
        kind.alias("kind"),
        part["ref"].alias("ref"),
        number.cast("int").alias("number"),
    )


def flatten_parts(messages: DataFrame, parts: str = "parts") -> DataFrame:
    """`messages` with content (flat, escaped), n_tokens and attachments
    (number, kind, ref, start, tokens; start in code points of the content). Columns that have one
    of these names already give way; all others pass through."""
    held = F.transform(F.coalesce(col(parts), F.array().cast(f"array<{PART}>")), lambda p: F.coalesce(p, F.lit(None).cast(PART)))
    other = [c for c in messages.columns if c.lower() not in ("content", "n_tokens", "attachments")]
    given = messages.select(F.struct(*[col(c) for c in other]).alias("row"), held.alias("_parts"))
    seen = given.withColumn("_visited", F.transform("_parts", lambda p, i: _visit(p, i + 1)))
    # Starts come from one running pass; content itself is joined once.
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<number:int,kind:string,ref:string,start:int,tokens:bigint>>").alias("found"))

    def step(acc: Column, v: Column) -> Column:
        record = F.struct(v["number"].alias("number"), v["kind"].alias("kind"), v["ref"].alias("ref"), acc["at"].alias("start"), v["tokens"].alias("tokens"))
        found = F.when(v["attached"], F.concat(acc["found"], F.array(record))).otherwise(acc["found"])
        return F.struct((acc["at"] + F.length(v["piece"])).alias("at"), found.alias("found"))

    return seen.select(
        "row.*",
        F.array_join(F.transform("_visited", lambda v: v["piece"]), "").alias("content"),
        F.aggregate("_visited", F.lit(0).cast("long"), lambda a, v: a + v["tokens"]).alias("n_tokens"),
        F.aggregate("_visited", zero, step, lambda a: a["found"]).alias("attachments"),
    )


def format_conversations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """Per conversation: its id, formatted, loss (array of (from, to), one per turn), n_tokens,
    attachments (turn number from 0, then as in `flatten_parts`, start counted in the turn)."""
    plain = messages.select(col(conv).alias("conv"), col(turn).alias("turn"), col(role).alias("role"), col(parts).alias("parts"))
    flat = flatten_parts(plain)
    head = F.concat(F.lit("<turn:"), escape(F.col("role")), F.lit(">"))
    begin, size = F.length("head"), F.length("content")
    loss = F.struct(
        F.when(F.col("role") == LOSS_ROLE, begin).otherwise(0).alias("from"),
        F.when(F.col("role") == LOSS_ROLE, begin + size).otherwise(0).alias("to"),
    )
    moved = F.transform("attachments", lambda a: a.withField("start", a["start"] + F.length("head")))
    row = flat.withColumn("head", head).select(
        "conv",
        F.struct("turn", "role", "content", F.concat("head", "content", F.lit(END)).alias("seg"), loss.alias("loss"), "n_tokens", moved.alias("attachments")).alias("t"),
    )
    grouped = row.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    every = F.transform("ts", lambda t, i: F.transform(t["attachments"], lambda a: F.struct(i.alias("turn"), a["number"].alias("number"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["start"].alias("start"), a["tokens"].alias("tokens"))))
    return grouped.select(
        F.col("conv").alias(conv),
        F.array_join(F.transform("ts", lambda t: t["seg"]), "").alias("formatted"),
        F.transform("ts", lambda t: t["loss"]).alias("loss"),
        F.aggregate("ts", F.lit(0).cast("long"), lambda a, t: a + t["n_tokens"]).alias("n_tokens"),
        F.flatten(every).alias("attachments"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """`formatted` with turns (role, text, lost): parsed from the text, `lost` what the mask covers.

    Placeholders stay as they are: `<kind:number>` is no escaped text.
    """
    segments = F.split(F.col("formatted"), END, -1)
    paired = F.arrays_zip(F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(0))).alias("seg"), F.col("loss").alias("loss"))

    def parse(p: Column) -> Column:
        seg, span = p["seg"], p["loss"]
        role = F.regexp_extract(seg, "^<turn:([^>]*)>", 1)
        return F.struct(
            unescape(role).alias("role"),
            unescape(F.substring(seg, F.length(role) + 8, F.length(seg))).alias("text"),
            unescape(F.substring(seg, span["from"] + 1, span["to"] - span["from"])).alias("lost"),
        )

    return formatted.withColumn("turns", F.transform(paired, parse))
