"""Shared pieces of the tests here: word splitting and tables with awkward rows."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def documents(spark, texts, source="s"):
    """doc_id is the position; a text may also be a (doc_id, text) or (doc_id, text, source)."""
    rows = []
    for i, t in enumerate(texts):
        key, text, src = (i, t, source) if not isinstance(t, tuple) else (*t, *([source] if len(t) == 2 else []))
        rows.append((key, text, "en", src, len(text or "")))
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))
