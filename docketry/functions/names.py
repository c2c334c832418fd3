"""Name functions: matching form, slug, trigrams.

Everything is a built-in expression, so names are normalized where they are read: no Python
worker, no shuffle to make them distinct first, no join to bring the result back.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry import fixed


# '(space) D/B/A' or '(space) DBA' and the rest of the line, with Unix line ends only.
_GAP = r"[\s\x1c-\x1f]"
_TRADE_NAME = rf"(?d){_GAP}(?:D{_GAP}*/{_GAP}*B{_GAP}*/{_GAP}*A|DBA)\b.*$"


@cache
def _folds() -> tuple[str, str, dict[str, str]]:
    """Compatibility decomposition cut down to ASCII, from the Unicode tables of Python.

    Decomposition works character by character and combining marks are not ASCII, so a
    table over single characters is exact. Returns the one-to-one part as the two argument
    strings of `translate`, and the one-to-several part as a dict.
    """
    single, several = {}, {}
    for point in range(0x80, 0x110000):
        ch = chr(point)
        if not unicodedata.decomposition(ch):
            continue
        kept = "".join(x for x in unicodedata.normalize("NFKD", ch) if x < "\x80")
        if len(kept) == 1:
            single[ch] = kept
        elif kept:
            several[ch] = kept
    return "".join(single), "".join(single.values()), several


def fold_ascii(c: Column) -> Column:
    """Accents folded to ASCII, everything else outside ASCII deleted."""
    source, target, several = _folds()
    # Two constant arrays make the table; Catalyst folds them into one literal.
    table = F.map_from_arrays(
        F.split(F.lit("\t".join(several)), "\t"), F.split(F.lit("\t".join(several.values())), "\t")
    )
    beyond = r"[^\x00-\x7F]"
    once = F.translate(c, source, target)
    # What is still not ASCII is rare: each distinct such character is looked up once.
    rest = F.array_distinct(F.split(F.regexp_replace(once, r"[\x00-\x7F]+", ""), ""))
    folded = F.aggregate(
        rest,
        once,
        lambda text, ch: F.when(ch == "", text).otherwise(
            F.replace(text, ch, F.coalesce(F.try_element_at(table, ch), F.lit("")))
        ),
    )
    return F.when(c.rlike(beyond), folded).otherwise(c)


def normalize_name(c: Column) -> Column:
    """Matching form of a name; NULL and unusable names give ''.

    One chain, each step used once: a step used twice would copy the whole expression.
    """
    s = F.upper(fold_ascii(c))
    # Only the legal name before a trade-name marker counts.
    s = F.regexp_replace(s, _TRADE_NAME, "")
    s = F.regexp_replace(s, "[.'`]", "")
    s = F.trim(F.regexp_replace(s, "[^A-Z0-9]+", " "))
    # A name made of nothing but connectors keeps one: it is masked while they are dropped.
    s = F.regexp_replace(s, "^AND(?: AND)*$", "&")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, r"(?<![^ ])AND(?![^ ])", ""), " +", " "))
    s = F.replace(s, F.lit("&"), F.lit("AND"))
    s = F.regexp_replace(s, "(?: (?:" + "|".join(fixed.LEGAL_FORMS) + "))+$", "")
    return F.coalesce(F.regexp_replace(s, "^THE (?=.)", ""), F.lit(""))


def slugify(c: Column) -> Column:
    s = F.lower(fold_ascii(c))
    s = F.replace(s, F.lit("&"), F.lit(" and "))
    s = F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    s = F.regexp_replace(F.substring(s, 1, 80), "-+$", "")
    return F.coalesce(F.regexp_replace(s, "^$", "employer"), F.lit("employer"))


def trigrams(norm: Column) -> Column:
    """Distinct trigrams of a normalized string, each word padded with two spaces before and
    one after. Windows that end in two spaces straddle two words and are left out."""
    padded = F.concat(F.lit("  "), F.regexp_replace(norm, " +", "   "), F.lit(" "))

    def windows(p: Column) -> Column:
        places = F.sequence(F.lit(1), F.length(p) - 2)
        grams = F.transform(places, lambda i: F.substr(p, i, F.lit(3)))
        return F.array_distinct(F.filter(grams, lambda g: ~g.endswith("  ")))

    # Through a one-element array the padded text is a bound value; inside the inner lambda
    # it would otherwise be built again for every window.
    each = F.get(F.transform(F.array(padded), windows), F.lit(0))
    return F.when(F.length(norm) > 0, each).otherwise(F.array().cast("array<string>"))


def trigram_similarity(left: Column, right: Column) -> Column:
    """Shared over all trigrams, of two trigram arrays."""
    shared = F.size(F.array_intersect(left, right))
    total = F.size(left) + F.size(right) - shared
    return F.coalesce(F.try_divide(shared.cast("double"), total.cast("double")), F.lit(0.0))


def pieces(c: Column, n: int) -> Column:
    """Distinct substrings of length `n` of a string, for containment probes."""
    grams = F.transform(
        F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substr(c, i, F.lit(n))
    )
    return F.when(F.length(c) >= n, F.array_distinct(grams)).otherwise(
        F.array().cast("array<string>")
    )


def distinct_names(df: DataFrame, name: str) -> DataFrame:
    """The table of spellings (raw, norm). Not needed to normalize; kept as an output."""
    return (
        df.select(F.col(name).alias("raw"))
        .where(F.col("raw").isNotNull())
        .distinct()
        .withColumn("norm", normalize_name(F.col("raw")))
    )
