import unicodedata

from helpers import evaluate
from pyspark.sql import functions as F

from docketry.functions import names

VECTORS = {
    "Google, L.L.C.": "GOOGLE",
    "The Goldman Sachs Group, Inc.": "GOLDMAN SACHS GROUP",
    "JPMorgan Chase & Co.": "JPMORGAN CHASE",
    "AT&T Services, Inc.": "AT T SERVICES",
    "AT and T Services": "AT T SERVICES",
    "Ernst & Young U.S. LLP": "ERNST YOUNG US",
    "Samsung Electronics Co., Ltd.": "SAMSUNG ELECTRONICS",
    "Fidelity Technology Group, LLC d/b/a Fidelity Investments": "FIDELITY TECHNOLOGY GROUP",
    "Macy's, Inc.": "MACYS",
    "Nestlé USA Inc": "NESTLE USA",
    "O’Reilly Media": "OREILLY MEDIA",
    "Bank of the West": "BANK OF THE WEST",
    "THE": "THE",
    "The The Company": "THE",
    "THE INC": "THE",
    "and": "AND",
    "AND INC": "INC",
    "The And": "THE",
    "Procter + Gamble": "PROCTER GAMBLE",
    "  Tata   Consultancy\tServices ": "TATA CONSULTANCY SERVICES",
    "Foo DBA Bar": "FOO",
    "Foo Dbase Bar": "FOO DBASE BAR",
    "ACME, INC., CO. LTD": "ACME",
    "abc-def_ghi": "ABC DEF GHI",
    "": "",
    "!!!": "",
}


def test_normalize_vectors(spark):
    assert evaluate(spark, names.normalize_name, [*VECTORS, None]) == [*VECTORS.values(), ""]


def test_fold_equals_the_unicode_tables(spark):
    """Every character with a decomposition, and some without, folds as NFKD then ASCII."""
    points = [p for p in range(0x80, 0x30000) if unicodedata.decomposition(chr(p))]
    points += [0xDF, 0xF8, 0x201C, 0x2019, 0x1F600]
    chars = [f"a{chr(p)}b" for p in points if not 0xD800 <= p < 0xE000]
    chars.append("ﬁn ½ é ™ ① " * 3)
    want = [unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode() for c in chars]
    assert evaluate(spark, names.fold_ascii, chars) == want


def test_slugify(spark):
    got = evaluate(spark, names.slugify, ["Ernst & Young U.S. LLP", "!!!", "", "Société Générale", "x" * 79 + " y"])
    assert got == ["ernst-and-young-u-s-llp", "employer", "employer", "societe-generale", "x" * 79]


def test_trigrams_and_similarity(spark):
    grams = evaluate(spark, lambda c: F.sort_array(names.trigrams(c)), ["CAT", "A B", ""])
    assert grams == [["  C", " CA", "AT ", "CAT"], ["  A", "  B", " A ", " B "], []]
    # The value printed in the manual of the trigram extension.
    sim = evaluate(spark, lambda c: names.trigram_similarity(names.trigrams(c), names.trigrams(F.lit("TWO WORDS"))), ["WORD"])
    assert round(sim[0], 6) == 0.363636


def test_pieces(spark):
    assert evaluate(spark, lambda c: names.pieces(c, 3), ["ABCD", "AB"]) == [["ABC", "BCD"], []]


def test_distinct_names(spark):
    df = spark.createDataFrame([("Acme Inc",), ("Acme Inc",), (None,)], "n string")
    assert [tuple(r) for r in names.distinct_names(df, "n").collect()] == [("Acme Inc", "ACME")]


def test_a_slug_is_made_once_for_all_choices(spark, monkeypatch):
    from docketry.operators import linkage, resolve

    seen = []

    def assign(df, rank, choices, stem, *rest, **named):
        plan = df.select(rank, *[c.alias(f"c{i}") for i, c in enumerate(choices)], stem.alias("s"))
        seen.append(plan._jdf.queryExecution().optimizedPlan().toString().count("[^a-z0-9]+"))
        return df.withColumn(named.get("out", "slug"), F.lit("x"))

    monkeypatch.setattr(resolve, "assign_slugs", assign)
    monkeypatch.setattr(linkage, "assign_slugs", assign)
    ours = spark.range(2).selectExpr("id AS employer_id", "'k' AS employer_key", "concat('n', id) AS display_name", "'12-3456789' AS fein", "'c' AS city", "'s' AS state", "id AS lca_rows")
    theirs = spark.range(2).selectExpr("id AS new_id", "concat('n', id) AS name", "'N' AS norm", "'s' AS state")
    resolve.with_slugs(ours)
    linkage.registry_slugs(theirs, ours.selectExpr("'x' AS slug"))
    assert seen == [1, 1]
