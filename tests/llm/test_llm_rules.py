"""Quality rules: measures against plain Python, verdicts whatever the order, awkward tables."""

import random
from collections import Counter

import pytest
from plain import documents, prose, words

from docketry.llm import quality_rules as q


def measured(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {i + k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(8)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = [None, "", " \n\t ", "ñ é", "a " * 50, "x" * 70_000, "same line here\n" * 4 + prose(rng, 40), "A" * 9 + " ### $$$ a|b"]
    loop = prose(rng, 20)
    return [*base, *[prose(rng, n, 9) for n in (7, 8, 9, 30, 200)], prose(rng, 9000), f"{loop} mid {loop}", prose(rng, 60), prose(rng, 60)]


def test_measures_and_base_equal_plain_python(spark, texts):
    out = q.apply_cascade(documents(spark, texts), q.Cascade(q.RULES[2:]), measures=q.MEASURES, base=q.RULES[:2])
    for row in out.collect():
        want = measured(texts[row.doc_id])
        assert tuple(row[m] for m in q.MEASURES) == want, row.doc_id
        assert row.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (row.base_failed and row.kept)


def test_verdict_does_not_depend_on_order(spark, texts):
    docs = documents(spark, texts)
    seen = [{r.doc_id: r.kept for r in q.apply_cascade(docs, q.Cascade(rules)).collect()} for rules in (q.RULES, q.RULES[::-1])]
    assert seen[0] == seen[1] and any(seen[0].values()) and not all(seen[0].values())


def test_cascade_orders_by_rejections_per_second(spark, texts):
    plan = q.plan_cascade(documents(spark, texts))
    gains = [hits / (cost + 1e-9) for _, cost, hits in plan.estimates]
    assert gains == sorted(gains, reverse=True) and len(plan.rules) == len(q.RULES)


def test_later_rules_see_only_what_is_left():
    looked = []
    rules = [q.TOO_SHORT, q.Rule("spy", lambda t: looked.append(len(t.n_words)) or t.n_words < 0)]
    import pyarrow as pa

    block = next(iter(q.W.blocks(pa.array(["short", "long " * 30, None]))))
    assert q.Cascade(rules).rejected(q.Texts(block.data, block.at)).tolist() == [True, False, True] and looked == [1]


def test_rows_keep_their_columns_and_clashes_do_no_harm(spark, texts):
    docs = documents(spark, [*texts, texts[-1]]).withColumnsRenamed({"lang": "kept", "source": "_kept"})
    out = q.keep_good(docs)
    assert out.schema == docs.schema
    assert [r.kept for r in out.collect()] == ["en"] * out.count()
    assert q.keep_good(docs.limit(0)).count() == 0
