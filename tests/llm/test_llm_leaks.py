"""Decontamination: pieces, bit-parallel distance and verification against plain dynamic programming."""

import random

from plain import documents, prose

from docketry.llm import decontaminate as d


def distance(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p):
        new = [i + 1]
        for j, x in enumerate(t):
            new.append(min(row[j] + (c != x), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_bit_vectors_equal_dynamic_programming():
    rng = random.Random(2)
    for _ in range(300):
        p = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 90)))
        t = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 40)))
        got, end = d.best_match(d.letter_masks(p), len(p), t, 999)
        assert got == distance(p, t) or (end < 0 and got == 1000)


def least_on_borders(item, text, k):
    """The least distance of `item` to a part of `text` that starts and ends on word borders."""
    best = 99
    for low in range(len(text)):
        if not d.border(text, low):
            continue
        row = list(range(len(item) + 1))
        for end, c in enumerate(text[low : low + len(item) + k], low + 1):
            new = [row[0] + 1]
            for i, x in enumerate(item):
                new.append(min(row[i] + (c != x), row[i + 1] + 1, new[i] + 1))
            row = new
            if d.border(text, end):
                best = min(best, row[-1])
    return best


def test_hierarchical_verification_finds_what_the_whole_item_does():
    rng = random.Random(9)
    found = 0
    for _ in range(80):
        item = "".join(rng.choice("abcde ") for _ in range(60))
        x = list(item)
        for _ in range(rng.randrange(12)):
            i = rng.randrange(len(x))
            x[i : i + rng.choice([0, 1])] = rng.choice(["", "z", "b"])
        text = "".join(rng.choice("abcde ") for _ in range(50)) + "".join(x) + "".join(rng.choice("abcde ") for _ in range(50))
        got, least = d.Matcher([(1, item)], 0.2).search(text), least_on_borders(item, text, 12)
        assert (1 in got) == (least <= 12)
        assert not got or got[1][0] == least
        found += bool(got)
    assert 20 < found < 80


def test_one_rule_for_items_of_every_length(spark):
    long, short = "thirty-three characters are here!"[:-1] + "x", "thirty-one characters are here"
    text = [f"q{i}q" for i in (long, short)] + [f"q {i} q" for i in (long, short)]
    for n, item in enumerate((long, short)):
        m = d.Matcher([(1, item)], 0.1)
        assert m.search(text[n])[1][0] == 2 and m.search(text[2 + n])[1][0] == 0


def test_leaks_are_found_and_clean_documents_left(spark):
    rng = random.Random(4)
    items = [prose(rng, 30, 9000) for _ in range(12)]
    near = items[1].replace("w1", "W1").replace(" ", "\n ")
    worn = items[2][:60] + "zz" + items[2][63:]
    given = [prose(rng, 80, 9000), items[0], prose(rng, 50) + " " + near + " x", prose(rng, 9) + worn, items[3][: len(items[3]) // 2], None, "", items[0] + " " + items[4], prose(rng, 20000, 9000) + items[5]]
    docs = documents(spark, given).withColumnRenamed("lang", "item_id")
    bench = spark.createDataFrame([*enumerate(items), (50, None), (51, ""), (52, "short"), (None, items[6]), (0, items[0])], "item_id long, text string")
    for block in (1 << 20, 300):  # one pass, and several
        got = {(r.doc_id, r.item_id) for r in d.contaminated(docs, bench, block_chars=block).collect()}
        assert got == {(1, 0), (2, 1), (3, 2), (7, 0), (7, 4), (8, 5)}
        kept = d.drop_contaminated(docs, bench, block_chars=block)
        assert kept.schema == docs.schema and sorted(r.doc_id for r in kept.collect()) == [0, 4, 5, 6]
    assert d.contaminated(docs.limit(0), bench).count() == 0 and d.contaminated(docs, bench.limit(0)).count() == 0
    assert d.drop_contaminated(docs, bench.limit(0)).count() == len(given)


def test_short_items_equal_all_occurrences_on_word_borders():
    rng = random.Random(6)
    found = 0
    for _ in range(400):
        item = d.normal("".join(rng.choice("abc ") for _ in range(rng.randrange(1, 32)))) or "a"
        text = d.normal("".join(rng.choice("abc ") for _ in range(rng.randrange(12))) + item[: len(item) // 2] + rng.choice(["", "b", " "]) + item[len(item) // 2 :] + rng.choice(["", "c", " a"]))
        cuts = [i for i in range(len(text) + 1) if not text[max(0, i - 1) : i + 1].isalnum() or i in (0, len(text))]
        k = int(0.1 * len(item))
        want = [max(whole(item, text[i:j]), 0) for i in cuts for j in cuts if i < j and abs(j - i - len(item)) <= k]
        got = d.Matcher([(1, item)], 0.1).search(text)
        assert (min(want, default=99) <= k) == (1 in got), (item, text)
        assert not got or got[1][0] == min(want)
        found += bool(got)
    assert 50 < found < 350


def whole(p, t):
    row = list(range(len(p) + 1))
    for j, c in enumerate(t, 1):
        new = [j]
        for i, x in enumerate(p):
            new.append(min(row[i] + (c != x), row[i + 1] + 1, new[i] + 1))
        row = new
    return row[-1]


def test_short_items_and_items_without_an_id_are_searched(spark):
    given = ["He said: What is 2 + 2? Four.", "问:中国的首都是哪里?答", "it was raining in training", "a Rain came", "what is 2 + 20?", "an unnamed question of more than thirty-two characters, asked", None, ""]
    bench = spark.createDataFrame([(1, "what is 2 + 2?"), (2, "中国的首都是哪里"), (3, "rain"), (4, " "), (None, "unnamed question of more than thirty-two characters")], "item_id long, text string")
    docs = documents(spark, given)
    got = {(r.doc_id, r.item_id, r.distance) for r in d.contaminated(docs, bench).collect()}
    assert got == {(0, 1, 0), (1, 2, 0), (3, 3, 0), (4, 1, 1), (5, None, 0)}
    assert sorted(r.doc_id for r in d.drop_contaminated(docs, bench).collect()) == [2, 6, 7]
    named = bench.selectExpr("concat('q', item_id) AS item_id", "text")
    assert sorted(r.doc_id for r in d.drop_contaminated(docs, named).collect()) == [2, 6, 7]
