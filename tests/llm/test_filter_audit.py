"""The filter audit against a plain count over every order."""

import random
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from postmill.llm.filter_audit import COUNTS, audit, cells, interactions

SPACE = " \t\n\r\x0b\x0c"
LABELS = "doc_id long, quality int, toxic int"


def split(text):
    for c in SPACE[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute(docs, labels):
    """{(part, order, step): counts} of documents (doc_id, text, lang)."""
    rows, first = [], {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    good, toxic = ({i for i, *say in labels if i is not None and say[k] == 1} for k in (0, 1))
    for i, text, lang in docs:
        text = text or ""
        words = split(text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": i is not None and i > first[text],
        }
        rows.append((lang or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    out, shapley = defaultdict(Counter), Counter()
    for order in map("".join, permutations("ABCDE")):
        for part, failed, is_good, is_toxic in rows:
            alive = True
            for step, f in enumerate(order, 1):
                own = out[part, order, step]
                own["unique_fails"] += failed == {f}
                if f in failed:
                    own["removed" if alive else "redundant"] += 1
                    own["good_lost"] += alive and is_good
                    own["toxic_lost"] += alive and is_toxic
                    shapley[part, f] += alive
                    alive = False
                own["kept"] += alive
    return {k: (*(int(c[n]) for n in COUNTS), shapley[k[0], k[1][k[2] - 1]]) for k, c in out.items()}


def found(rows):
    got = {(r.part, r.filter_order, r.step): (*(r[c] for c in COUNTS), r.shapley) for r in rows}
    assert len(got) == len(rows)
    return got


def corpus():
    dice = random.Random(7)
    words = ["alpha", "Beta", "GAMMA", "délta", "x|y", "100%", "e", "日本", "Zeta"]
    texts = [" ".join(dice.choice(words[: dice.randint(1, 9)]) + str(dice.randint(0, dice.choice((1, 400)))) for _ in range(dice.choice((0, 5, 199, 200, 201, 400)))) for _ in range(25)]
    texts += ["", None, " \n\t ", "ABC", "w " * 200, "plain words here", "a\x0bb c " * 120, "long " * 60_000]
    docs = [(i, dice.choice(texts), dice.choice(["en", "de", "", None])) for i in range(120)]
    docs += [(None, texts[3], "en"), (None, "", "en"), (5, "other text", "en"), (5, "other text", "en"), (7, docs[9][1], "de"), (-3, docs[4][1], "fr"), (10**12, "ABC", "en")]
    labels = [(i, dice.choice([0, 1, None]), dice.choice([0, 1, None])) for i in range(0, 140, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (6, 7, 7)]
    return docs, labels


def test_audit_equals_brute_force(spark):
    docs, labels = corpus()
    frame = spark.createDataFrame([(*d, "clash", 1, True) for d in docs], "doc_id long, text string, lang string, part string, mask int, good boolean").repartition(5)
    got = found(audit(frame, spark.createDataFrame(labels, LABELS)).collect())
    assert got == brute(docs, labels)
    assert len(got) == 600 * len({d[2] or "" for d in docs})


def test_names_that_differ_in_case_and_no_labels(spark):
    docs, _ = corpus()
    frame = spark.createDataFrame([(*d, "x", 5) for d in docs], "doc_id long, text string, lang string, TEXT string, Doc_ID int")
    assert found(audit(frame, spark.createDataFrame([], LABELS)).collect()) == brute(docs, [])


def test_empty(spark):
    assert audit(spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], LABELS)).count() == 0


def test_copies_are_few_rows_before_the_least_is_sought(spark):
    docs = spark.createDataFrame([(i, "the same text", "en") for i in range(5000)] + [(i, f"text {i}", "de") for i in range(5000, 5100)], "doc_id long, text string, lang string")
    table = {(r.part, r.mask): r.n for r in cells(docs, spark.createDataFrame([(0, 1, 1)], LABELS), {}, repeats=4).collect()}
    assert table == {("en", 0): 1, ("en", 16): 4999, ("de", 0): 100}


def test_other_numbers_of_filters(spark):
    table = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 3, 2, 1, 1), ("p", 1, 4, 0, 0)], "part string, mask int, n long, good long, toxic long")
    rows = {(r.filter_order, r.step): r for r in interactions(table, "XY").collect()}
    assert set(rows) == {("XY", 1), ("XY", 2), ("YX", 1), ("YX", 2)}
    assert [rows["XY", 1][c] for c in COUNTS] == [5, 6, 0, 4, 1, 1] and [rows["XY", 2][c] for c in COUNTS] == [5, 0, 2, 0, 0, 0]
    assert [rows["YX", 1][c] for c in COUNTS] == [9, 2, 0, 0, 1, 1] and rows["YX", 2].removed == 4
    assert rows["XY", 1].shapley == 10 and rows["YX", 1].shapley == 2
    with pytest.raises(ValueError):
        interactions(table, "ABCDEFG")
