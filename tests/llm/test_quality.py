import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from postmill.llm.quality import Model, Rules, _examples, base_counts, keep, quality, train


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(runs)
    repeated = {i + k for i, r in enumerate(runs) if count[r] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)), "n_repeat_words": len(repeated),
    }


TEXTS = [
    None, "", " \t\n\x0b", "one", "a b c d e", "a b c d e f a b c d e", "x x x x x x x", "l1\nl2\n\nl1\n l1\n\n", "é ü 日本 # & <p> %%", "a b  c", "A b\r\nA b\r\n", "w " * 60_000 + "end",
    " ".join(random.Random(1).choices("abcdefg", k=300)),
]


def test_base_counts_equal_brute_force():
    for texts in (TEXTS, TEXTS[::-1], [t for t in TEXTS for _ in (0, 1)]):
        found = base_counts(pa.array(texts, pa.string()))
        for i, t in enumerate(texts):
            assert {k: v[i] for k, v in found.items()} == brute(t), t


def corpus(n, seed):
    rng = random.Random(seed)
    good = [f"{a}{b}" for a in "abcde" for b in ("in", "on", "at", "er", "ou", "th", "es")]
    rows = []
    for i in range(n):
        words = [rng.choice(good) for _ in range(rng.randint(30, 80))]
        label = int(rng.random() < 0.7)
        if not label:
            words = [w.upper() + "!!" for w in words] if rng.random() < 0.5 else [w + rng.choice(("%%%", "###")) for w in words]
        rows.append((i, " ".join(words), label))
    return rows


def test_held_out_accuracy_and_calibration(spark):
    rows = corpus(1500, 1)
    docs = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "doc_id long, text string, kept int, probability double, bins string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:800]] + [(1, None), (2, 7), (99999, 1)], "doc_id long, quality int")
    model = train(docs.select("doc_id", "text"), labels, rows=600)
    found = {r.doc_id: r for r in quality(docs, model).collect()}
    later = rows[800:]
    assert sum((found[i].probability >= 0.5) == y for i, _, y in later) / len(later) > 0.98
    assert abs(sum(found[i].probability for i, *_ in later) / len(later) - sum(y for *_, y in later) / len(later)) < 0.05
    kept = keep(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in found.items() if r.kept}
    again = train(docs.select("doc_id", "text").repartition(5), labels, rows=600)
    assert again.bias == pytest.approx(model.bias, rel=1e-6)


def test_every_row_has_its_counts(spark):
    docs = spark.createDataFrame([(None if i == 3 else i, t) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4])], "doc_id long, text string")
    rows = quality(docs, Model(bias=60.0)).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        want = brute(TEXTS[3 if r.doc_id is None else r.doc_id])
        assert {k: r[k] for k in want} == want
        failed = want["n_words"] < 10 or 100 * want["n_repeat_words"] > 20 * want["n_words"]
        assert (r.base_failed, r.kept) == (failed, not failed)


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.kept for r in quality(docs, train(docs, labels)).collect()] == [True]
    assert quality(docs.limit(0), train(docs.limit(0), labels)).count() == 0
    assert [r.kept for r in quality(docs, Model(bias=60.0), Rules(min_words=13)).collect()] == [False]


def test_sample_has_one_row_a_label(spark):
    rows = corpus(40, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(7, f"{t} again {k}") for k in range(30) for _, t, _ in rows[:10]], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(7, rows[7][2])] * 50, "doc_id long, quality int")
    assert _examples(docs, labels, 40).num_rows == 40 and _examples(docs, labels, 10).num_rows == 10
    assert sorted(map(str, _examples(docs, labels, 40).to_pylist())) == sorted(map(str, _examples(docs.repartition(7), labels.repartition(3), 40).to_pylist()))
