import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from postmill.llm.kneser_ney import _discounts, scores

DOCS = [(i, t) for i, t in enumerate(["a b a b c", "A B c", "", None, "x", "a a a b", " \t\n", "the cat sat on the mat", "the cat ran", "a b a b c"] * 6 + ["the dog sat on a cat " * 40, "wörd ünknown Ünknown"])]


def tokens(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + [None]


def brute(rows):
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    train = [tokens(t) for i, t in rows if not held[i]]
    uni = Counter(w for t in train for w in t)
    pairs = Counter(p for t in train for p in zip(["<s>", *t], t))
    n, v = sum(uni.values()), len(uni)
    total, follow, before = Counter(), defaultdict(Counter), Counter()
    for (a, b), c in pairs.items():
        total[a] += c
        follow[a][min(c, 3)] += 1
        before[b] += 1
    d = (0, *_discounts([sum(c == k for c in pairs.values()) for k in range(1, 5)]))
    e = (0, *_discounts([sum(c == k for c in before.values()) for k in range(1, 5)]))
    many = sum(before.values())
    rest = sum(e[min(c, 3)] for c in before.values()) / many

    def low(w):
        return max(before[w] - e[min(before[w], 3)], 0) / many + rest / (v + 1)

    def p(a, b):
        if not total[a]:
            return low(b)
        return max(pairs[a, b] - d[min(pairs[a, b], 3)], 0) / total[a] + sum(d[k] * m for k, m in follow[a].items()) / total[a] * low(b)

    for a in ("<s>", "a", "the", "zzz"):
        assert sum(p(a, w) for w in [*uni, "unknown"]) == pytest.approx(1)
    return {i: (held[i], len(t), sum(w in uni for w in t), n, sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in t), sum(math.log10(p(a, b)) for a, b in zip(["<s>", *t], t))) for i, t in ((i, tokens(t)) for i, t in rows)}


@pytest.mark.parametrize("copies", [1, 2])
def test_equals_brute_force(spark, copies):
    want = brute(DOCS * copies)
    docs = spark.createDataFrame([(*r, "x", 1) for r in DOCS * copies], "doc_id long, text string, score string, held_out int")
    rows = scores(docs).collect()
    assert len(rows) == len(DOCS) * copies
    for r in rows:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert (r.base_score, r.score) == pytest.approx(want[r.doc_id][4:], abs=1e-9)


def test_learns_order(spark):
    docs = spark.createDataFrame([(i, "one two three four " * 5) for i in range(30)] + [(100, "four three two one " * 5)], "doc_id long, text string")
    found = {r.doc_id: r for r in scores(docs).collect()}
    assert found[3].score > found[100].score and found[3].score > found[3].base_score


def test_empty_table_and_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert scores(empty).count() == 0
    only_held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = scores(spark.createDataFrame([(only_held, "a b")], "doc_id long, text string")).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.score) == (True, 3, 0, 0.0)
    null = scores(spark.createDataFrame([(None, "a b"), (only_held, None)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.held_out for r in null} == {None: False, only_held: True}
