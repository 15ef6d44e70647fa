"""Resampling against plain sums over zlib's CRC of every feature."""

import math
import random
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from postmill.llm.resampling import Prefixes, features, moved, resample, words_of

SCHEMA = "doc_id long, text string"


def plain_words(text):
    return "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in "".join(c.lower() if c.isascii() else c for c in text or "")).split(" ")


def grams(text, size):
    words = [w for w in plain_words(text) if w]
    return words, [" ".join(words[i : i + n]).encode() for n in range(1, size + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, size, buckets, least, percent):
    own = [(i, *grams(t, size)) for i, t in docs]
    s, t = [0] * buckets, [0] * buckets
    for _, _, found in own:
        for g in found:
            s[crc32(g) % buckets] += 1
    for text in target:
        for g in grams(text, size)[1]:
            t[crc32(g) % buckets] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for i, words, found in own:
        weight = math.floor(sum(gain[crc32(g) % buckets] for g in found) / len(found)) if found else 0
        h = int(sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    order = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    for place, r in enumerate(order[: len(order) * percent // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def corpus(n=300):
    dice = random.Random(3)
    words = ["Alpha", "beta-gamma", "naïve", "日本", "x1", "42", "the", "THE", "ÀB", "a_b", " ", "é"]
    docs = [(i, " ".join(dice.choice(words) for _ in range(dice.choice((0, 1, 19, 20, 21, 60))))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "... \n!"), (None, "word " * 30), (3, docs[3][1]), (3, docs[3][1]), (5, "the " * 25), (n + 3, "longest " * 40_000), (n + 4, "q" * 300_000), (-8, "the " * 25)]
    return docs, ["the the beta", None, "", "naïve 日本 alpha", "alpha beta gamma the"]


def test_prefixes_give_the_crc_of_every_run():
    words = words_of("Ab c-d naïve " + "z" * 70_000 + " 9 " + "y" * 255 + " last")
    found = Prefixes(words)
    for n in range(1, len(words) + 2):
        assert found.runs(n).tolist() == [crc32(b" ".join(words[i : i + n])) for i in range(len(words) - n + 1)]
    assert Prefixes([]).runs(1).tolist() == []
    for size in (0, 1, 2, 255, 256, 65_537):  # zlib's CRC of zero bytes, without its inversions
        want = crc32(b"\0" * size, 0xFFFFFFFF ^ 0x12345678) ^ 0xFFFFFFFF
        assert moved(np.array([0x12345678], np.uint32), np.array([size])).tolist() == [want]


def test_features_do_not_cross_texts():
    texts = ["a b c", "", None, "d", "e f"]
    values, counts, words = features(texts, 3, 1 << 20)
    assert counts.tolist() == [6, 0, 0, 1, 3] and words.tolist() == [3, 0, 0, 1, 2]
    want = [sorted(crc32(g) % (1 << 20) for g in grams(t, 3)[1]) for t in texts]
    ends = np.cumsum(counts)
    assert [sorted(values[b - a : b].tolist()) for a, b in zip(counts, ends)] == want


@pytest.mark.parametrize("size, buckets, percent", [(1, 10_000, 10), (3, 70_000, 35), (2, 7, 100)])
def test_equals_brute_force(spark, size, buckets, percent):
    docs, target = corpus()
    frame = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], SCHEMA + ", buckets string, n_words int, TEXT int").repartition(7)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = sorted((tuple(r) for r in resample(frame, goal, size, buckets, 20, percent).collect()), key=repr)
    assert got == brute(docs, target, size, buckets, 20, percent)


def test_ties_and_repeats_over_many_tasks(spark):
    docs = [(i % 40, "one two three " * 10) for i in range(4000)]
    rows = resample(spark.createDataFrame(docs, SCHEMA).repartition(16), spark.createDataFrame([("one",)], "text string"), percent=50).collect()
    drawn = sorted((r.rank, r) for r in rows if r.rank)
    assert [rank for rank, _ in drawn] == list(range(1, 2001))
    assert [r.score for _, r in drawn] == sorted((r.score for r in rows), reverse=True)[:2000]
    assert all((a.doc_id, a.score) == (b.doc_id, b.score) or (-a.score, a.doc_id) < (-b.score, b.doc_id) for (_, a), (_, b) in zip(drawn, drawn[1:]))


def test_empty_tables(spark):
    none, target = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "text string")
    assert resample(none, target).count() == 0
    docs = [(1, "word " * 20), (2, None)]
    got = sorted((tuple(r) for r in resample(spark.createDataFrame(docs, SCHEMA), target).collect()), key=repr)
    assert got == brute(docs, [], 1, 10_000, 20, 10)
    with pytest.raises(ValueError):
        resample(none, target, buckets=0)
