import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from postmill.llm.components import components
from postmill.llm.simhash import _forest, balls, links, near_duplicates, one_of_each, text_fingerprint


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(fps, distance):
    """The least key reachable, for each key of {key: fingerprint}."""
    keys = sorted(fps)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def near_texts(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(6)]
    out = []
    for _ in range(n):
        own = rng.choice(base).split()
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
            own[rng.randrange(len(own))] = rng.choice(words)
        out.append(" ".join(own))
    return out


TEXTS = [None, "", " \t\n", "a", "A", "a b", "a b c", "A  B\nC", "x " * 70_000, "Äpfel ÄPFEL a b", *near_texts(1)]


@pytest.mark.parametrize("text", TEXTS[:8] + TEXTS[9:14])
def test_fingerprint(text):
    assert text_fingerprint(text) == brute_fingerprint(text)


def test_fingerprint_is_spark_hash(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % 2**64 == text_fingerprint("a b c")


def test_query_equals_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "k", 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, fp string, component_id int")
    rows = near_duplicates(docs).collect()
    fps = {i: brute_fingerprint(t) for i, t in enumerate(TEXTS)}
    want = brute_roots(fps, 3)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {(i, f"{fps[i]:016x}", want[i]) for i in fps} and len(rows) == len(TEXTS)
    assert len(set(want.values())) < len(want) - 20
    kept = one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 4])
def test_links_connect_all_pairs(spark, distance):
    rng = random.Random(distance)
    fps = {rng.getrandbits(64) for _ in range(20)}
    for f in list(fps):
        for _ in range(6):
            for _ in range(rng.randint(1, 5)):
                f ^= 1 << (rng.randrange(64) if rng.random() < 0.6 else rng.randrange(16, 32))
            fps.add(f)
    signed = {f - (1 << 64) if f >> 63 else f: f for f in fps}
    rows = links(spark.createDataFrame([(s,) for s in signed], "fp long"), distance).collect()
    found = brute_roots({k: k for k in signed}, -1)
    root = {k: k for k in found}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for r in rows:
        x, y = find(r.a), find(r.b)
        root[max(x, y)] = min(x, y)
    assert {k: find(k) for k in signed} == brute_roots(signed, distance)
    assert len(rows) < 40 * len(fps)


def test_many_at_one_value():
    """A meeting point of more than DIRECT fingerprints, linked by look-up, agrees with comparing all."""
    rng = np.random.default_rng(5)
    part, key = 1, np.uint64(0x1234567800009ABC)
    near = np.array([int(key) ^ int(v) << 16 ^ (1 << int(j) if j >= 0 else 0) for v, j in zip(rng.integers(0, 1 << 16, 700), rng.choice([-1, 0, 5, 40, 63], 700))], np.uint64)
    a, b = _forest(near, key, part, 3)
    fps = np.unique(near).tolist()
    root = {f: f for f in fps}
    for x, y in zip(a.tolist(), b.tolist()):
        root[y] = x
    want = brute_roots({f: f for f in fps}, 3)
    outside = ~(0xFFFF << 16)
    # Other pairs meet elsewhere; these have to be linked here.
    for i, x in enumerate(fps):
        for y in fps[:i]:
            inside = (x ^ y) >> 16 & 0xFFFF
            if (x ^ y).bit_count() <= 3 and (inside.bit_count() <= 1 or inside.bit_count() == 3 and x & outside == y & outside == int(key) & outside):
                assert root[x] == root[y]
    assert all(want[x] == want[y] for x, y in zip(a.tolist(), b.tolist()))


def test_balls():
    assert len(balls(3)) == 4 * 49 and len(balls(2)) == 65 and len(balls(4)) == 1 + 64 + 2016


def test_null_ids_repeats_and_empty(spark):
    text = TEXTS[12]
    docs = spark.createDataFrame([(None, text), (7, text), (5, text), (5, text), (9, "other words here"), (9, "quite another text of words")], "doc_id long, text string")
    rows = near_duplicates(docs).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in rows)[:4] == [(-1, 5), (5, 5), (5, 5), (7, 5)]
    assert sorted(r.doc_id or -1 for r in one_of_each(docs).collect()) == [-1, 5, 9]
    empty = docs.limit(0)
    assert near_duplicates(empty).count() == one_of_each(empty).count() == 0
    assert near_duplicates(spark.createDataFrame([(None, "a b c")], "doc_id long, text string")).first().component_id is None


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(3, 3), (None, 4)]
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in rows} == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
