import random
import re
import time

import pytest

from postmill.llm import tiling
from postmill.llm.tiling import clean, contamination, tiles


def brute_tiles(item, text, least):
    """Greedy string tiling by its definition: the longest unmarked common run, again and again."""
    a_free, b_free, found = [True] * len(item), [True] * len(text), []
    while True:
        best = 0
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and a_free[i + n] and b_free[j + n]:
                    n += 1
                if n > best:
                    best, at = n, (i, j)
        if best < least:
            return found
        i, j = at
        a_free[i : i + best] = b_free[j : j + best] = [False] * best
        found.append((i, j, best))


@pytest.mark.parametrize("seed", range(40))
def test_tiles_cover_what_the_definition_covers(seed):
    rng = random.Random(seed)
    item = [rng.randrange(500) for _ in range(rng.randint(6, 90))]
    cuts = sorted(rng.sample(range(len(item)), 3))
    parts = [item[: cuts[0]], item[cuts[0] : cuts[1]], item[cuts[1] : cuts[2]], item[cuts[2] :]]
    rng.shuffle(parts)
    text = [w for p in parts for w in [*p, *(rng.randrange(600, 700) for _ in range(rng.randrange(4)))]]
    found = tiles(item, text, 5)
    assert all(item[i : i + n] == text[j : j + n] and n >= 5 for i, j, n in found)
    for k in (0, 1):
        covered = [x for t in found for x in range(t[k], t[k] + t[2])]
        assert len(covered) == len(set(covered))
    assert found == brute_tiles(item, text, 5)


@pytest.mark.parametrize("seed", range(30))
def test_tiles_of_repetitive_texts_are_those_of_the_definition(seed, monkeypatch):
    rng = random.Random(seed)
    letters = rng.randint(1, 3)
    item, text = ([rng.randrange(letters) if rng.random() < 0.9 else None for _ in range(rng.randint(0, 40))] for _ in range(2))
    item = [w for w in item if w is not None]
    monkeypatch.setattr(tiling, "PAIRS", rng.choice([1, 7, 1 << 19]))
    assert tiles(item, text, 3) == brute_tiles(item, [object() if w is None else w for w in text], 3)


@pytest.mark.parametrize("cycle", [1, 6])
def test_long_repetitive_texts_take_no_time(cycle):
    item, text = [k % cycle for k in range(1000)], [k % cycle for k in range(2000)]
    begun = time.process_time()
    found = tiles(item, text, 5)
    assert found == [(0, 0, 1000)] and time.process_time() - begun < 3
    assert sum(n for *_, n in tiles([7] * 200, ([7] * 30 + [8]) * 100, 5)) == 200


def test_pairs_that_cannot_reach_the_threshold_are_not_tiled(spark, monkeypatch):
    """A passage that all items begin with is shared by all; only pairs with enough else in common are tiled."""
    head = " ".join(f"h{i}" for i in range(8))
    items = [(i, head + " " + " ".join(f"i{i}x{k}" for k in range(30))) for i in range(20)]
    docs = [(i, items[i][1] if i < 5 else head + f" text {i}") for i in range(40)]
    tiled = []
    real = tiling.coverage
    monkeypatch.setattr(tiling, "coverage", lambda pairs, least: tiled.append(pairs.count()) or real(pairs, least))
    rows = contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == [(i, i) for i in range(5)] and tiled == [5]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def fixture():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(passage(rng.randint(15, 60)))) for i in range(12)]
    docs = []
    for i in range(60):
        own = passage(rng.randint(0, 120))
        kind = i % 6
        item = rng.choice(items)[1].split()
        if kind == 0:
            own[len(own) // 2 : len(own) // 2] = item
        elif kind == 1:  # reordered
            third = len(item) // 2
            own = [*own, *item[third:], "between", *item[:third], *passage(5)]
        elif kind == 2:  # too little of it
            own += item[: len(item) // 2]
        elif kind == 3:
            own = [w.upper() for w in item]
        docs.append((i, ("\n" if i % 2 else "  ").join(own)))
    return docs + [(None, items[0][1]), (100, None), (101, ""), (102, items[3][1]), (102, items[3][1])], items + [(50, "too short"), (51, None), (None, items[1][1])]


def test_query_equals_brute_force(spark):
    docs, items = fixture()
    want = []
    for doc, text in docs:
        for item, passage in items:
            a, b = words(passage), words(text)
            covered = sum(n for *_, n in brute_tiles(a, b, 5)) if len(a) >= 5 else 0
            if a and covered >= 0.8 * len(a):
                want.append((doc, item, covered, len(a)))
    d = spark.createDataFrame([(*r, 0, "x") for r in docs], "doc_id long, text string, item int, words string")
    b = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, seeds string")
    rows = contamination(d, b).collect()
    assert sorted([str((r.doc_id, r.item_id, r.covered, r.item_words)) for r in rows]) == sorted(map(str, want)) and len(want) > 25
    assert any(r.n_tiles > 1 for r in rows)
    kept = clean(d, b)
    named = {w[0] for w in want}
    assert kept.columns == d.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in docs if i not in named)


def test_empty_tables(spark):
    docs, items = (spark.createDataFrame(rows, f"{name} long, text string") for rows, name in zip(fixture(), ("doc_id", "item_id")))
    assert contamination(docs.limit(0), items).count() == contamination(docs, items.limit(0)).count() == 0
    assert clean(docs, items.limit(0)).count() == docs.count()


def test_clean_judges_each_row_alone(spark):
    leak = " ".join(f"w{i}" for i in range(20))
    rows = [(None, leak), *((None, f"clean text number {i}") for i in range(6)), (7, leak), (7, "another clean text"), (7, "another clean text"), (None, None), (8, leak), (9, "")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, row int").repartition(3)
    kept = clean(docs, spark.createDataFrame([(1, leak)], "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(r.row for r in kept.collect()) == [i for i, (_, text) in enumerate(rows) if text != leak]
