import random

import pytest

from postmill.llm.mixing import mix, mixture, targets


def water(sizes, weights, share, most):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, out, free = share * sum(sizes.values()), {}, set(order)
    while free:
        rest = total - sum(out.values())
        over = {s for s in free if rest * weight[s] / sum(weight[x] for x in free) >= most * sizes[s]}
        if not over:
            return out | {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        out |= {s: most * sizes[s] for s in over}
        free -= over
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 20, "c": 5, None: 40}, {"a": 1000, "b": 1, "é": 0, "z": 30, "Z": 7}, {"a": 5}, {None: 0}])
def test_targets(spark, sizes):
    rows = targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), (5, 2, 1), 1.5, 2.0).collect()
    assert {r.source: pytest.approx(r.target) for r in rows} == water(sizes, (5, 2, 1), 1.5, 2.0)


def corpus(spark, n=3000):
    rng = random.Random(3)
    rows = [(i, "w " * min(400, int(rng.paretovariate(1.1) * 5)), "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "c", None]), i % 3) for i in range(n)]
    return spark.createDataFrame(rows + [(None, None, "a", 1), (n, "", "b", None), (n + 1, " \n", "hot", 2)], "doc_id long, text string, source string, rank int")


def test_each_source_comes_near_its_target(spark):
    rows = mixture(corpus(spark)).collect()
    assert len(rows) == 3003
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert sum(r.size for r in own) == own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own) / 2 + 1
    assert all(r.taken in (0, r.size, 2 * r.size) for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixture(corpus(spark).repartition(7)).collect()))


def test_mix_holds_the_documents_as_often(spark):
    docs = corpus(spark)
    mixed = mix(docs)
    assert mixed.columns == docs.columns
    count = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert count == {r.doc_id: r.copies for r in mixture(docs).collect() if r.copies}


def test_tiers_change_the_odds(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "s", 1.0 if i % 2 else 3.0) for i in range(4000)] + [(5000 + i, "w " * 10, "t", None) for i in range(2000)], "doc_id long, text string, source string, tier double")
    rows = mixture(docs, weights=(1, 1), share=0.5, tier="tier").collect()
    share = {k: sum(r.copies for r in rows if r.source == "s" and r.doc_id % 2 == k) / 2000 for k in (0, 1)}
    assert share[0] / share[1] == pytest.approx(3, rel=0.15)
    assert sum(r.taken for r in rows if r.source == "s") == pytest.approx(next(r.target for r in rows if r.source == "s"), abs=10)


def test_one_row_repeated_very_often(spark):
    docs = spark.createDataFrame([(1, "a b c", "s")] * 2000 + [(i, "x y", "t") for i in range(2, 500)], "doc_id long, text string, source string")
    for frame in (docs, docs.repartition(3), docs.repartition(13)):
        rows = mixture(frame, share=0.8).collect()
        assert len(rows) == 2498
        for s in ("s", "t"):
            own = [r for r in rows if r.source == s]
            # Within half a document, however often it is repeated and however the rows are split.
            assert abs(sum(r.taken for r in own) - own[0].target) <= own[0].size / 2
        mixed = {r.doc_id: r["count"] for r in mix(frame, share=0.8).groupBy("doc_id").count().collect()}
        assert mixed[1] == sum(r.copies for r in rows if r.doc_id == 1) and sum(mixed.values()) == sum(r.copies for r in rows)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixture(docs).count() == mix(docs).count() == 0
    assert [r.taken for r in mixture(spark.createDataFrame([(1, None, None)], docs.schema)).collect()] == [0]
