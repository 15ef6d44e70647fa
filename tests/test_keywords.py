"""The keyword join against the keyword pattern."""

import random

from pyspark.sql import functions as F

from postmill.functions.text import contains_keyword, keyword_pattern, matches_pattern
from postmill.operators.keywords import keyword_hits, keyword_join

FIXED = [
    "Building a RAG pipeline", "Senior LLM-Engineer", "cloud storage", "Werbeagentur", "C++ and C#, .NET", "asp.net core", ".net", "use c++", "c+++", "machine  learning", "machine learning",
    "a.b", "multi-agent systems", "multi agent", "", "++", "x++y", " ++ ", "ÉTÉ à la", "Kelvin ſea", "node.js!", "R&D", "r & d", "learning machine", "café rag",
]
KEYWORDS = ["rag", "LLM", "c++", ".net", "C#", "machine learning", "multi-agent", "++", "été", "kelvin", "sea", "node.js", "r&d", "a.b", "pipeline", "café", "(x", "$5", ".."]


def frame(spark, texts, sources):
    return spark.createDataFrame([(i, sources[i % len(sources)], t) for i, t in enumerate(texts)], "id int, source string, text string")


def both(spark, docs, words):
    lists = words.groupBy("source").agg(F.collect_set("keyword").alias("keywords")).withColumn("pattern", keyword_pattern("keywords"))
    want = {r.id for r in docs.join(lists, "source").filter(matches_pattern("text", "pattern")).collect()}
    return {r.id for r in keyword_hits(docs, words, F.col("text")).collect()}, want


def test_join_finds_what_the_pattern_finds(spark):
    for k in KEYWORDS:
        docs, words = frame(spark, FIXED, ["s"]), spark.createDataFrame([("s", k)], "source string, keyword string")
        assert {r.id for r in keyword_hits(docs, words, F.col("text")).collect()} == {r.id for r in docs.filter(contains_keyword("text", [k])).collect()}, k


def test_many_keywords_and_sources(spark):
    dice = random.Random(2)
    parts = ["ai", "ml", "data", "c", "x1", "+", "#", ".", "-", " ", "  ", "é", "/", "\n", "(", "big"]
    text = lambda n: "".join(dice.choice(parts) for _ in range(n))
    docs = frame(spark, [text(dice.randint(0, 25)) for _ in range(300)], ["a", "b", "c"])
    words = spark.createDataFrame([(dice.choice("abd"), text(dice.randint(1, 4))) for _ in range(1200)], "source string, keyword string").filter("trim(keyword) <> ''")
    got, want = both(spark, docs, words)
    assert got == want and 100 < len(got) < 300


def test_lists_too_large_to_broadcast_and_rows_kept(spark, monkeypatch):
    from postmill.operators import skew

    docs = frame(spark, FIXED * 4, ["s", "t"])
    words = spark.createDataFrame([(s, k) for s in "st" for k in KEYWORDS], "source string, keyword string")
    want = both(spark, docs, words)
    monkeypatch.setattr(skew, "is_small", lambda dim, rows: False)
    assert both(spark, docs, words) == want and want[0] == want[1]
    kept = keyword_join(docs, words, F.col("text"))
    assert kept.columns == docs.columns and {r.id for r in kept.collect()} == want[0]


def test_no_keywords(spark):
    none = spark.createDataFrame([], "source string, keyword string")
    assert keyword_hits(frame(spark, FIXED, ["s"]), none, F.col("text")).count() == 0


def test_rows_named_by_short_keywords_and_rows_left_for_the_join(spark, monkeypatch):
    from postmill.operators import keywords, skew

    docs = frame(spark, ["rag and more", "a machine learning job", "nothing", None, "use c++ or data-lake tools", "data lake", "DATA-LAKE rag"], ["s"])
    words = spark.createDataFrame([("s", k) for k in ("rag", "machine learning", "data-lake", "c++")] + [("t", "nothing")], "source string, keyword string")
    monkeypatch.setattr(skew, "is_small", lambda dim, rows: False)
    monkeypatch.setattr(keywords, "SHORT_LIST", 1)
    joined = []
    monkeypatch.setattr(skew, "salted_join", lambda big, *rest, real=skew.salted_join: joined.append({r[0] for r in big.select("id").collect()}) or real(big, *rest))
    got, want = both(spark, docs, words)
    assert got == want == {0, 1, 4, 6}
    # Rows that a short keyword names send no run into the shuffle.
    assert 0 not in joined[0] and {1, 2, 4, 5} <= joined[0]


def test_runs_are_whole_words_once_each(spark):
    from postmill.operators.keywords import word_runs

    rows = spark.createDataFrame([("a b, a b c1",), ("",), ("+",), ("x",)], "t string").select(word_runs("t", [1, 2, 4]).alias("r")).collect()
    assert [sorted(r.r) for r in rows] == [sorted(["a", "b", "c1", "a b", "b, a", "b c1", "a b, a b", "b, a b c1"]), [], [], ["x"]]
