"""Keyword lists of any length: words of the postings meet the keywords in a hash join, instead of one pattern a row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.text import as_col, keyword_pattern, matches_pattern
from postmill.operators import skew
from postmill.operators.dedupe import first_rows
from postmill.operators.filters import posting_text
from postmill.operators.skew import lookup_join
from postmill.session import stage

# Letters that the case-blind patterns of functions.text take for ASCII ones, and two that have another small form.
_ODD, _PLAIN = "İıſKςµ", "iiskσμ"
_WORD, _MARK, _EDGE = "[a-z0-9]+", "X", "Y"
# So many keywords a source are looked for in the row itself when the whole list is too large to broadcast.
SHORT_LIST = 5_000


def folded(c: Column | str) -> Column:
    """Small letters, as the case-blind keyword patterns compare them."""
    return F.lower(F.translate(as_col(c), _ODD, _PLAIN))


def keyword_parts(keywords: DataFrame) -> DataFrame:
    """(source, gram, n, ends, plain) of ``keywords(source, keyword)``.

    ``gram`` is a keyword from its first to its last letter or digit (of a-z and 0-9), ``n`` the number of words in it, and ``ends`` what the keywords of
    that gram have before and behind it; ``plain`` says that one of them has nothing there. Keywords without any such character have no gram.
    """
    rows = keywords.select("source", folded("keyword").alias("k")).filter("k <> ''").distinct()
    gram = F.regexp_extract("k", "(?s)[a-z0-9](?:.*[a-z0-9])?", 0)
    rows = rows.withColumn("gram", gram).withColumn("_at", F.locate("x", F.regexp_replace("k", "[a-z0-9]", "x")))
    lead = F.when(F.col("_at") > 0, F.expr("substr(k, 1, _at - 1)")).otherwise(F.col("k"))
    trail = F.when(F.col("_at") > 0, F.expr("substr(k, _at + length(gram))")).otherwise("")
    ends = F.collect_set(F.struct(lead.alias("lead"), trail.alias("trail"))).alias("ends")
    counted = rows.groupBy("source", "gram").agg(ends).withColumn("n", F.regexp_count("gram", F.lit(_WORD)))
    return counted.withColumn("plain", F.exists("ends", lambda e: (e["lead"] == "") & (e["trail"] == "")))


def word_runs(low: Column | str, sizes: list[int]) -> Column:
    """Every run of as many words as ``sizes`` say, once each, as it stands in the folded text ``low``: one pattern a size, which looks ahead over the run
    and goes on behind its first word."""
    runs = [F.regexp_extract_all(as_col(low), F.lit(rf"(?<![a-z0-9])(?=({_WORD}+(?:[^a-z0-9]++{_WORD}+){{{n - 1}}}+)){_WORD}+"), F.lit(1)) for n in sizes]
    return F.array_distinct(F.concat(*runs))


def _between_words(low: Column | str, sizes: list[int]) -> Column:
    """As :func:`word_runs`, with what stands before and behind the run. Every word has a capital at both ends, and the text has another one at its own,
    which folded text doesn't hold."""
    marked = F.concat(F.lit(_EDGE), F.regexp_replace(as_col(low), _WORD, f"{_MARK}$0{_MARK}"), F.lit(_EDGE))
    word, gap = f"{_MARK}{_WORD}+", f"[^a-z0-9{_MARK}{_EDGE}]"
    run = f"{_EDGE}?{gap}*+{word}(?:{_MARK}{gap}++{word}){{%d}}+{_MARK}{gap}*+{_EDGE}?"
    runs = [F.regexp_extract_all(marked, F.lit(rf"(?:^|(?<=[a-z0-9]{_MARK}))(?=({run % (n - 1)}))[^{_MARK}]*+{word}"), F.lit(1)) for n in sizes]
    return F.array_distinct(F.concat(*runs))


def _stands(ends: Column) -> Column:
    """Whether what a keyword has before and behind its gram stands there too, with no letter or digit next to it."""
    before = (ends["lead"] == "") | (F.col("before").endswith(ends["lead"]) & (F.col("first") | (F.col("before") != ends["lead"])))
    after = (ends["trail"] == "") | (F.col("after").startswith(ends["trail"]) & (F.col("last") | (F.col("after") != ends["trail"])))
    return before & after


def _plain_hits(low: DataFrame, parts: DataFrame, sizes: list[int], key: str) -> DataFrame:
    """Keys of the rows that hold a run which is a keyword as it stands.

    A list too large to broadcast lends its shortest keywords of each source, which each row looks for in place. What runs the other rows have is stored
    once and meets the whole list in a shuffle.
    """
    runs = word_runs("_low", sizes)
    if skew.is_small(parts, skew.BROADCAST_ROWS):
        found = low.select(key, "source", F.explode(runs).alias("gram"))
        return found.join(F.broadcast(parts.select("source", "gram")), ["source", "gram"], "left_semi").select(key)
    short = first_rows(parts, ["source"], ["n", F.length("gram"), "gram"], SHORT_LIST).limit(skew.BROADCAST_ROWS)
    listed = F.sort_array(F.collect_list(F.struct("n", F.length("gram"), "gram")))["gram"]
    lists = short.groupBy("source").agg(listed.alias("_list"))
    tried = low.join(F.broadcast(lists), "source", "left").select(key, "source", "_list", runs.alias("_runs"))
    named = F.coalesce(F.arrays_overlap("_runs", "_list"), F.lit(False))
    tried = tried.withColumn("_named", named).withColumn("_runs", F.when(~F.col("_named"), F.col("_runs")))
    tried = stage(tried.select(key, "source", "_named", "_runs"), "keyword-runs")
    rest = tried.filter(~F.col("_named")).select(key, "source", F.explode("_runs").alias("gram"))
    return tried.filter("_named").select(key).unionAll(skew.salted_join(rest, parts.select("source", "gram"), ["source", "gram"], key, "inner").select(key))


def _edged_hits(low: DataFrame, parts: DataFrame, sizes: list[int], key: str) -> DataFrame:
    """Keys of the rows that hold the gram of a keyword with the signs that it has before or behind."""
    runs = low.select(key, "source", F.explode(_between_words("_low", sizes)).alias("_run"))
    runs = runs.withColumn("gram", F.translate(F.regexp_extract("_run", f"(?s){_MARK}(.*){_MARK}", 1), _MARK, ""))
    joined = lookup_join(runs, parts.select("source", "gram", "ends"), ["source", "gram"], key, "inner")
    joined = joined.withColumns(
        {
            "before": F.regexp_extract("_run", f"^{_EDGE}?([^{_MARK}]*)", 1),
            "after": F.regexp_extract("_run", f"([^{_MARK}{_EDGE}]*){_EDGE}?\\z", 1),
            "first": F.col("_run").startswith(_EDGE),
            "last": F.col("_run").endswith(_EDGE),
        }
    )
    return joined.filter(F.exists("ends", _stands)).select(key)


def keyword_hits(df: DataFrame, keywords: DataFrame, over: Column | None = None, key: str = "id") -> DataFrame:
    """The distinct ``key`` of the rows of ``df(key, source, ...)`` that name a keyword of their source in ``over``.

    Each row's distinct words and word runs are made once, whatever the number of keywords, and joined to ``keywords(source, keyword)`` by hash. The join
    finds what contains_keyword finds: keywords stand between characters other than a-z and 0-9. Only the words of a keyword's length are made: lengths, a
    few numbers, reach the driver. The keywords are stored once, since several steps read them.
    """
    parts = stage(keyword_parts(keywords), "keywords")
    kinds = {(r.n, r.plain) for r in parts.select("n", "plain").distinct().collect()}
    text = posting_text() if over is None else over
    low = df.select(key, "source", folded(text).alias("_low"))
    hits = []
    for plain, found_in in ((True, _plain_hits), (False, _edged_hits)):
        sizes = sorted(n for n, p in kinds if n and p == plain)
        if sizes:
            hits.append(found_in(low, parts.filter(F.col("plain") == plain).filter("n > 0"), sizes, key))
    if any(n == 0 for n, _ in kinds):  # signs alone, which are no words: one pattern a source
        signs = parts.filter("n = 0").select("source", keyword_pattern(F.transform("ends", lambda e: e["lead"])).alias("_signs"))
        texts = lookup_join(low, signs, ["source"], key, "inner")
        hits.append(texts.filter(matches_pattern("_low", "_signs")).select(key))
    if not hits:
        return df.select(key).limit(0)
    return reduce(DataFrame.unionAll, hits).distinct()


def keyword_join(df: DataFrame, keywords: DataFrame, over: Column | None = None, key: str = "id") -> DataFrame:
    """The rows of ``df`` that :func:`keyword_hits` finds; ``key`` must name a row."""
    return df.join(keyword_hits(df, keywords, over, key), key, "left_semi").select(*df.columns)
