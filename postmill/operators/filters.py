"""Row filters: keywords, locations, recency, and the posting list with its options."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import dates, text
from postmill.schema import DEFAULT_KEYWORDS


def posting_text() -> Column:
    return F.concat_ws(" ", "title", "location", "description")


def keyword_filter(
    df: DataFrame, keywords: Sequence[str] = DEFAULT_KEYWORDS, over: Column | None = None, enabled: bool = True
) -> DataFrame:
    """Rows naming a keyword in title, location or description (or in ``over``)."""
    return df.filter(text.contains_keyword(posting_text() if over is None else over, keywords)) if enabled else df


def location_filter(df: DataFrame, locations: Column | Sequence[str] | None, over: str = "location") -> DataFrame:
    """Rows in an allow-listed location; ``locations`` may be an array column per row."""
    return df.filter(text.matches_location(over, locations))


def is_recent(cutoff: Column, date_posted: Column | str = "date_posted") -> Column:
    """Missing and unreadable dates count as recent."""
    posted = dates.posted_on(date_posted)
    return posted.isNull() | (posted >= cutoff)


def within_lookback(df: DataFrame, cutoff: Column) -> DataFrame:
    return df.filter(is_recent(cutoff))


def is_stale(days: int, as_of: Column) -> Column:
    return (F.col("status") == "new") & (F.col("date_collected") < dates.days_before(as_of, days))


def stale(df: DataFrame, days: int, as_of: Column) -> DataFrame:
    """Still-new postings collected more than ``days`` days before ``as_of``."""
    return df.filter(is_stale(days, as_of))


def order_stale(df: DataFrame) -> DataFrame:
    return df.orderBy("date_collected", "id")


# Sort orders of the posting list. NULL scores come last; ids break every tie.
NEWEST = (F.desc, "date_collected"), (F.desc, "id")
BY_SCORE = (F.desc_nulls_last, "score"), *NEWEST


def order_newest(df: DataFrame) -> DataFrame:
    return df.orderBy(*[direction(c) for direction, c in NEWEST])


def order_by_score(df: DataFrame) -> DataFrame:
    return df.orderBy(*[direction(c) for direction, c in BY_SCORE])


def order_export(df: DataFrame) -> DataFrame:
    posted = F.coalesce("date_posted", F.lit(""))
    return df.orderBy(F.desc_nulls_last("score"), posted.desc(), F.desc("id"))


def list_postings(
    df: DataFrame,
    source: str | None = None,
    status: str | None = None,
    company: str | None = None,
    keyword: str | None = None,
    sort_by: str = "newest",
    min_score: int | None = None,
) -> DataFrame:
    """Filtered, sorted postings. A minimum score of 1 or less keeps unscored rows too."""
    orders = {"newest": order_newest, "score": order_by_score}
    if sort_by not in orders:
        raise ValueError(f"unknown sort order: {sort_by}")
    for name, value in (("source", source), ("status", status), ("company", company)):
        if value:
            df = df.filter(F.col(name) == value)
    if keyword:
        fields = ("title", "company", "location", "description")
        df = df.filter(reduce(lambda a, b: a | b, (text.like_anywhere(f, keyword) for f in fields)))
    if min_score is not None and min_score > 1:
        df = df.filter(F.col("score") >= min_score)
    return orders[sort_by](df)


def top_scoring(df: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` best scored postings (a top-k per task, then one merge of k rows each)."""
    return order_by_score(df.filter(F.col("score").isNotNull())).limit(k)


def unscored(df: DataFrame) -> DataFrame:
    return df.filter(F.col("score").isNull())


def is_recent_local(max_age_days: int, locations: Sequence[str], as_of_date: Column) -> Column:
    """A readable date of at most that age, in one of the places; a missing date says no."""
    posted = dates.parse_date_any("date_posted", dates.LISTING_FORMATS)
    fresh = F.coalesce(posted >= F.date_sub(as_of_date, max_age_days), F.lit(False))
    return fresh & text.matches_location(F.coalesce("location", F.lit("")), locations)


def accept_recent_local(listings: DataFrame, max_age_days: int, locations: Sequence[str], as_of_date: Column) -> DataFrame:
    return listings.filter(is_recent_local(max_age_days, locations, as_of_date))


def drop_noisy_terms(results: DataFrame, max_results: int, total: str = "total") -> DataFrame:
    """Drop whole responses whose term matched more postings than a precise term would."""
    return results.filter(F.coalesce(F.col(total), F.lit(0)) <= max_results)


def noisy_terms(results: DataFrame, max_results: int, total: str = "total") -> DataFrame:
    """(source, responses, rows): what drop_noisy_terms leaves out of each source."""
    return (
        results.filter(F.col(total) > max_results)
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("responses"), F.sum(total).alias("rows"))
    )
