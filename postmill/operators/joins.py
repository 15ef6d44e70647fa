"""Joins of postings with details, sources, contacts and the watchlist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.functions.labels import connection_label
from postmill.functions.text import ascii_lower, normalize_company
from postmill.operators.aggregates import stats_by_company
from postmill.operators.dedupe import first_rows
from postmill.operators.skew import lookup_join


def attach_details(listings: DataFrame, details: DataFrame, how: str = "left") -> DataFrame:
    """Add the landed detail page of each URL as ``detail_html``.

    'left' keeps listings without one, 'inner' drops them. The first readable page per URL counts.
    """
    pages = details.filter(F.col("body").isNotNull())
    if "error" in details.columns:
        pages = pages.filter(F.col("error").isNull())
    pages = first_rows(pages.select("source", "url", "seq", "body"), ["source", "url"], ["seq"])
    return listings.join(pages.select("source", "url", F.col("body").alias("detail_html")), ["source", "url"], how)


def attach_source_dim(df: DataFrame, sources: DataFrame, spread: str = "seq") -> DataFrame:
    """Add company, locations, keyword pattern and rank of each configured source."""
    dim = sources.select("source", "company", "locations", "keyword_pattern", "rank")
    return lookup_join(df, dim, ["source"], spread, "inner")


def attach_connections(postings: DataFrame, connections: DataFrame, spread: str = "id") -> DataFrame:
    """Left lookup of contacts by normalised company name, aliases included; adds ``connection``."""
    dim = connections.select("company_key", "contacts", "notes").withColumn("_listed", F.lit(True))
    keyed = postings.withColumn("company_key", normalize_company("company"))
    label = F.when(F.col("_listed"), connection_label("contacts", "notes"))
    return (
        lookup_join(keyed, dim, ["company_key"], spread)
        .withColumn("connection", label)
        .select(*postings.columns, "connection")
    )


def watchlist_stats(watchlist: DataFrame, postings: DataFrame) -> DataFrame:
    """Each company with its posting count, latest date text and top score.

    Postings are aggregated before the join, so a company with very many costs one row.
    """
    return (
        watchlist.withColumn("company_key", ascii_lower("name"))
        .join(stats_by_company(postings), "company_key", "left")
        .withColumn("total_jobs", F.coalesce("total_jobs", F.lit(0)))
        .drop("company_key")
    )
