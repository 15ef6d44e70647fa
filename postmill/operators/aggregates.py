"""Counts and summaries over postings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.dates import has_parseable_date
from postmill.functions.text import ascii_lower
from postmill.operators.dedupe import first_rows
from postmill.operators.filters import is_recent

SHORT_DESCRIPTION = 200


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) == ""


def field_quality(df: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Per source: rows, missing locations and dates, short descriptions, and whether it has rows.

    With ``sources`` (a column ``source``), sources without any row are listed too.
    """
    out = df.groupBy("source").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(_blank("location")).alias("missing_location"),
        F.count_if(_blank("date_posted")).alias("missing_date"),
        F.count_if(F.length("description") < SHORT_DESCRIPTION).alias("short_description"),
    )
    if sources is not None:
        out = sources.select("source").distinct().join(out, "source", "left").na.fill(0)
    return out.withColumn("ok", F.col("rows") > 0)


def collection_summary(df: DataFrame, cutoff: Column, inserted: Column | None = None) -> DataFrame:
    """Per source and in total: collected, skipped as too old, undated, and new rows."""
    new = F.lit(0).cast("long") if inserted is None else F.count_if(inserted)
    return (
        df.select(
            "source",
            is_recent(cutoff).alias("_recent"),
            has_parseable_date("date_posted").alias("_dated"),
            *([] if inserted is None else [inserted.alias("_new")]),
        )
        .rollup("source")
        .agg(
            F.grouping_id().cast("int").alias("is_total"),
            F.count(F.lit(1)).alias("collected"),
            F.count_if(~F.col("_recent")).alias("skipped"),
            F.count_if(~F.col("_dated")).alias("undated"),
            (new if inserted is None else F.count_if("_new")).alias("new"),
        )
    )


def _stats() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total_jobs"),
        F.max("date_posted").alias("latest_job_date"),
        F.max("score").alias("top_score"),
    ]


def company_stats(df: DataFrame, name: str) -> DataFrame:
    """Row count, greatest date text and top score of one company, ignoring ASCII case."""
    return df.filter(ascii_lower("company") == ascii_lower(F.lit(name))).agg(*_stats())


def stats_by_company(df: DataFrame) -> DataFrame:
    return df.groupBy(ascii_lower("company").alias("company_key")).agg(*_stats())


def filter_values(df: DataFrame, columns: Sequence[str] = ("source", "status", "company")) -> DataFrame:
    """Distinct values of each column as (field, value), in one pass over the table."""
    return df.select(*columns).unpivot([], list(columns), "field", "value").distinct().orderBy("field", "value")


def count_postings(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def longest_text_per_url(
    links: DataFrame, keys: Sequence[str] = ("source", "url"), carry: Sequence[str] = ()
) -> DataFrame:
    """Per URL: its longest text (the first one on ties), and position and ``carry`` columns of
    its first link with any text."""
    rank = F.struct(F.length("text"), -F.col("seq"), -F.col("pos"))
    return (
        links.filter(F.length("text") > 0)
        .groupBy(*keys)
        .agg(F.max_by("text", rank).alias("text"), F.min(F.struct("seq", "pos", *carry)).alias("_first"))
        .select(*keys, "text", "_first.*")
    )


def scoring_summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count("score").alias("scored"), F.count_if(F.col("score").isNull()).alias("failed"))


def preview(df: DataFrame, n: int = 10, order: Sequence[Column | str] = ("seq", "pos")) -> DataFrame:
    """First ``n`` rows per source, each with the number of rows left out."""
    rest = df.groupBy("source").agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("more"))
    return first_rows(df, ["source"], order, n).join(rest, "source")
