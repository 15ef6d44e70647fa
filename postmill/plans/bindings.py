"""The star-schema test tables read as postings, runs, contacts and landed payloads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions import text
from postmill.schema import POSTINGS, RUNS
from postmill.sources.connections import connections_lookup

# Ids per landed response; a response is built from one short id range, never from a whole source.
PER_RESPONSE = 50


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def postings(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their customer and nation, as stored postings."""
    orders, customer, nation = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    key = F.col("o_orderkey")
    company = F.when(key % 3 == 0, F.upper("c_name")).otherwise(F.concat(F.lit("  "), "c_name", F.lit(" ")))
    posted = (
        F.when(key % 11 == 0, None)
        .when(key % 13 == 0, "not-a-date")
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    )
    score = F.when(key % 4 != 0, 1 + F.floor(F.col("o_totalprice") / 50000))
    status = F.when(F.col("o_orderstatus") == "P", "new").when(F.col("o_orderstatus") == "F", "ignored").otherwise("applied")
    collected = F.col("o_orderdate").cast("timestamp") + F.make_interval(days=(key % 40).cast("int"))
    values = {
        "id": key,
        "title": F.col("o_orderpriority"),
        "company": company,
        "location": F.col("n_name"),
        "source": F.lower("c_mktsegment"),
        "url": F.concat(F.lit("https://x.example/"), (key % 12000).cast("string")),
        "description": F.concat_ws(" ", "o_orderpriority", "c_mktsegment"),
        "date_posted": posted,
        "date_collected": collected,
        "dedupe_key": text.dedupe_key(company, "o_orderpriority", "n_name"),
        "status": status,
        "score": score,
        "score_reason": F.when(score.isNotNull() & (key % 5 != 0), F.concat(F.lit('band "'), score.cast("string"), F.lit('" & more'))),
        "score_source": F.when(score.isNotNull(), F.when(key % 2 == 0, "manual").otherwise("ai")),
        "created_at": collected,
        "updated_at": collected,
    }
    return joined.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in POSTINGS])


def two_city_postings(spark: SparkSession, sf: str) -> DataFrame:
    """The postings with every fifth one in another place, so that equal roles have unlike keys."""
    place = F.when(F.col("id") % 5 == 0, "Remote").otherwise(F.col("location"))
    moved = postings(spark, sf).withColumn("location", place)
    return moved.withColumn("dedupe_key", text.dedupe_key("company", "title", "location"))


def halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Even ids as the stored half, odd ids as the arriving half."""
    rows = postings(spark, sf)
    return rows.filter(F.col("id") % 2 == 0), rows.filter(F.col("id") % 2 == 1)


def run_columns() -> dict[str, Column]:
    found = F.greatest(F.lit(0), F.floor("value") - 100)
    kind = F.col("event_type")
    return {
        "id": F.col("event_id"),
        "source": F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")),
        "started_at": F.date_trunc("second", F.col("ts").cast("timestamp")),
        "finished_at": F.lit(None),
        "status": F.when(kind == "error", "error").when(kind == "signup", "running").otherwise("ok"),
        "jobs_found": found,
        "jobs_inserted": F.floor(found / 2),
        "error_message": F.when(kind == "error", F.col("props")),
    }


def to_runs(events: DataFrame) -> DataFrame:
    values = run_columns()
    return events.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in RUNS])


def runs(spark: SparkSession, sf: str) -> DataFrame:
    return to_runs(table(spark, sf, "events"))


def watchlist(spark: SparkSession, sf: str) -> DataFrame:
    customer = table(spark, sf, "customer")
    return customer.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("https://c.example/"), "c_custkey")).alias("careers_url"),
        F.lit("1998-01-01").cast("timestamp").alias("added_at"),
        (F.col("c_custkey") % 10 != 0).alias("active"),
    )


ENTRY = "struct<company:variant, aliases:array<variant>, connections:array<struct<name:variant, relationship:variant, notes:variant>>, notes:variant>"


def connections(spark: SparkSession, sf: str) -> DataFrame:
    """Three quarters of the customers as contact entries, some under an alias only."""
    c = table(spark, sf, "customer").withColumn("k", F.col("c_custkey"))
    contact = F.struct(
        F.when(F.col("k") % 7 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" Person "), "k")).alias("name"),
        F.when(F.col("k") % 2 == 0, F.lit("peer")).otherwise(F.lit("")).alias("relationship"),
        F.when(F.col("k") % 3 == 0, F.col("c_mktsegment")).otherwise(F.lit("")).alias("notes"),
    )
    entry = F.struct(
        F.when(F.col("k") % 4 == 1, F.concat(F.lit("Other "), "k")).otherwise(F.col("c_name")).alias("company"),
        F.when(F.col("k") % 4 == 1, F.array(F.lit(""), F.replace("c_name", F.lit("#"), F.lit(" - "))))
        .otherwise(F.array().cast("array<string>"))
        .alias("aliases"),
        F.array(contact).alias("connections"),
        F.when(F.col("k") % 5 == 0, F.lit("ask first")).otherwise(F.lit("")).alias("notes"),
    )
    return connections_lookup(
        c.filter(F.col("k") % 4 != 3).select(F.col("k").alias("seq"), F.from_json(F.to_json(entry), ENTRY).alias("entry"))
    )


def landed(
    rows: DataFrame, entry: Column, body: Callable[[Column], Column], source: Column | None = None, url: str = "https://site.example/search"
) -> DataFrame:
    """Responses holding one entry per row, in id order, ready for a payload reader."""
    grouped = (
        rows.select(
            (F.col("source") if source is None else source).alias("source"),
            F.floor(F.col("id") / PER_RESPONSE).alias("seq"),
            F.struct("id", entry.alias("entry")).alias("item"),
        )
        .groupBy("source", "seq")
        .agg(F.sort_array(F.collect_list("item"))["entry"].alias("entries"))
    )
    return grouped.select(
        "source",
        F.lit(url).alias("url"),
        F.lit(None).cast("string").alias("term"),
        F.lit("2001-06-01T08:00:00Z").alias("fetched_at"),
        "seq",
        body(F.col("entries")).alias("body"),
        F.lit(None).cast("string").alias("error"),
        F.lit("Acme").alias("company"),
        F.lit(None).cast("array<string>").alias("locations"),
        text.keyword_pattern(F.array(F.lit("high"), F.lit("urgent"))).alias("keyword_pattern"),
        F.length("source").alias("rank"),
    )


def detail_pages(rows: DataFrame, url: Column, body: Column, source: Column | None = None) -> DataFrame:
    return rows.select(
        (F.col("source") if source is None else source).alias("source"), url.alias("url"), F.lit(0).alias("seq"), body.alias("body")
    ).filter(F.col("body").isNotNull())
