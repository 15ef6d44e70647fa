"""Hosted job boards with JSON APIs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.functions import dates, html, labels, text
from postmill.sources.common import allowed_locations, emit

GREENHOUSE = """jobs array<struct<title:string, absolute_url:string, location:struct<name:string>,
    updated_at:string, first_published:string, content:string>>"""
LEVER = """array<struct<text:string, hostedUrl:string, categories:struct<location:string>,
    createdAt:bigint, descriptionPlain:string>>"""
ASHBY = """jobs array<struct<title:string, jobUrl:string, applyUrl:string, location:string,
    secondaryLocations:array<struct<location:string>>, isRemote:boolean, publishedAt:string, descriptionPlain:string>>"""


def explode_entries(raw: DataFrame, entries) -> DataFrame:
    """One row per entry of a response, as ``job``, with its position."""
    return raw.select("*", F.posexplode(entries).alias("pos", "job")).drop("body")


def from_greenhouse(raw: DataFrame, details: DataFrame | None = None) -> DataFrame:
    jobs = explode_entries(raw, F.from_json("body", GREENHOUSE)["jobs"])
    location = text.clean_text("job.location.name")
    return emit(
        allowed_locations(jobs, location),
        title=text.clean_text("job.title"),
        location=location,
        url=F.col("job.absolute_url"),
        description=html.strip_html("job.content", decode_first=True),
        date_posted=dates.date_prefix(text.first_nonempty("job.updated_at", "job.first_published")),
    )


def from_lever(raw: DataFrame, details: DataFrame | None = None) -> DataFrame:
    # An object would be read as a list of one.
    jobs = explode_entries(raw.filter(F.col("body").rlike(r"^\s*\[")), F.from_json("body", LEVER))
    location = text.clean_text("job.categories.location")
    return emit(
        allowed_locations(jobs, location),
        title=text.clean_text("job.text"),
        location=location,
        url=F.col("job.hostedUrl"),
        description=text.clean_text("job.descriptionPlain"),
        date_posted=dates.iso_date(dates.epoch_ms_to_date("job.createdAt")),
    )


def from_ashby(raw: DataFrame, details: DataFrame | None = None) -> DataFrame:
    jobs = explode_entries(raw, F.from_json("body", ASHBY)["jobs"])
    jobs = jobs.withColumn(
        "_place",
        labels.combined_location(F.col("job.location"), F.col("job.secondaryLocations.location"), F.col("job.isRemote")),
    )
    return emit(
        allowed_locations(jobs, F.col("_place")),
        title=text.clean_text("job.title"),
        location=F.col("_place"),
        url=text.first_nonempty("job.jobUrl", "job.applyUrl"),
        description=text.clean_text("job.descriptionPlain"),
        date_posted=dates.date_prefix("job.publishedAt"),
    )
