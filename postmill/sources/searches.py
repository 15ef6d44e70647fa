"""Company search pages and APIs whose results are JSON, plain or embedded in HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import dates, html, labels, text
from postmill.operators.dedupe import first_rows
from postmill.operators.filters import drop_noisy_terms
from postmill.operators.joins import attach_details
from postmill.sources.boards import explode_entries
from postmill.sources.common import emit

AMAZON = """jobs array<struct<title:string, normalized_location:string, location:string, job_path:string,
    description:string, basic_qualifications:string, preferred_qualifications:string, posted_date:string>>"""
APPLE = """loaderData struct<search:struct<searchResults:array<struct<positionId:string, id:string,
    locations:array<struct<name:string>>, postDateInGMT:string, postingDate:string, postingTitle:string,
    transformedPostingTitle:string, jobSummary:string>>>>"""
ALLIANZ = """eagerLoadRefineSearch struct<data:struct<jobs:array<struct<jobId:string, reqId:string, title:string,
    cityStateCountry:string, location:string, applyUrl:string, descriptionTeaser:string, postedDate:string,
    dateCreated:string>>>>"""
PORSCHE = """SearchResult struct<SearchResultCountAll:bigint, SearchResultItems:array<struct<
    MatchedObjectDescriptor:struct<ID:string, PositionTitle:string, PositionURI:string,
    PositionLocation:array<struct<CityName:string, CountryName:string>>, PublicationStartDate:string>>>>"""

# Public URL shapes of the sites, and where their pages hold the result JSON.
AMAZON_BASE = "https://www.amazon.jobs"
APPLE_DETAILS = "https://jobs.apple.com/en-us/details/"
ALLIANZ_JOB = "https://careers.allianz.com/global/en/job/"
APPLE_STATE = r'(?s)window\.__staticRouterHydrationData = JSON\.parse\("(.*?)"\);'
ALLIANZ_STATE = r"(?s)phApp\.ddo\s*=\s*(\{.*?\});"


def from_amazon(raw: DataFrame, details: DataFrame | None = None) -> DataFrame:
    jobs = explode_entries(raw, F.from_json("body", AMAZON)["jobs"])
    texts = [F.coalesce(F.col(f"job.{f}"), F.lit("")) for f in ("description", "basic_qualifications", "preferred_qualifications")]
    return emit(
        jobs,
        title=text.clean_text("job.title"),
        location=text.clean_text(text.first_nonempty("job.normalized_location", "job.location")),
        url=F.concat(F.lit(AMAZON_BASE), F.coalesce("job.job_path", F.lit(""))),
        description=text.clean_text(F.concat_ws(" ", *texts)),
        date_posted=dates.iso_date(dates.parse_date_any("job.posted_date", dates.LONG_MONTH_FORMATS)),
    )


def _names(places: Column) -> Column:
    named = F.filter(places["name"], lambda n: F.coalesce(n, F.lit("")) != "")
    return F.coalesce(F.array_join(F.transform(named, text.clean_text), "; "), F.lit(""))


def from_apple(raw: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """Result state is a JSON document inside a JSON string inside the page; pages without
    readable state give no rows."""
    state = html.json_unescape(html.embedded_json("body", APPLE_STATE))
    jobs = explode_entries(raw, F.from_json(state, APPLE)["loaderData"]["search"]["searchResults"])
    job_id = F.split_part(F.coalesce(text.first_nonempty("job.positionId", "job.id"), F.lit("")), F.lit("-"), F.lit(1))
    return emit(
        jobs.filter(job_id != ""),
        title=text.clean_text(text.first_nonempty("job.postingTitle", "job.transformedPostingTitle")),
        location=_names(F.col("job.locations")),
        url=F.concat(F.lit(APPLE_DETAILS), job_id),
        description=text.clean_text("job.jobSummary"),
        date_posted=dates.date_prefix(text.first_nonempty("job.postDateInGMT", "job.postingDate")),
    )


def from_allianz(raw: DataFrame, details: DataFrame | None = None) -> DataFrame:
    state = html.embedded_json("body", ALLIANZ_STATE)
    jobs = explode_entries(raw, F.from_json(state, ALLIANZ)["eagerLoadRefineSearch"]["data"]["jobs"])
    job_id = F.coalesce(text.first_nonempty("job.jobId", "job.reqId"), F.lit(""))
    return emit(
        jobs.filter(job_id != ""),
        title=text.clean_text("job.title"),
        location=text.clean_text(text.first_nonempty("job.cityStateCountry", "job.location")),
        url=text.first_nonempty("job.applyUrl", F.concat(F.lit(ALLIANZ_JOB), job_id)),
        description=text.clean_text("job.descriptionTeaser"),
        date_posted=dates.date_prefix(text.first_nonempty("job.postedDate", "job.dateCreated")),
    )


def from_porsche(raw: DataFrame, details: DataFrame | None = None, max_results: int | None = None) -> DataFrame:
    """One response per search term; the first row per id counts. The description is the text of
    the detail page, '' without one. With ``max_results``, terms that matched more are dropped
    whole; ``noisy_terms`` counts what that leaves out.
    """
    result = raw.withColumn("_result", F.from_json("body", PORSCHE)["SearchResult"]).drop("body")
    result = result.withColumn("_total", F.col("_result.SearchResultCountAll"))
    precise = result if max_results is None else drop_noisy_terms(result, max_results, "_total")
    items = precise.select("*", F.posexplode("_result.SearchResultItems").alias("pos", "_item")).drop("_result")
    jobs = items.withColumn("job", F.col("_item.MatchedObjectDescriptor")).drop("_item")
    jobs = jobs.withColumns({"_id": F.coalesce("job.ID", F.lit("")), "url": F.coalesce("job.PositionURI", F.lit(""))})
    unique = first_rows(jobs.filter((F.col("_id") != "") & (F.col("url") != "")), ["source", "_id"], ["seq", "pos"])
    full = _with_details(unique, details)
    return emit(
        full,
        title=text.clean_text("job.PositionTitle"),
        location=F.coalesce(labels.city_country(F.col("job.PositionLocation")), F.lit("")),
        url=F.col("url"),
        description=html.strip_html("detail_html", drop=("noscript",)),
        date_posted=F.col("job.PublicationStartDate"),
    )


def _with_details(df: DataFrame, details: DataFrame | None) -> DataFrame:
    if details is None:
        return df.withColumn("detail_html", F.lit(None).cast("string"))
    return attach_details(df, details)
