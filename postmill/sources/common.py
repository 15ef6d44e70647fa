"""Shared shape of the payload readers.

A reader takes landed responses (schema RAW plus company, locations, keyword_pattern and rank of
their source) and returns postings with their arrival order: `rank` of the source, `seq` of the
response, `pos` inside it. `keyword_hit` says whether the posting names a keyword of its source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import text
from postmill.operators.filters import posting_text

ARRIVAL = ("rank", "seq", "pos")
COLUMNS = (
    "title", "company", "location", "source", "url", "description", "date_posted", "date_collected",
    *ARRIVAL, "keyword_hit",
)


def emit(
    df: DataFrame,
    *,
    title: Column,
    location: Column,
    url: Column,
    description: Column,
    date_posted: Column | None = None,
    keyword_text: Column | None = None,
) -> DataFrame:
    """Project a reader's fields to the common columns."""
    tested = posting_text() if keyword_text is None else F.col("_keyword_text")
    named = df.select(
        *("source", "company", "keyword_pattern", *ARRIVAL),
        F.col("fetched_at").alias("date_collected"),
        text.computed(
            title=title,
            location=location,
            url=F.coalesce(url, F.lit("")),
            description=description,
            date_posted=F.lit(None).cast("string") if date_posted is None else date_posted,
            **({} if keyword_text is None else {"_keyword_text": keyword_text}),
        ),
    )
    return named.withColumn("keyword_hit", text.matches_pattern(tested, "keyword_pattern")).select(*COLUMNS)


def allowed_locations(df: DataFrame, location: Column) -> DataFrame:
    """Keep rows whose location is on their source's list (an empty or missing list keeps all)."""
    return df.filter(text.matches_location(location, F.col("locations")))
