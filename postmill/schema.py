"""Table schemas and the fixed value domains of their columns."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, t, null in fields])


# One landed response of a source. `seq` is the response's ordinal within its source
# (keyword by keyword, page by page); `error` carries the message of a failed fetch.
RAW = _struct(
    ("source", T.StringType(), False),
    ("url", T.StringType(), True),
    ("term", T.StringType(), True),
    ("fetched_at", T.StringType(), True),
    ("seq", T.LongType(), False),
    ("body", T.StringType(), True),
    ("error", T.StringType(), True),
)

POSTING_IN = _struct(
    ("title", T.StringType(), False),
    ("company", T.StringType(), False),
    ("location", T.StringType(), False),
    ("source", T.StringType(), False),
    ("url", T.StringType(), False),
    ("description", T.StringType(), False),
    ("date_posted", T.StringType(), True),
    ("date_collected", T.StringType(), False),
)

POSTINGS = _struct(
    ("id", T.LongType(), False),
    ("title", T.StringType(), False),
    ("company", T.StringType(), False),
    ("location", T.StringType(), False),
    ("source", T.StringType(), False),
    ("url", T.StringType(), False),
    ("description", T.StringType(), False),
    ("date_posted", T.StringType(), True),
    ("date_collected", T.TimestampType(), False),
    ("dedupe_key", T.StringType(), False),
    ("status", T.StringType(), False),
    ("score", T.IntegerType(), True),
    ("score_reason", T.StringType(), True),
    ("score_source", T.StringType(), True),
    ("created_at", T.TimestampType(), False),
    ("updated_at", T.TimestampType(), False),
)

RUNS = _struct(
    ("id", T.LongType(), False),
    ("source", T.StringType(), False),
    ("started_at", T.TimestampType(), False),
    ("finished_at", T.TimestampType(), True),
    ("status", T.StringType(), False),
    ("jobs_found", T.LongType(), False),
    ("jobs_inserted", T.LongType(), False),
    ("error_message", T.StringType(), True),
)

# A run's start (event_seq 0) and end (1); fold_run_events makes one row of them.
RUN_EVENTS = T.StructType([*RUNS.fields, T.StructField("event_seq", T.LongType(), False)])

WATCHLIST = _struct(
    ("id", T.LongType(), False),
    ("name", T.StringType(), False),
    ("careers_url", T.StringType(), True),
    ("added_at", T.TimestampType(), True),
    ("active", T.BooleanType(), False),
)

SOURCE_CONFIG = T.StructType(
    [
        T.StructField("name", T.StringType(), False),
        T.StructField("enabled", T.BooleanType(), True),
        T.StructField("keywords", T.ArrayType(T.StringType()), True),
        T.StructField(
            "boards",
            T.ArrayType(
                _struct(
                    ("slug", T.StringType(), True),
                    ("company", T.StringType(), True),
                    ("locations", T.ArrayType(T.StringType()), True),
                    ("keywords", T.ArrayType(T.StringType()), True),
                )
            ),
            True,
        ),
    ]
)

# Columns a stored posting must have; an incoming row lacking one is skipped.
REQUIRED = ("title", "company", "location", "source", "url", "description", "date_collected")

# Column domains and the default keyword list.
POSTING_STATUSES = ("new", "relevant", "ignored", "applied")
SCORE_SOURCES = ("ai", "manual")
RUN_STATUSES = ("running", "ok", "warning", "error")
DEFAULT_KEYWORDS = ("rag", "llm", "agent")
