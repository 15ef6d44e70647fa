"""Queries that run a stream over the test tables to its end and return what it stored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postmill.functions.dates import format_instant, instant
from postmill.plans import bindings as b
from postmill.plans.catalog import AS_OF, P, PRIOR, R, iso, query
from postmill.session import scratch_dir
from postmill.sources.tables import StoredTable, postings_table
from postmill.streaming import health, ingest


def _in_slices(spark: SparkSession, rows: DataFrame, piece: Column, pieces: int, name: str, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """Land ``rows`` slice by slice in the order of ``piece``, and run the stream to its end after each, so that there are as many batches."""
    folder = scratch_dir(spark, name)
    for k in range(pieces):
        rows.filter(piece == k).write.mode("append").parquet(folder)
        start(ingest.read_landing(spark, folder, rows.schema)).awaitTermination()


def _by_range(rows: DataFrame, c: str, pieces: int) -> Column:
    """Equal ranges of a number or instant."""
    number = F.col(c).cast("double")
    low, high = rows.agg(F.min(number), F.max(number)).first()
    width = max((high or 0.0) - (low or 0.0), 1.0) * (1 + 1e-9)
    return F.floor((number - (low or 0.0)) / width * pieces)


def _with_late(piece: Column, pieces: int) -> Column:
    """Every tenth row comes in a slice of its own behind the others."""
    return F.when(F.col("id") % 10 == 0, pieces).otherwise(piece)


@query(
    "stream_ingest",
    P + " SELECT dedupe_key, source, date_posted FROM (SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY id) AS k FROM p) t WHERE k = 1",
)
def stream_ingest(spark, sf):
    """Postings land by id range in four batches: the first of each key stays."""
    rows = b.postings(spark, sf).withColumns({"rank": F.lit(0), "seq": F.lit(0), "pos": F.col("id")})
    table, check = postings_table(spark, scratch_dir(spark, "postings")), scratch_dir(spark, "checkpoint")
    _in_slices(spark, rows, _by_range(rows, "id", 4), 4, "landed", lambda d: ingest.ingest_stream(d, lambda x: x, table, check, instant(AS_OF)))
    return table.read().select("dedupe_key", "source", "date_posted")


@query(
    "stream_dedupe",
    """SELECT user_id, event_type, event_id AS id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 10 = 0, event_id) AS k FROM events) t
    WHERE k = 1""",
)
def stream_dedupe(spark, sf):
    """The first event of each user and type, over four batches; the last has only events that come late, some of them first sightings."""
    events = b.table(spark, sf, "events").select("user_id", "event_type", F.col("event_id").alias("id"))
    out = StoredTable(spark, scratch_dir(spark, "unique"), events.schema)
    check, piece = scratch_dir(spark, "checkpoint"), _with_late(_by_range(events, "id", 3), 3)
    _in_slices(spark, events, piece, 4, "events", lambda d: ingest.first_sightings_stream(d, out, check, ("user_id", "event_type"), ("id",)))
    return out.read()


@query(
    "stream_daily",
    R + f""" SELECT {iso("date_trunc('day', started_at)")} AS day, source, count(*) AS runs, count(*) FILTER (WHERE status = 'error') AS errors,
    CAST(sum(jobs_found) AS BIGINT) AS jobs_found FROM r GROUP BY 1, 2""",
)
def stream_daily(spark, sf):
    """Daily counts over four batches, the last of runs that come late."""
    rows = b.runs(spark, sf)
    table, check = StoredTable(spark, scratch_dir(spark, "daily"), ingest.DAILY_COUNTS), scratch_dir(spark, "checkpoint")
    _in_slices(spark, rows, _with_late(_by_range(rows, "started_at", 3), 3), 4, "runs", lambda d: ingest.daily_counts_stream(d, table, check))
    return ingest.daily_totals(table.read()).withColumn("day", format_instant("day"))


JUDGED_RUNS = (
    R
    + f""", done AS (SELECT * FROM r WHERE status <> 'running'),
  judged AS (SELECT *, {PRIOR} AS prior FROM done WHERE id % 10 <> 0 UNION ALL SELECT * FROM (SELECT *, {PRIOR} AS prior FROM done) t WHERE id % 10 = 0)
  SELECT id, source, coalesce(prior > 0, false) AS had_postings, CASE WHEN status = 'error' THEN 'error'
    WHEN jobs_found = 0 AND coalesce(prior > 0, false) THEN 'warning' ELSE 'ok' END AS derived_status FROM judged"""
)


def _judged(spark, sf):
    """Runs land in time order in three batches, each judged with the runs before it; every tenth comes late, in a fourth."""
    rows = b.runs(spark, sf)
    root, check = scratch_dir(spark, "health"), scratch_dir(spark, "checkpoint")
    judged, tail = StoredTable(spark, f"{root}/judged", health.JUDGED), StoredTable(spark, f"{root}/tail", health.TAIL)
    piece = _with_late(_by_range(rows, "started_at", 3), 3)
    _in_slices(spark, rows, piece, 4, "runs", lambda d: health.run_health_stream(d, judged, tail, check))
    return judged.read().select("id", "source", "had_postings", "derived_status")


@query("stream_health", JUDGED_RUNS)
def stream_health(spark, sf):
    return _judged(spark, sf)


@query("stream_late", JUDGED_RUNS + " WHERE id % 10 = 0")
def stream_late(spark, sf):
    """The runs that came late."""
    return _judged(spark, sf).filter("id % 10 = 0")


@query(
    "stream_dedupe_watermark",
    """WITH e AS (SELECT user_id, event_type, event_id, date_diff('day', (SELECT min(ts)::DATE FROM events), ts::DATE) // 5 AS piece FROM events),
    k AS (SELECT DISTINCT user_id, event_type, piece FROM e WHERE NOT (event_id % 10 = 0 AND piece < 3)),
    f AS (SELECT user_id, event_type, min(piece) AS piece FROM k GROUP BY user_id, event_type)
    SELECT * FROM f UNION ALL SELECT k.user_id, k.event_type, min(k.piece) FROM k JOIN f USING (user_id, event_type) WHERE k.piece >= f.piece + 4 GROUP BY k.user_id, k.event_type""",
)
def stream_dedupe_watermark(spark, sf):
    """Events land in six batches of five days, the time of an event being its day. A key stays in the state for seven days and a quarter behind the latest
    event: it is dropped in the next three batches and comes again from the fourth on. Every tenth event of the first fifteen days lands three batches
    late and is dropped, whether its key is known or not."""
    events = b.table(spark, sf, "events").select("user_id", "event_type", "event_id", F.date_trunc("day", F.col("ts").cast("timestamp")).alias("at"))
    first = events.agg(F.min("at")).first()[0]
    events = events.withColumn("piece", F.floor(F.datediff("at", F.lit(first)) / 5))
    lands = F.when((F.col("event_id") % 10 == 0) & (F.col("piece") < 3), F.col("piece") + 3).otherwise(F.col("piece"))
    out = StoredTable(spark, scratch_dir(spark, "recent"), events.schema)
    check = scratch_dir(spark, "checkpoint")
    _in_slices(spark, events, lands, 6, "events", lambda d: ingest.recent_sightings_stream(d, out, check, ("user_id", "event_type"), "at", "174 hours"))
    return out.read().select("user_id", "event_type", "piece")


@query(
    "stream_window_daily",
    R + f""", w AS (SELECT max(started_at) FILTER (WHERE id % 10 <> 0) - INTERVAL 2 DAY AS closed FROM r)
    SELECT {iso("date_trunc('day', started_at)")} AS day, source, id % 10 = 0 AS late, count(*) AS runs, count(*) FILTER (WHERE status = 'error') AS errors,
    CAST(sum(jobs_found) AS BIGINT) AS jobs_found FROM r, w WHERE date_trunc('day', started_at) + INTERVAL 1 DAY <= closed GROUP BY 1, 2, 3""",
)
def stream_window_daily(spark, sf):
    """Counts of closed days, each written once, and apart from them counts of the runs that came after their day was closed, over four batches."""
    rows, root = b.runs(spark, sf), scratch_dir(spark, "days")
    closed, late = StoredTable(spark, f"{root}/closed", ingest.CLOSED_DAYS), StoredTable(spark, f"{root}/late", ingest.DAILY_COUNTS)
    marks = StoredTable(spark, f"{root}/marks", ingest.MARKS)

    def start(landed):
        ingest.closed_days_stream(landed, closed, f"{root}/check-closed", "2 days").awaitTermination()
        return ingest.late_counts_stream(landed, late, marks, f"{root}/check-late", "2 days")

    _in_slices(spark, rows, _with_late(_by_range(rows, "started_at", 3), 3), 4, "runs", start)
    found = closed.read().withColumn("late", F.lit(False)).unionByName(ingest.daily_totals(late.read()).withColumn("late", F.lit(True)))
    return found.withColumn("day", format_instant("day"))


@query(
    "stream_health_state",
    R
    + f""", done AS (SELECT *, id % 10 = 0 AS last_slice FROM r WHERE status <> 'running'),
  w AS (SELECT max(started_at) - INTERVAL 1 DAY AS mark FROM done WHERE NOT last_slice),
  judged AS (SELECT *, {PRIOR} AS prior FROM done WHERE NOT last_slice
    UNION ALL SELECT * FROM (SELECT done.*, {PRIOR} AS prior FROM done, w WHERE NOT last_slice OR started_at > mark) t WHERE last_slice
    UNION ALL SELECT t.* FROM (SELECT *, {PRIOR} AS prior FROM done) t, w WHERE last_slice AND started_at <= mark)
  SELECT id, source, coalesce(prior > 0, false) AS had_postings, CASE WHEN status = 'error' THEN 'error'
    WHEN jobs_found = 0 AND coalesce(prior > 0, false) THEN 'warning' ELSE 'ok' END AS derived_status FROM judged""",
)
def stream_health_state(spark, sf):
    """Runs land as in stream_health and are judged with keyed state, each source and day being a key. Of those that land last, the ones behind the
    watermark are older than the state, and are judged behind the others."""
    rows, root = b.runs(spark, sf), scratch_dir(spark, "health-states")
    judged, edges = StoredTable(spark, f"{root}/judged", health.VERDICTS), StoredTable(spark, f"{root}/edges", health.EDGES)
    piece = _with_late(_by_range(rows, "started_at", 3), 3)

    def start(landed):
        health.run_health_states(landed, judged, edges, f"{root}/check", chunk="1 day", delay="1 day").awaitTermination()
        return health.late_runs_stream(landed, judged, edges, f"{root}/check-late", chunk="1 day")

    _in_slices(spark, rows, piece, 4, "runs", start)
    return judged.read().select("id", "source", "had_postings", "derived_status")
