"""Incremental ingest: landed files to new postings, exactly once per stored key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from postmill.operators.dedupe import first_rows
from postmill.operators.store import new_postings
from postmill.session import stage
from postmill.sources.keys import key_index
from postmill.sources.tables import StoredTable


def read_landing(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """Landed Parquet files as a stream; the file bound keeps each batch's size predictable."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def dedupe_stream(df: DataFrame, event_time: str, delay: str, keys: tuple[str, ...] = ("dedupe_key",)) -> DataFrame:
    """Drop repeats of a key within ``delay`` of event time, with state bounded by the delay.

    Rows that come later than the delay are dropped whether their key was seen or not, and a key that
    returns after its first sighting has left the state is a new one. Where no first sighting may be
    lost, use first_sightings_stream.
    """
    return df.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


def recent_sightings_stream(
    landed: DataFrame, out: StoredTable, checkpoint: str, keys: tuple[str, ...], event_time: str, delay: str, name: str = "recent"
) -> StreamingQuery:
    """Append one row of every key per ``delay`` of event time. The state store holds the keys of that span alone, whatever the table's size."""
    return _append(dedupe_stream(landed, event_time, delay, keys), out, checkpoint, name)


def _append(rows: DataFrame, out: StoredTable, checkpoint: str, name: str) -> StreamingQuery:
    """Append each batch's rows; the batch number is the commit's token, so a replayed batch adds nothing."""

    def save(batch: DataFrame, batch_id: int) -> None:
        out.append(batch, token=f"{name}:{batch_id}")

    return rows.writeStream.queryName(name).outputMode("append").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_stream(
    landed: DataFrame,
    to_postings: Callable[[DataFrame], DataFrame],
    postings: StoredTable,
    checkpoint: str,
    as_of: Column,
    order: tuple[str, ...] = ("rank", "seq", "pos"),
    name: str = "ingest",
) -> StreamingQuery:
    """Process all landed files in batches and append each batch's new postings.

    The batch number is the commit's token, so a batch replayed after a failure adds nothing. Keys are
    tested against the buckets of the table's key index that the batch's keys fall into.
    """

    def insert(batch: DataFrame, batch_id: int) -> None:
        rows = stage(to_postings(batch), f"{name}-batch")
        near = key_index(postings).near
        postings.append(new_postings(postings.read(), rows, as_of, order, near), token=f"{name}:{batch_id}")

    return (
        landed.writeStream.queryName(name)
        .foreachBatch(insert)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def first_sightings_stream(
    landed: DataFrame, out: StoredTable, checkpoint: str, keys: tuple[str, ...], order: tuple[str, ...], name: str = "first"
) -> StreamingQuery:
    """Append the first row of every key, in batch order, however late it comes: keys are tested against the stored ones of their buckets."""

    def insert(batch: DataFrame, batch_id: int) -> None:
        rows = stage(first_rows(batch, list(keys), list(order)), f"{name}-batch")
        out.append(key_index(out, keys).unseen(rows), token=f"{name}:{batch_id}")

    return landed.writeStream.queryName(name).foreachBatch(insert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_counts(runs: DataFrame) -> DataFrame:
    """Runs, errors and postings found per source and UTC day."""
    return (
        runs.groupBy(F.window("started_at", "1 day").alias("day"), "source")
        .agg(
            F.count(F.lit(1)).alias("runs"),
            F.count_if(F.col("status") == "error").alias("errors"),
            F.sum("jobs_found").alias("jobs_found"),
        )
        .select(F.col("day.start").alias("day"), "source", "runs", "errors", "jobs_found")
    )


CLOSED_DAYS = T.StructType(
    [
        T.StructField("day", T.TimestampType()),
        T.StructField("source", T.StringType()),
        T.StructField("runs", T.LongType()),
        T.StructField("errors", T.LongType()),
        T.StructField("jobs_found", T.LongType()),
    ]
)

DAILY_COUNTS = T.StructType(
    [
        T.StructField("day", T.TimestampType()),
        T.StructField("source", T.StringType()),
        T.StructField("runs", T.LongType()),
        T.StructField("errors", T.LongType()),
        T.StructField("jobs_found", T.LongType()),
        T.StructField("batch_id", T.LongType()),
    ]
)


def daily_counts_stream(runs: DataFrame, out: StoredTable, checkpoint: str) -> StreamingQuery:
    """Append each batch's counts of the days that it touches; read them with daily_totals.

    Counts add up, so a run counts however late it comes, and the stream holds no state between batches. The batch number is the
    commit's token, so a replayed batch is not counted twice.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        out.append(daily_counts(batch).withColumn("batch_id", F.lit(batch_id)), token=f"daily:{batch_id}")

    return runs.writeStream.queryName("daily").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def closed_days_stream(runs: DataFrame, out: StoredTable, checkpoint: str, delay: str, name: str = "closed-days") -> StreamingQuery:
    """Append the counts of each day and source once, when the watermark (``delay`` behind the latest start) has passed the day's end.

    The state holds open days only, one row a day and source. A run whose day was closed before it came is not counted here, but by late_counts_stream.
    """
    return _append(daily_counts(runs.withWatermark("started_at", delay)), out, checkpoint, name)


MARKS = T.StructType([T.StructField("latest", T.TimestampType()), T.StructField("batch_id", T.LongType())])


def late_counts_stream(runs: DataFrame, out: StoredTable, marks: StoredTable, checkpoint: str, delay: str, name: str = "late-days") -> StreamingQuery:
    """Append (day, source, runs, errors, jobs_found, batch_id) of the runs that came after their day was closed.

    The watermark of a batch is ``delay`` before the latest start of all batches before it. ``marks`` keeps that, one row a batch.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        # A replayed batch must not see its own mark.
        latest = marks.read().filter(F.col("batch_id") < batch_id).agg(F.max("latest")).first()[0]
        closed = F.lit(latest).cast("timestamp") - F.expr(f"interval {delay}")
        late = batch.filter(F.date_trunc("day", "started_at") + F.expr("interval 1 day") <= closed)
        out.append(daily_counts(late).withColumn("batch_id", F.lit(batch_id)), token=f"{name}:{batch_id}")
        marks.append(batch.agg(F.max("started_at").alias("latest")).withColumn("batch_id", F.lit(batch_id)), token=f"{name}:{batch_id}")

    return runs.writeStream.queryName(name).foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_totals(parts: DataFrame) -> DataFrame:
    """The counts of each day and source over all batches."""
    return parts.groupBy("day", "source").agg(*[F.sum(c).alias(c) for c in ("runs", "errors", "jobs_found")])
