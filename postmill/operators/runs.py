"""Source runs: event folding, latest runs, yield history and run status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.operators.dedupe import first_rows
from postmill.operators.store import run_rules, validate

def _newest_first() -> list[Column]:
    return [F.desc("started_at"), F.desc("id")]


def start_events(runs: DataFrame) -> DataFrame:
    """Start events from (id, source, started_at)."""
    return runs.select(
        "id",
        "source",
        "started_at",
        F.lit(None).cast("timestamp").alias("finished_at"),
        F.lit("running").alias("status"),
        F.lit(0).cast("long").alias("jobs_found"),
        F.lit(0).cast("long").alias("jobs_inserted"),
        F.lit(None).cast("string").alias("error_message"),
        F.lit(0).cast("long").alias("event_seq"),
    )


def fold_run_events(events: DataFrame) -> DataFrame:
    """One row per run: the start's source and time, everything else from the last valid event."""
    valid, _ = validate(events, run_rules())
    latest = F.struct("finished_at", "status", "jobs_found", "jobs_inserted", "error_message")
    return (
        valid.groupBy("id")
        .agg(
            F.min_by("source", "event_seq").alias("source"),
            F.min_by("started_at", "event_seq").alias("started_at"),
            F.max_by(latest, "event_seq").alias("_last"),
        )
        .select("id", "source", "started_at", "_last.*")
    )


def latest_run_per_source(runs: DataFrame) -> DataFrame:
    return first_rows(runs, ["source"], _newest_first())


def settled(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("status") != "running")


def had_postings_recently(runs: DataFrame, n: int = 7) -> DataFrame:
    """Per source: did any of its last ``n`` finished runs find postings?"""
    recent = first_rows(settled(runs).select("source", "started_at", "id", "jobs_found"), ["source"], _newest_first(), n)
    return recent.groupBy("source").agg(F.bool_or(F.col("jobs_found") > 0).alias("had_postings"))


def recent_yield(runs: DataFrame, n: int = 7, chunk: str = "hour") -> DataFrame:
    """Every finished run with ``had_postings``: did the ``n`` finished runs before it find any?

    A source may own much of the table, so its history is cut into calendar chunks. Each chunk
    receives the ``n`` runs that precede it as carried rows; the frame of ``n`` preceding rows
    is then complete inside the chunk. Only ``n`` rows per chunk take part in finding them.
    """
    done = settled(runs).withColumn("_chunk", F.date_trunc(chunk, "started_at"))
    tails = first_rows(
        done.select("source", "_chunk", "started_at", "id", "jobs_found"), ["source", "_chunk"], _newest_first(), n
    )
    before = Window.partitionBy("source").orderBy("started_at", "id").rowsBetween(-n, -1)
    chunk_start = Window.partitionBy("source", "_chunk").orderBy("started_at", "id")
    carried = (
        tails.withColumn("_prior", F.collect_list("jobs_found").over(before))
        .withColumn("_at", F.row_number().over(chunk_start))
        .filter(F.col("_at") == 1)
        .select("source", "_chunk", F.posexplode("_prior").alias("_pos", "jobs_found"))
    )
    own = done.withColumns({"_carried": F.lit(False), "_pos": F.lit(None).cast("int")})
    both = own.unionByName(carried.withColumn("_carried", F.lit(True)), allowMissingColumns=True)
    in_order = Window.partitionBy("source", "_chunk").orderBy(F.desc("_carried"), "_pos", "started_at", "id")
    seen = F.max("jobs_found").over(in_order.rowsBetween(-n, -1))
    return (
        both.withColumn("had_postings", F.coalesce(seen > 0, F.lit(False)))
        .filter(~F.col("_carried"))
        .select(*runs.columns, "had_postings")
    )


def status_of(found: Column, had_postings: Column, failed: Column) -> Column:
    """error if the run failed; warning if it found nothing though recent runs did; else ok."""
    return F.when(failed, F.lit("error")).when((found == 0) & had_postings, F.lit("warning")).otherwise(F.lit("ok"))


def run_status(runs: DataFrame, n: int = 7, chunk: str = "hour") -> DataFrame:
    """Finished runs with the status their counts and history imply; failed runs count nothing."""
    failed = F.col("status") == "error"
    return (
        recent_yield(runs, n, chunk)
        .withColumn("derived_status", status_of(F.col("jobs_found"), F.col("had_postings"), failed))
        .withColumns(
            {c: F.when(failed, F.lit(0).cast("long")).otherwise(F.col(c)) for c in ("jobs_found", "jobs_inserted")}
        )
    )


def runs_since(runs: DataFrame, instant: Column) -> DataFrame:
    return runs.filter(F.col("started_at") >= instant).orderBy("started_at", "source", "id")


def since_midnight(runs: DataFrame, as_of: Column) -> DataFrame:
    """Runs since UTC midnight of ``as_of``, in no order."""
    return runs.filter(F.col("started_at") >= F.date_trunc("day", as_of))


def todays_runs(runs: DataFrame, as_of: Column) -> DataFrame:
    return since_midnight(runs, as_of).orderBy("source", "started_at", "id")


def failed_runs(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("status") == "error")


def problem_runs(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("status").isin("error", "warning"))


def run_health_counts(runs: DataFrame) -> DataFrame:
    return runs.agg(
        F.count_if(F.col("status") == "error").alias("failures"),
        F.count_if(F.col("status").isin("error", "warning")).alias("need_attention"),
    )
