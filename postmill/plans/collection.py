"""The collection job: landed responses of all sources to new postings and run records."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.operators.aggregates import collection_summary
from postmill.operators.dedupe import dedupe_by_url
from postmill.operators.filters import is_recent
from postmill.operators.joins import attach_source_dim
from postmill.operators.runs import fold_run_events, had_postings_recently, start_events, status_of
from postmill.operators.store import new_postings, with_new_ids
from postmill.schema import RUNS
from postmill.session import stage
from postmill.sources.common import ARRIVAL, COLUMNS
from postmill.sources.keys import key_index
from postmill.sources.registry import BOARD_PLATFORMS, JSON_KINDS, JSON_SHAPES, READERS, RENDERED_KINDS
from postmill.sources.tables import StoredTable


def kind_of(source: Column) -> Column:
    """The kind of a source: the platform of a board, else the source itself."""
    kind = source
    for platform in BOARD_PLATFORMS:
        kind = F.when(source.startswith(f"{platform}_"), F.lit(platform)).otherwise(kind)
    return kind


def source_failures(raw: DataFrame, with_details: bool = True) -> DataFrame:
    """(source, failure) for sources with a failed fetch, a body that is no JSON or JSON of a wrong shape, or pages that can't be read
    because no detail pages were given. The first failing response counts."""
    kind = kind_of(F.col("source"))
    parsed = raw.withColumn("_kind", kind).withColumn("_json", F.when(F.col("_kind").isin(*JSON_KINDS), F.try_parse_json("body")))
    right = F.lit(False)
    for shape, test in JSON_SHAPES.items():
        own = [k for k, s in JSON_KINDS.items() if s == shape]
        right = F.when(F.col("_kind").isin(*own), test(F.col("_json"))).otherwise(right)
    of_json = F.col("_kind").isin(*JSON_KINDS)
    failure = F.coalesce(
        F.col("error"),
        F.when(of_json & F.col("_json").isNull(), F.lit("ValueError: response is not JSON")),
        F.when(of_json & ~F.coalesce(right, F.lit(False)), F.lit("TypeError: response has another shape")),
        F.when(F.col("_kind").isin(*RENDERED_KINDS), F.lit(None if with_details else "LookupError: no detail pages given")),
    )
    found = parsed.select("source", "seq", failure.alias("failure")).filter("failure is not null")
    return found.groupBy("source").agg(F.min_by("failure", "seq").alias("failure"))


def _of_kinds(raw: DataFrame, kinds: list[str]) -> DataFrame:
    """Responses of some kinds; plain tests on `source`, so that the scan can skip row groups."""
    tests = [F.col("source").startswith(f"{k}_") for k in kinds if k in BOARD_PLATFORMS]
    singles = [k for k in kinds if k not in BOARD_PLATFORMS]
    return raw.filter(reduce(lambda a, b: a | b, tests, F.col("source").isin(*singles)))


def parse_sources(
    raw: DataFrame,
    sources: DataFrame,
    details: DataFrame | None = None,
    kinds: Iterable[str] | None = None,
    filter_keywords: bool = True,
) -> DataFrame:
    """Postings of all sources in one frame: read, keyword test, first posting per URL.

    ``kinds`` limits the readers to those in use; each reader scans the responses once, for all
    the kinds it serves.
    """
    known = attach_source_dim(raw.filter(F.col("error").isNull()), sources)
    served: dict = {}
    for kind in READERS if kinds is None else kinds:
        if kind in RENDERED_KINDS and details is None:
            continue
        served.setdefault(READERS[kind], []).append(kind)
    parts = []
    for reader, names in served.items():
        pages = None if details is None else _of_kinds(details, names)
        parts.append(reader(_of_kinds(known, names), pages).select(*COLUMNS))
    rows = reduce(DataFrame.unionByName, parts)
    if filter_keywords:
        rows = rows.filter("keyword_hit")
    return dedupe_by_url(rows).drop("keyword_hit")


@dataclass(frozen=True)
class Collected:
    """What one collection adds, and what it reports."""

    postings: DataFrame
    runs: DataFrame
    summary: DataFrame


def collect_all(
    raw: DataFrame,
    sources: DataFrame,
    stored: DataFrame,
    runs: DataFrame,
    as_of: Column,
    lookback_days: int = 30,
    details: DataFrame | None = None,
    kinds: Iterable[str] | None = None,
    filter_keywords: bool = True,
    started: DataFrame | None = None,
    near: Callable[[DataFrame], DataFrame] | None = None,
) -> Collected:
    """Read every source, keep recent postings, pick the new ones and record one run per source.

    A failing source yields an error run and no postings; the others go on. The source list, the
    parsed batch and the new rows are each written once, because several results use them. Runs
    have the ids of ``started(id, source)`` if that is given, else new ones.
    """
    cutoff = F.date_sub(F.to_date(as_of), lookback_days)
    # Staged as well: finding failures reads every response, and the source list is used often.
    state = stage(sources.join(source_failures(raw, details is not None), "source", "left"), "sources")
    healthy = state.filter(F.col("failure").isNull()).drop("failure")
    batch = stage(parse_sources(raw, healthy, details, kinds, filter_keywords), "batch")
    added = stage(new_postings(stored, batch.filter(is_recent(cutoff)), as_of, ARRIVAL, near), "added")

    found = batch.groupBy("source").agg(F.count(F.lit(1)).alias("jobs_found"))
    inserted = added.groupBy("source").agg(F.count(F.lit(1)).alias("jobs_inserted"))
    history = had_postings_recently(runs)
    per_source = (
        state.select("source", "rank", "failure")
        .join(found, "source", "left")
        .join(inserted, "source", "left")
        .join(history, "source", "left")
        .na.fill(0, ["jobs_found", "jobs_inserted"])
        .na.fill(False, ["had_postings"])
    )
    failed = F.col("failure").isNotNull()
    finished = per_source.withColumns(
        {
            "started_at": as_of,
            "finished_at": as_of,
            "status": status_of(F.col("jobs_found"), F.col("had_postings"), failed),
            "error_message": F.col("failure"),
        }
    )
    numbered = with_new_ids(finished, runs, ["rank"]) if started is None else finished.join(started.select("id", "source"), "source")
    new_runs = numbered.select(*RUNS.names)
    return Collected(added, new_runs, summary_of(state, batch, added, cutoff))


def summary_of(sources: DataFrame, batch: DataFrame, added: DataFrame, cutoff: Column) -> DataFrame:
    """(source, is_total, collected, skipped, undated, new): a line for every source, with or without postings, and one for the total."""
    counts = ("collected", "skipped", "undated", "new")
    found = collection_summary(batch, cutoff).filter("is_total = 0").drop("is_total", "new")
    new = added.groupBy("source").agg(F.count(F.lit(1)).alias("new"))
    lines = sources.select("source").join(found, "source", "left").join(new, "source", "left").na.fill(0, counts)
    total = lines.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts])
    each = lines.select("source", F.lit(0).alias("is_total"), *counts)
    return each.unionByName(total.select(F.lit(None).cast("string").alias("source"), F.lit(1).alias("is_total"), *counts))


def start_runs(sources: DataFrame, events: StoredTable, as_of: Column) -> DataFrame:
    """Commit a start event for every source, and return them."""
    known = events.read().select("id")
    starts = with_new_ids(sources.select("source", "rank", as_of.alias("started_at")), known, ["rank"])
    starts = stage(start_events(starts), "starts")
    events.append(starts)
    return starts


def run_collection(raw: DataFrame, sources: DataFrame, postings: StoredTable, events: StoredTable, as_of: Column, **options) -> Collected:
    """Collect and commit in two phases: every source's start before anything is read, then new postings, then the ends.

    A job that dies in between leaves its runs as ``running``, and so they read until somebody looks; the next job's runs are its own. Postings are tested
    against the table's key index.
    """
    past = stage(fold_run_events(events.read()), "past-runs")
    starts = start_runs(sources, events, as_of)
    result = collect_all(raw, sources, postings.read(), past, as_of, started=starts, near=key_index(postings).near, **options)
    ends = stage(result.runs.withColumn("event_seq", F.lit(1).cast("long")), "ends")
    postings.append(result.postings)
    events.append(ends)
    return Collected(result.postings, ends.drop("event_seq"), result.summary)
