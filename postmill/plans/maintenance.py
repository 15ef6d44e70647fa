"""Clean-up and scoring jobs over the stored tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.operators.aggregates import scoring_summary
from postmill.operators.dedupe import find_duplicates
from postmill.operators.filters import is_stale
from postmill.operators.scoring import score_batch
from postmill.operators.store import apply_scores, archive_stale, cleanup_report, delete_by_id
from postmill.session import stage
from postmill.sources.tables import StoredTable


def run_cleanup(postings: StoredTable, days: int, as_of: Column) -> DataFrame:
    """Report, then delete duplicates and archive stale postings, rewriting the units that hold them. Returns the report."""
    current = postings.read()
    report = stage(cleanup_report(current, days, as_of), "cleanup")
    doomed = stage(find_duplicates(current).select("id"), "doomed")
    old = current.filter(is_stale(days, as_of)).select("id")

    def clean(rows: DataFrame) -> DataFrame:
        return archive_stale(delete_by_id(rows, doomed), days, as_of)

    postings.update(clean, doomed.unionAll(old))
    return report


def run_scoring(postings: StoredTable, scorer: Callable[[str], str], as_of: Column) -> DataFrame:
    """Score the unscored postings and store the results. Returns the counts.

    Replies are written before they are used: a scorer may be slow, paid for, or not repeatable.
    """
    current = postings.read()
    results = stage(score_batch(current, scorer), "scores")
    updates = results.filter(F.col("score").isNotNull()).withColumn("seq", F.lit(0))
    postings.update(lambda rows: apply_scores(rows, updates, as_of), updates)
    return scoring_summary(results)
