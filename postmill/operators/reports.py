"""Datasets people read: daily summary, alerts, health, cards and the posting view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.labels import status_label
from postmill.functions.text import ascii_lower, html_escape
from postmill.operators.filters import list_postings, order_export, top_scoring
from postmill.operators.joins import attach_connections, watchlist_stats
from postmill.operators.runs import failed_runs, latest_run_per_source, problem_runs, since_midnight

# Report lines sort by these columns; text keys are '' and ids 0 where they do not apply.
LINE_ORDER = ("section", "source", "at", "id", "line_no")


def _lines(df: DataFrame, section: int, line: Column, line_no: Column | int = 0, source="", at="", id=0) -> DataFrame:
    def col(v, kind):
        return (v if isinstance(v, Column) else F.lit(v)).cast(kind)

    return df.select(
        F.lit(section).alias("section"),
        col(source, "string").alias("source"),
        col(at, "string").alias("at"),
        col(id, "long").alias("id"),
        col(line_no, "int").alias("line_no"),
        line.alias("line"),
    )


def _plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, F.lit("")).otherwise(F.lit("s")))


def _run_line() -> Column:
    failed = F.concat(F.lit("[FAILED] "), "source", F.lit(": "), F.coalesce("error_message", F.lit("None")))
    empty = F.concat(F.lit("[WARN 0 jobs] "), "source", F.lit(": returned no jobs despite recent successful runs"))
    counts = F.format_string("[OK] %s: %d found, %d new", "source", "jobs_found", "jobs_inserted")
    return F.when(F.col("status") == "error", failed).when(F.col("status") == "warning", empty).otherwise(counts)


def summary_subject(runs: DataFrame, as_of: Column, title: str = "Daily summary") -> DataFrame:
    """One row with the subject; today's failures are appended if there are any."""
    return since_midnight(runs, as_of).agg(F.count_if(F.col("status") == "error").alias("_n")).select(
        F.concat(
            F.lit(title),
            F.when(F.col("_n") > 0, F.concat(F.lit(" - "), _plural(F.col("_n"), "collector failure"))).otherwise(""),
        ).alias("subject")
    )


def daily_summary(
    postings: DataFrame, runs: DataFrame, as_of: Column, new: int, scored: int, title: str = "Daily summary"
) -> DataFrame:
    """The summary's lines with their sort keys: head, the five best postings, today's runs."""
    spark = postings.sparkSession
    head = [title, "", f"New jobs collected today: {new}", f"Jobs scored: {scored}", "", "Top 5 highest scoring jobs:"]
    parts = [_lines(spark.range(1), 1, F.lit(text), i) for i, text in enumerate(head)]

    # Five rows at most from here on: one array of them gives each its place.
    best = F.struct("score", "date_collected", "id", "title", "company", "url")
    top = top_scoring(postings, 5).agg(F.sort_array(F.collect_list(best), asc=False).alias("top"))
    ranked = top.select(F.posexplode("top").alias("place", "p")).select("place", "p.*")
    texts = F.array(
        F.format_string("%d. %s - %s", F.col("place") + 1, "title", "company"),
        F.format_string("   Score: %d/10", "score"),
        F.concat(F.lit("   URL: "), "url"),
    )
    lines = ranked.select("place", F.posexplode(texts).alias("n", "text"))
    parts.append(_lines(lines, 2, F.col("text"), F.col("place") * 3 + F.col("n")))
    parts.append(_lines(top.filter(F.size("top") == 0), 2, F.lit("No scored jobs found.")))

    today = since_midnight(runs, as_of)
    some = today.limit(1)
    parts.append(_lines(some, 3, F.lit(""), 0))
    parts.append(_lines(some, 3, F.lit("Collector health (today's runs):"), 1))
    started = F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    parts.append(_lines(today, 4, _run_line(), 0, F.col("source"), started, F.col("id")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy(*LINE_ORDER)


def failure_alert(runs: DataFrame, as_of: Column) -> DataFrame:
    """Lines for today's failed runs, led by a count; no rows when nothing failed."""
    failed = failed_runs(since_midnight(runs, as_of))
    count = failed.agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 0)
    started = F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return (
        _lines(count, 1, F.concat(F.lit("ALERT - "), _plural(F.col("_n"), "collector failure")))
        .unionByName(_lines(failed, 2, _run_line(), 0, F.col("source"), started, F.col("id")))
        .orderBy(*LINE_ORDER)
    )


def collection_health(runs: DataFrame) -> DataFrame:
    """Latest run per source with a display label."""
    return (
        latest_run_per_source(runs)
        .select(
            status_label("status").alias("label"),
            "source",
            F.col("started_at").alias("last_run"),
            "jobs_found",
            "jobs_inserted",
            F.coalesce("error_message", F.lit("")).alias("error"),
        )
        .orderBy("source")
    )


def health_banner(runs: DataFrame) -> DataFrame:
    """One row: how many sources need attention after their latest run."""
    n = F.col("_n")
    text = F.when(n > 0, F.concat(n.cast("string"), F.lit(" collector(s) need attention"))).otherwise("all collectors healthy")
    return problem_runs(latest_run_per_source(runs)).agg(F.count(F.lit(1)).alias("_n")).select(n.alias("problems"), text.alias("banner"))


def render_cards(postings: DataFrame) -> DataFrame:
    """(id, card): one escaped HTML card per posting, in export order."""
    posted = F.when(F.coalesce("date_posted", F.lit("")) == "", F.lit("Unknown date")).otherwise(F.col("date_posted"))
    meta = F.concat_ws(" | ", html_escape("company"), html_escape("location"), F.concat(F.lit("Posted: "), html_escape(posted)))
    score = F.when(F.col("score").isNotNull(), F.format_string('<div class="score">Score: %d/10</div>', "score"))
    reason = F.when(
        F.coalesce("score_reason", F.lit("")) != "",
        F.concat(F.lit('<p class="reason">'), html_escape("score_reason"), F.lit("</p>")),
    )
    card = F.concat(
        F.lit('<article class="card"><h2>'), html_escape("title"), F.lit('</h2><p class="meta">'), meta, F.lit("</p>"),
        F.coalesce(score, F.lit("")), F.coalesce(reason, F.lit("")),
        F.lit('<a href="'), html_escape("url"), F.lit('">Open job posting</a></article>'),
    )
    return order_export(postings.withColumn("card", card)).select("id", "card")


EMPTY_CARD = '<p class="empty">No jobs found.</p>'


def cards_or_notice(postings: DataFrame) -> DataFrame:
    """The cards, or a single notice when there are none."""
    cards = render_cards(postings).select("card")
    notice = postings.select("id").limit(1).agg(F.count("id").alias("_n")).filter("_n = 0").select(F.lit(EMPTY_CARD).alias("card"))
    return cards.unionByName(notice)


def watchlist_report(watchlist: DataFrame, postings: DataFrame) -> DataFrame:
    """Active companies with their posting statistics, blanks for what is missing."""
    stats = watchlist_stats(watchlist.filter("active"), postings).orderBy(ascii_lower("name"))
    return stats.select(
        "name",
        F.coalesce("careers_url", F.lit("")).alias("careers_url"),
        "total_jobs",
        F.coalesce("latest_job_date", F.lit("")).alias("latest_job_date"),
        F.coalesce(F.col("top_score").cast("string"), F.lit("")).alias("top_score"),
    )


def postings_view(postings: DataFrame, connections: DataFrame, **options) -> DataFrame:
    """The posting list with contacts and display texts; takes the options of list_postings.

    Filters come first, then the contact lookup, and the sort last, so that the lookup's
    shuffle (if its size asks for one) cannot undo the order.
    """
    sort_by = options.pop("sort_by", "newest")
    unsorted = attach_connections(list_postings(postings, sort_by=sort_by, **options), connections)
    origin = F.when(F.col("score_source") == "manual", F.lit("manual")).otherwise(F.lit("AI"))
    view = unsorted.withColumns(
        {
            "score_text": F.when(F.col("score").isNotNull(), F.format_string("%d/10 (%s)", "score", origin)),
            "posted_text": F.when(F.coalesce("date_posted", F.lit("")) == "", F.lit("Unknown")).otherwise(F.col("date_posted")),
        }
    )
    return list_postings(view, sort_by=sort_by)
