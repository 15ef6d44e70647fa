"""Table changes as snapshot -> snapshot transforms."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions import text
from postmill.functions.dates import parse_instant
from postmill.operators.dedupe import except_stored, first_rows, flag_duplicates
from postmill.operators.filters import is_stale
from postmill.operators.ordering import numbered
from postmill.schema import POSTING_STATUSES, POSTINGS, REQUIRED, RUN_STATUSES, SCORE_SOURCES
from postmill.session import stage
from postmill.sources.tables import StoredTable


# --- validation ---------------------------------------------------------------------------


def posting_rules() -> dict[str, Column]:
    """Rule name -> condition that breaks it."""
    rules = {f"{c} is missing": F.col(c).isNull() for c in REQUIRED}
    rules["bad status"] = F.coalesce(~F.col("status").isin(*POSTING_STATUSES), F.lit(True))
    return rules


def score_rules() -> dict[str, Column]:
    return {
        "bad score source": F.coalesce(~F.col("source").isin(*SCORE_SOURCES), F.lit(True)),
        "score out of range": F.coalesce(~F.col("score").between(1, 10), F.lit(True)),
    }


def status_rules() -> dict[str, Column]:
    return {"bad status": F.coalesce(~F.col("status").isin(*POSTING_STATUSES), F.lit(True))}


def run_rules() -> dict[str, Column]:
    return {
        "source is missing": F.col("source").isNull(),
        "bad status": F.coalesce(~F.col("status").isin(*RUN_STATUSES), F.lit(True)),
    }


def with_errors(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    broken = F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()])
    return df.withColumn("errors", F.array_compact(broken))


def validate(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows breaking no rule, rejected rows with the names of the rules they break)."""
    checked = with_errors(df, rules)
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)


def append_valid(
    table: StoredTable, df: DataFrame, rules: dict[str, Column], rejected: StoredTable, key: str = "dedupe_key", order: Sequence[str] = ("id",),
    near: Callable[[DataFrame], DataFrame] | None = None, token: str | None = None,
) -> DataFrame:
    """Append the rows that break no rule and bring a new key, and keep the others, with what they break, in ``rejected``.

    Of rows that share a key the first in ``order`` that breaks no rule counts; the others repeat it. ``near`` gives the stored keys that the batch may
    meet. Both commits carry ``token``, so a batch that is written again adds nothing. Returns (error, rows), '' for the accepted ones.
    """
    marked = with_errors(df, rules)
    first = F.row_number().over(Window.partitionBy(key, F.size("errors") == 0).orderBy(*order)) == 1
    marked = stage(marked.withColumn("_first", first), "marked")
    sound = marked.filter("size(errors) = 0 and _first")
    stored = (table.read() if near is None else near(sound)).select(F.col(key).alias("_stored")).join(sound.select(F.col(key).alias("_stored")), "_stored", "left_semi").distinct()
    marked = marked.join(stored, marked[key] == stored["_stored"], "left")
    sound = F.size("errors") == 0
    more = F.when(sound & F.col("_stored").isNotNull(), F.array(F.lit(f"{key} is stored"))).when(sound & ~F.col("_first"), F.array(F.lit(f"{key} repeats")))
    marked = stage(marked.withColumn("errors", F.concat("errors", F.coalesce(more, F.array().cast("array<string>")))).select(*df.columns, "errors"), "checked")
    table.append(marked.filter("size(errors) = 0").drop("errors"), token)
    rejected.append(marked.filter("size(errors) > 0"), token)
    return marked.select(F.explode(F.when(F.size("errors") > 0, F.col("errors")).otherwise(F.array(F.lit("")))).alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("rows"))


# --- postings -----------------------------------------------------------------------------


def with_new_ids(df: DataFrame, stored: DataFrame, order: Sequence[str], name: str = "id") -> DataFrame:
    """Ids above every stored one, rising in ``order`` without gaps, so they last and stay dense."""
    top = stored.select(F.coalesce(F.max(name), F.lit(0)).alias("top")).scalar()
    placed = numbered(df.drop(name).orderBy(*order), "_place")
    return placed.withColumn(name, F.col("_place") + top).drop("_place")


def new_postings(
    stored: DataFrame, batch: DataFrame, as_of: Column, order: Sequence[str] = ("rank", "seq", "pos"), near: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """The rows a batch adds: complete rows, first per key within the batch, key not yet stored.

    ``near`` gives the stored keys that a batch may meet (see sources.keys); without it all keys of ``stored`` are read.
    """
    complete = batch.dropna(subset=list(REQUIRED)).withColumn("dedupe_key", text.dedupe_key("company", "title", "location"))
    # Staged, as both joins of the test read it.
    first = stage(first_rows(complete, ["dedupe_key"], order), "first")
    fresh = except_stored(first, stored if near is None else near(first))
    collected = F.col("date_collected")
    if dict(batch.dtypes)["date_collected"] == "string":
        collected = F.coalesce(parse_instant("date_collected"), as_of)
    values = {
        "date_collected": collected,
        "status": F.lit("new"),
        "score": F.lit(None),
        "score_reason": F.lit(None),
        "score_source": F.lit(None),
        "created_at": as_of,
        "updated_at": as_of,
    }
    with_ids = with_new_ids(fresh, stored, order)
    return with_ids.select(*[values.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in POSTINGS])


def insert_new(stored: DataFrame, batch: DataFrame, as_of: Column, order: Sequence[str] = ("rank", "seq", "pos")) -> DataFrame:
    return stored.unionByName(new_postings(stored, batch, as_of, order))


def apply_status(stored: DataFrame, updates: DataFrame, as_of: Column) -> DataFrame:
    """Set statuses from (id, status, seq); the last valid update per id wins."""
    valid, _ = validate(updates, status_rules())
    last = valid.groupBy("id").agg(F.max_by("status", "seq").alias("_status"))
    touched = F.col("_status").isNotNull()
    return (
        stored.join(last, "id", "left")
        .withColumn("status", F.coalesce("_status", "status"))
        .withColumn("updated_at", F.when(touched, as_of).otherwise(F.col("updated_at")))
        .select(*stored.columns)
    )


def apply_scores(stored: DataFrame, updates: DataFrame, as_of: Column, only_unscored: bool = True) -> DataFrame:
    """Set scores from (id, score, reason, source, seq).

    Manual scores always apply, the last one wins. An AI score applies only to a row without a
    score; with ``only_unscored=False`` it is treated like a manual one.
    """
    valid, _ = validate(updates, score_rules())
    change = F.struct("score", "reason", "source")
    manual = F.col("source") == "manual" if only_unscored else F.lit(True)
    folded = valid.groupBy("id").agg(
        F.max_by(F.when(manual, change), F.when(manual, F.col("seq"))).alias("_manual"),
        F.min_by(F.when(~manual, change), F.when(~manual, F.col("seq"))).alias("_ai"),
    )
    chosen = F.coalesce("_manual", F.when(F.col("score").isNull(), F.col("_ai")))
    hit = F.col("_change").isNotNull()
    return (
        stored.join(folded, "id", "left")
        .withColumn("_change", chosen)
        .withColumns(
            {
                "score": F.when(hit, F.col("_change.score")).otherwise(F.col("score")),
                "score_reason": F.when(hit, F.col("_change.reason")).otherwise(F.col("score_reason")),
                "score_source": F.when(hit, F.col("_change.source")).otherwise(F.col("score_source")),
                "updated_at": F.when(hit, as_of).otherwise(F.col("updated_at")),
            }
        )
        .select(*stored.columns)
    )


def delete_by_id(stored: DataFrame, ids: DataFrame) -> DataFrame:
    return stored.join(ids.select("id"), "id", "left_anti").select(*stored.columns)


def archive_stale(stored: DataFrame, days: int, as_of: Column) -> DataFrame:
    """Stale postings become 'ignored'."""
    old = is_stale(days, as_of)
    return stored.withColumns(
        {
            "status": F.when(old, F.lit("ignored")).otherwise(F.col("status")),
            "updated_at": F.when(old, as_of).otherwise(F.col("updated_at")),
        }
    )


def cleanup(stored: DataFrame, days: int, as_of: Column) -> DataFrame:
    """Delete duplicates, then archive what is stale among the rest. One shuffle of the table."""
    kept = flag_duplicates(stored).filter(~F.col("is_duplicate")).drop("is_duplicate")
    return archive_stale(kept, days, as_of)


def cleanup_report(stored: DataFrame, days: int, as_of: Column) -> DataFrame:
    """One row: duplicates and stale rows found before the clean-up, rows it deletes and archives."""
    old = is_stale(days, as_of)
    return flag_duplicates(stored).agg(
        F.count_if("is_duplicate").alias("duplicates_found"),
        F.count_if(old).alias("stale_found"),
        F.count_if("is_duplicate").alias("deleted"),
        F.count_if(old & ~F.col("is_duplicate")).alias("archived"),
    )


def rekey_legacy(stored: DataFrame) -> DataFrame:
    """Give two-part keys their location. On a collision the already migrated row wins, then the
    lowest id. Only legacy rows are shuffled; without any the table passes through."""
    # Staged, as it is read as the current rows, as the legacy rows and for the keys of both.
    stored = stage(stored, "rekey")
    legacy = text.count_substring("dedupe_key", "::") == 1
    current = stored.filter(~legacy)
    rekeyed = stored.filter(legacy).withColumn("dedupe_key", text.dedupe_key("company", "title", "location"))
    kept = except_stored(stage(first_rows(rekeyed, ["dedupe_key"], ["id"]), "rekeyed"), current)
    return current.unionByName(kept.select(*stored.columns))


def evolve_scores(stored: DataFrame) -> DataFrame:
    """Add missing score columns; rows already scored then count as scored by AI."""
    have = set(stored.columns)
    if "score" not in have:
        stored = stored.withColumn("score", F.lit(None).cast("int"))
    if "score_reason" not in have:
        stored = stored.withColumn("score_reason", F.lit(None).cast("string"))
    if "score_source" not in have:
        stored = stored.withColumn("score_source", F.when(F.col("score").isNotNull(), F.lit("ai")))
    return stored


# --- watchlist ----------------------------------------------------------------------------


def upsert_watchlist(watchlist: DataFrame, rows: DataFrame, as_of: Column) -> DataFrame:
    """Add or reactivate companies from (name, careers_url, seq); the last URL per name wins,
    a blank one clears it. Names are trimmed, case-sensitive, and must not be blank."""
    clean = (
        rows.select(text.strip("name").alias("name"), F.nullif(text.strip("careers_url"), F.lit("")).alias("url"), "seq")
        .filter(F.coalesce(F.col("name"), F.lit("")) != "")
        .groupBy("name")
        .agg(F.max_by(F.struct("url"), "seq").alias("_up"), F.min("seq").alias("_seq"))
    )
    touched = F.col("_up").isNotNull()
    known = watchlist.join(clean, "name", "left").select(
        "id",
        "name",
        F.when(touched, F.col("_up.url")).otherwise(F.col("careers_url")).alias("careers_url"),
        "added_at",
        F.when(touched, F.lit(True)).otherwise(F.col("active")).alias("active"),
    )
    added = with_new_ids(clean.join(watchlist, "name", "left_anti"), watchlist, ["_seq"]).select(
        "id", "name", F.col("_up.url").alias("careers_url"), as_of.alias("added_at"), F.lit(True).alias("active")
    )
    return known.unionByName(added)


def deactivate_watchlist(watchlist: DataFrame, names: DataFrame) -> DataFrame:
    gone = names.select("name").distinct().withColumn("_gone", F.lit(True))
    return (
        watchlist.join(gone, "name", "left")
        .withColumn("active", F.when(F.col("_gone"), F.lit(False)).otherwise(F.col("active")))
        .select(*watchlist.columns)
    )


def active_watchlist(watchlist: DataFrame) -> DataFrame:
    return watchlist.filter("active").orderBy(text.ascii_lower("name"))
