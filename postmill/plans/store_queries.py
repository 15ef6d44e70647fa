"""Queries over stored tables: updates by units, bucketed keys, checked writes, incremental statistics, runs in two phases, and keyword lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.functions.dates import format_instant, instant
from postmill.operators import incremental, runs, scoring, store
from postmill.operators.keywords import keyword_join
from postmill.plans import bindings as b
from postmill.plans.catalog import AS_OF, GROUPS, ORACLES, P, P2, R, UPDATES, VALID, _updates, iso, query
from postmill.plans.collection import start_runs
from postmill.schema import POSTING_STATUSES, POSTINGS
from postmill.session import scratch_dir
from postmill.sources.keys import key_index
from postmill.sources.tables import StoredTable, postings_table, rejected_table, run_events_table

# Orders come in commits by the hash of their number.
COMMITS = 4


def _commit_of(id_="id"):
    return F.pmod(F.xxhash64(id_), F.lit(COMMITS))


def _stored(spark, rows: DataFrame, table: StoredTable | None = None, after: Callable[[StoredTable], None] = lambda table: None) -> StoredTable:
    """The rows as a stored table of several commits; ``after`` is called behind each."""
    table = table or postings_table(spark, scratch_dir(spark, "stored"))
    for k in range(COMMITS):
        table.append(rows.filter(_commit_of() == k))
        after(table)
    return table


# --- updates by units ---------------------------------------------------------------------


@query("stored_status", ORACLES["apply_status"])
def stored_status(spark, sf):
    """apply_status on a stored table."""
    table, updates = _stored(spark, b.postings(spark, sf)), _updates(spark, sf)
    table.update(lambda rows: store.apply_status(rows, updates, instant(AS_OF)), store.validate(updates, store.status_rules())[0])
    return table.read().select("id", "status", format_instant("updated_at").alias("updated_at"))


@query("stored_scores", ORACLES["apply_scores"])
def stored_scores(spark, sf):
    """apply_scores on a stored table."""
    table, updates = _stored(spark, b.postings(spark, sf)), _updates(spark, sf)
    table.update(lambda rows: store.apply_scores(rows, updates, instant(AS_OF)), updates)
    return table.read().select("id", "score", "score_reason", "score_source")


@query("stored_delete", ORACLES["delete_by_id"])
def stored_delete(spark, sf):
    """delete_by_id on a stored table."""
    table = _stored(spark, b.postings(spark, sf))
    returned = b.table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    table.update(lambda rows: store.delete_by_id(rows, returned), returned)
    return table.read().select("id", "title")


@query("stored_cleanup", ORACLES["cleanup"])
def stored_cleanup(spark, sf):
    """The clean-up job on a stored table."""
    from postmill.plans.maintenance import run_cleanup

    table = _stored(spark, b.two_city_postings(spark, sf))
    run_cleanup(table, 30, instant(AS_OF))
    return table.read().select("id", "title", "company", "status", format_instant("updated_at").alias("updated_at"))


# --- keys in buckets, checked writes ------------------------------------------------------


@query("insert_bucketed", ORACLES["dedupe_insert_new"])
def insert_bucketed(spark, sf):
    """dedupe_insert_new with the stored half in a table whose keys lie in buckets."""
    stored, arriving = b.halves(spark, sf)
    table = _stored(spark, stored)
    new = store.new_postings(table.read(), arriving.withColumn("pos", F.col("id")), instant(AS_OF), ["pos"], key_index(table).near)
    return new.select(
        "dedupe_key", "title", "company", "location", "source", "url", "description", "date_posted", format_instant("date_collected").alias("date_collected"), "status"
    )


@query(
    "checked_append",
    P
    + """, q AS (SELECT id, dedupe_key, CASE WHEN id % 17 = 0 THEN 'exploded' ELSE status END AS status, CASE WHEN id % 13 = 0 THEN NULL ELSE title END AS title FROM p),
  m AS (SELECT *, id % 13 = 0 OR id % 17 = 0 AS broken FROM q),
  s AS (SELECT DISTINCT dedupe_key FROM m WHERE id % 4 = 0 AND NOT broken),
  k AS (SELECT *, row_number() OVER (PARTITION BY dedupe_key, broken ORDER BY id) AS n FROM m WHERE id % 4 <> 0),
  e AS (SELECT 'title is missing' AS error FROM m WHERE id % 13 = 0 UNION ALL SELECT 'bad status' FROM m WHERE id % 17 = 0
    UNION ALL SELECT 'dedupe_key repeats' FROM (SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY id) AS n FROM m WHERE id % 4 = 0 AND NOT broken) t WHERE n > 1
    UNION ALL SELECT CASE WHEN dedupe_key IN (SELECT dedupe_key FROM s) THEN 'dedupe_key is stored' WHEN n > 1 THEN 'dedupe_key repeats' ELSE '' END FROM k WHERE NOT broken
    UNION ALL SELECT '' FROM s)
  SELECT error, count(*) AS rows, (SELECT count(*) FROM s) + (SELECT count(*) FROM k WHERE n = 1 AND NOT broken AND dedupe_key NOT IN (SELECT dedupe_key FROM s)) AS stored,
    (SELECT count(*) FROM m) - (SELECT count(*) FROM s) - (SELECT count(*) FROM k WHERE n = 1 AND NOT broken AND dedupe_key NOT IN (SELECT dedupe_key FROM s)) AS rejected
  FROM e GROUP BY error""",
)
def checked_append(spark, sf):
    """Two batches, with rows of unknown status, without title, and with keys that repeat or are stored, are appended to a table that refuses them."""
    root = scratch_dir(spark, "checked")
    table = StoredTable(spark, f"{root}/postings", POSTINGS, ["source"], {"bad status": ~F.col("status").isin(*POSTING_STATUSES)})
    rejected = rejected_table(table)
    rows = b.postings(spark, sf).withColumns(
        {"status": F.when(F.col("id") % 17 == 0, "exploded").otherwise(F.col("status")), "title": F.when(F.col("id") % 13 != 0, F.col("title"))}
    )
    parts = []
    for k, batch in enumerate((rows.filter("id % 4 = 0"), rows.filter("id % 4 <> 0"))):
        parts.append(store.append_valid(table, batch, store.posting_rules(), rejected, near=key_index(table).near, token=f"batch:{k}"))
    counts = parts[0].unionAll(parts[1]).groupBy("error").agg(F.sum("rows").alias("rows"))
    return counts.withColumns({"stored": F.lit(table.read().count()), "rejected": F.lit(rejected.read().count())})


# --- incremental statistics ---------------------------------------------------------------


@query("incremental_duplicates", P2 + f", {GROUPS} SELECT id FROM ranked WHERE duplicate_rank > 1")
def incremental_duplicates(spark, sf):
    """Four appends, each followed by looking for duplicates in the groups that it touched."""
    table = postings_table(spark, scratch_dir(spark, "stored"))
    found = incremental.Duplicates(table, scratch_dir(spark, "duplicates"))
    _stored(spark, b.two_city_postings(spark, sf), table, lambda _: found.follow())
    return found.read()


@query("incremental_company_stats", ORACLES["stats_by_company"])
def incremental_company_stats(spark, sf):
    """Four appends, each folded into the statistics by company."""
    table = postings_table(spark, scratch_dir(spark, "stored"))
    stats = incremental.company_partials(table, scratch_dir(spark, "companies"))
    _stored(spark, b.postings(spark, sf), table, lambda _: stats.follow())
    return stats.read()


# --- runs in two phases -------------------------------------------------------------------


@query(
    "two_phase_runs",
    R
    + f""", s AS (SELECT DISTINCT source FROM r), n AS (SELECT source, row_number() OVER (ORDER BY source) AS id FROM s),
  e AS (SELECT source, count(*) AS jobs_found FROM r WHERE status <> 'running' GROUP BY source)
  SELECT id, n.source, '{AS_OF}' AS started_at, 'running' AS status, CAST(0 AS BIGINT) AS jobs_found FROM n WHERE n.source LIKE '%3'
  UNION ALL SELECT id, n.source, '{AS_OF}', 'ok', jobs_found FROM n JOIN e ON n.source = e.source WHERE n.source NOT LIKE '%3'""",
)
def two_phase_runs(spark, sf):
    """Every source starts; those whose name ends in 3 die before their end is committed, and read as running."""
    events = run_events_table(spark, scratch_dir(spark, "run-events"))
    past = b.runs(spark, sf)
    sources = past.select("source").distinct().withColumn("rank", F.col("source"))
    starts = start_runs(sources, events, instant(AS_OF))
    counts = runs.settled(past).groupBy("source").agg(F.count(F.lit(1)).alias("jobs_found"))
    ended = starts.drop("jobs_found").join(counts, "source").filter("source not like '%3'")
    ended = ended.withColumns({"finished_at": instant(AS_OF), "status": F.lit("ok"), "event_seq": F.lit(1).cast("long")})
    events.append(ended)
    return runs.fold_run_events(events.read()).select("id", "source", format_instant("started_at").alias("started_at"), "status", "jobs_found")


# --- scoring and keywords -----------------------------------------------------------------


def _many_scorer() -> Callable[[list[str]], list[str | None]]:
    """A stand-in for a model that takes many prompts: by title and location length. The first reply to a prompt may be none, the first call with some
    prompts fails, and some prompts never get a reply."""
    seen: set[str] = set()
    failed: set[tuple[str, ...]] = set()

    def score(prompts: list[str]) -> list[str | None]:
        import json

        replies = []
        for prompt in prompts:
            fields = dict(line.split(": ", 1) for line in prompt.split("\n")[:3])
            first = prompt not in seen
            seen.add(prompt)
            if len(fields["Title"]) % 3 == 1:
                replies.append(None)
            elif first and len(fields["Location"]) % 2 == 0:
                replies.append("not yet")
            else:
                replies.append(json.dumps({"score": len(fields["Location"]) % 10 + 1, "reason": f" {fields['Title']} in {fields['Location']} "}))
        if any(len(p) % 7 == 0 for p in prompts) and tuple(prompts) not in failed:
            failed.add(tuple(prompts))
            raise RuntimeError("no connection")
        return replies

    return score


@query("score_prompts", ORACLES["score_batch"])
def score_prompts(spark, sf):
    """As score_batch; companies are left out of the prompts' differences, so many postings share one, and calls fail and are repeated."""
    return scoring.score_prompts(b.postings(spark, sf).withColumn("company", F.lit("Acme")), _many_scorer(), tries=20)


KEYWORDS = r"""k AS (SELECT DISTINCT source, keyword FROM (
    SELECT source, regexp_extract(lower(text), '[a-z0-9]+ [a-z0-9]+') AS keyword FROM documents WHERE doc_id % 3 = 0
    UNION ALL SELECT source, regexp_extract(lower(text), '([a-z0-9]{9,})', 1) FROM documents WHERE doc_id % 2 = 0
    UNION ALL SELECT source, regexp_extract(lower(text), '[a-z]+\.\s[a-z]+') FROM documents WHERE doc_id % 7 = 0) t WHERE keyword <> '')"""


@query(
    "keyword_join",
    rf"""WITH {KEYWORDS}, d AS (SELECT doc_id, source, lower(text) AS t FROM documents)
  SELECT doc_id FROM d WHERE EXISTS (SELECT 1 FROM k WHERE k.source = d.source AND contains(t, keyword)
    AND regexp_matches(t, '(^|[^a-z0-9])' || regexp_escape(keyword) || '([^a-z0-9]|$)'))""",
)
def keyword_join_query(spark, sf):
    """Documents that name a keyword of their source; the lists are words, pairs of words and sentence ends of other documents, some hundreds a source."""
    docs = b.table(spark, sf, "documents").select("doc_id", "source", "text")
    low = F.lower("text")
    lists = [("doc_id % 3 = 0", "[a-z0-9]+ [a-z0-9]+"), ("doc_id % 2 = 0", "[a-z0-9]{9,}"), ("doc_id % 7 = 0", r"[a-z]+\.\s[a-z]+")]
    parts = [docs.filter(where).select("source", F.regexp_extract(low, pattern, 0).alias("keyword")) for where, pattern in lists]
    words = parts[0].unionAll(parts[1]).unionAll(parts[2]).filter("keyword <> ''").distinct()
    return keyword_join(docs, words, F.col("text"), "doc_id").select("doc_id")
