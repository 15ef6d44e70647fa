"""Named queries over the test tables, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions import dates, html, labels, text
from postmill.functions.dates import format_instant, instant
from postmill.operators import aggregates, dedupe, filters, joins, reports, scoring, store
from postmill.operators import runs as run_ops
from postmill.operators.ordering import numbered
from postmill.operators.skew import lookup_join
from postmill.plans import bindings as b
from postmill.session import scratch_dir
from postmill.sources.tables import write_cards

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

AS_OF = "2001-06-01T00:00:00Z"
RUNS_AS_OF = "2024-01-10T12:00:00Z"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, run with UTC as the session zone, and its SQL counterpart."""

    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return build(spark, sf)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def norm(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"


P = f"""WITH p0 AS (
  SELECT o_orderkey AS id, o_orderpriority AS title,
    CASE WHEN o_orderkey % 3 = 0 THEN upper(c_name) ELSE '  ' || c_name || ' ' END AS company,
    n_name AS location, lower(c_mktsegment) AS source,
    'https://x.example/' || (o_orderkey % 12000) AS url,
    o_orderpriority || ' ' || c_mktsegment AS description,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN 'not-a-date'
         ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date_posted,
    o_orderdate + to_days(CAST(o_orderkey % 40 AS INTEGER)) AS date_collected,
    CASE o_orderstatus WHEN 'P' THEN 'new' WHEN 'F' THEN 'ignored' ELSE 'applied' END AS status,
    CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(1 + floor(o_totalprice / 50000) AS INTEGER) END AS score,
    o_orderdate, c_custkey, c_name, c_mktsegment, o_totalprice
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
), p AS (
  SELECT *, {norm('company')} || '::' || {norm('title')} || '::' || {norm('location')} AS dedupe_key,
    CASE WHEN score IS NOT NULL AND id % 5 <> 0 THEN 'band "' || score || '" & more' END AS score_reason,
    CASE WHEN score IS NOT NULL THEN CASE WHEN id % 2 = 0 THEN 'manual' ELSE 'ai' END END AS score_source
  FROM p0
)"""

R = """WITH r AS (
  SELECT event_id AS id, 'src' || (user_id % 20) AS source, date_trunc('second', ts) AS started_at,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'running' ELSE 'ok' END AS status,
    CAST(greatest(0, floor(value) - 100) AS BIGINT) AS jobs_found,
    CAST(floor(greatest(0, floor(value) - 100) / 2) AS BIGINT) AS jobs_inserted,
    CASE WHEN event_type = 'error' THEN props END AS error_message
  FROM events
)"""


# The same with every fifth posting in another place.
P2 = P.replace("n_name AS location", "CASE WHEN o_orderkey % 5 = 0 THEN 'Remote' ELSE n_name END AS location")


def iso(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%dT%H:%M:%SZ')"


# The text SQL reads as a date: ten characters in dashed form.
POSTED = "CASE WHEN regexp_full_match(left(date_posted, 10), '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN try_cast(left(date_posted, 10) AS DATE) END"
GROUPS = """d AS (
  SELECT lower(trim(title)) AS nt, lower(trim(company)) AS nc, count(*) AS n FROM p GROUP BY 1, 2
  HAVING count(*) > 1 AND count(DISTINCT dedupe_key) > 1
), ranked AS (
  SELECT p.*, row_number() OVER (PARTITION BY lower(trim(title)), lower(trim(company)) ORDER BY id) AS duplicate_rank
  FROM p JOIN d ON lower(trim(title)) = nt AND lower(trim(company)) = nc
)"""


# --- storing and duplicates ---------------------------------------------------------------


@query(
    "dedupe_insert_new",
    P
    + f""" SELECT dedupe_key, title, company, location, source, url, description, date_posted,
    {iso('date_collected')} AS date_collected, 'new' AS status
  FROM (SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY id) AS k FROM p WHERE id % 2 = 1) t
  WHERE k = 1 AND dedupe_key NOT IN (SELECT dedupe_key FROM p WHERE id % 2 = 0)""",
)
def dedupe_insert_new(spark, sf):
    stored, arriving = b.halves(spark, sf)
    new = store.new_postings(stored, arriving.withColumn("pos", F.col("id")), instant(AS_OF), ["pos"])
    return new.select(
        "dedupe_key", "title", "company", "location", "source", "url", "description", "date_posted",
        format_instant("date_collected").alias("date_collected"), "status",
    )


@query(
    "new_except",
    P + " SELECT id, dedupe_key FROM p WHERE id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM p q WHERE q.id % 2 = 0 AND q.dedupe_key = p.dedupe_key)",
)
def new_except(spark, sf):
    stored, arriving = b.halves(spark, sf)
    return dedupe.except_stored(arriving.select("id", "dedupe_key"), stored)


@query(
    "url_dedupe",
    P + " SELECT id, source, url FROM (SELECT *, row_number() OVER (PARTITION BY source, url ORDER BY id) AS k FROM p) t WHERE k = 1",
)
def url_dedupe(spark, sf):
    rows = b.postings(spark, sf).select("id", "source", "url")
    return dedupe.dedupe_by_url(rows, ["id"])


@query("duplicate_groups", P2 + f", {GROUPS} SELECT nt AS normalized_title, nc AS normalized_company, n AS rows FROM d")
def duplicate_groups(spark, sf):
    return dedupe.duplicate_groups(b.two_city_postings(spark, sf))


@query("find_duplicates", P2 + f", {GROUPS} SELECT id, title, company, duplicate_rank FROM ranked WHERE duplicate_rank > 1")
def find_duplicates(spark, sf):
    found = dedupe.find_duplicates(b.two_city_postings(spark, sf).select("id", "title", "company", "dedupe_key"))
    return dedupe.order_duplicates(found).select("id", "title", "company", "duplicate_rank")


OLD = "status = 'new' AND date_collected < TIMESTAMP '2001-06-01' - INTERVAL 30 DAY"


@query(
    "cleanup",
    P2
    + f""", {GROUPS} SELECT id, title, company, CASE WHEN {OLD} THEN 'ignored' ELSE status END AS status,
    CASE WHEN {OLD} THEN '{AS_OF}' ELSE {iso('date_collected')} END AS updated_at
  FROM p WHERE id NOT IN (SELECT id FROM ranked WHERE duplicate_rank > 1)""",
)
def cleanup(spark, sf):
    kept = store.cleanup(b.two_city_postings(spark, sf), 30, instant(AS_OF))
    return kept.select("id", "title", "company", "status", format_instant("updated_at").alias("updated_at"))


@query(
    "cleanup_report",
    P2
    + f""", {GROUPS}, x AS (SELECT id FROM ranked WHERE duplicate_rank > 1)
  SELECT (SELECT count(*) FROM x) AS duplicates_found, (SELECT count(*) FROM p WHERE {OLD}) AS stale_found,
    (SELECT count(*) FROM x) AS deleted,
    (SELECT count(*) FROM p WHERE {OLD} AND id NOT IN (SELECT id FROM x)) AS archived""",
)
def cleanup_report(spark, sf):
    return store.cleanup_report(b.two_city_postings(spark, sf), 30, instant(AS_OF))


@query("archive_stale", P + f" SELECT id, CASE WHEN {OLD} THEN 'ignored' ELSE status END AS status FROM p")
def archive_stale(spark, sf):
    return store.archive_stale(b.postings(spark, sf), 30, instant(AS_OF)).select("id", "status")


@query(
    "order_stale",
    P + f" SELECT id, {iso('date_collected')} AS date_collected, row_number() OVER (ORDER BY p.date_collected, id) AS position FROM p WHERE {OLD}",
)
def order_stale(spark, sf):
    rows = numbered(filters.order_stale(filters.stale(b.postings(spark, sf), 30, instant(AS_OF))))
    return rows.select("id", format_instant("date_collected").alias("date_collected"), "position")


@query("delete_by_id", P + " SELECT id, title FROM p WHERE id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def delete_by_id(spark, sf):
    returned = b.table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return store.delete_by_id(b.postings(spark, sf).select("id", "title"), returned)


@query(
    "rekey_legacy",
    P
    + f""", legacy AS (SELECT * FROM p WHERE id % 2 = 1),
  current_rows AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY id) k FROM p WHERE id % 2 = 0) t WHERE k = 1)
  SELECT id, dedupe_key FROM current_rows
  UNION ALL
  SELECT id, dedupe_key FROM (SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY id) k FROM legacy) t
  WHERE k = 1 AND dedupe_key NOT IN (SELECT dedupe_key FROM current_rows)""",
)
def rekey_legacy(spark, sf):
    stored, odd = b.halves(spark, sf)
    current = dedupe.first_rows(stored, ["dedupe_key"], ["id"])
    two_parts = F.concat_ws("::", text.normalize_text("company"), text.normalize_text("title"))
    legacy = odd.withColumn("dedupe_key", two_parts)
    return store.rekey_legacy(current.unionByName(legacy)).select("id", "dedupe_key")


@query("evolve_scores", P + " SELECT id, score, CAST(NULL AS VARCHAR) AS score_reason, CASE WHEN score IS NOT NULL THEN 'ai' END AS score_source FROM p")
def evolve_scores(spark, sf):
    old = b.postings(spark, sf).drop("score_reason", "score_source")
    return store.evolve_scores(old).select("id", "score", "score_reason", "score_source")


# Events act as updates of the order whose key is the event's id modulo the order count.
UPDATES = """u AS (
  SELECT CAST(user_id * 7 + event_id % 40 AS BIGINT) AS id, event_id AS seq,
    CASE event_type WHEN 'click' THEN 'relevant' WHEN 'view' THEN 'ignored' WHEN 'purchase' THEN 'applied' ELSE event_type END AS status,
    CAST(floor(value / 4) AS INTEGER) AS score, props AS reason,
    CASE event_type WHEN 'click' THEN 'manual' WHEN 'error' THEN 'robot' ELSE 'ai' END AS source
  FROM events)"""


def _updates(spark, sf):
    kind = F.col("event_type")
    return b.table(spark, sf, "events").select(
        (F.col("user_id") * 7 + F.col("event_id") % 40).alias("id"),
        F.col("event_id").alias("seq"),
        F.when(kind == "click", "relevant").when(kind == "view", "ignored").when(kind == "purchase", "applied").otherwise(kind).alias("status"),
        F.floor(F.col("value") / 4).cast("int").alias("score"),
        F.col("props").alias("reason"),
        F.when(kind == "click", "manual").when(kind == "error", "robot").otherwise("ai").alias("source"),
    )


VALID = "status IN ('new', 'relevant', 'ignored', 'applied')"


@query(
    "apply_status",
    P
    + f""", {UPDATES}, last AS (SELECT id, arg_max(status, seq) AS s FROM u WHERE {VALID} GROUP BY id)
  SELECT p.id, coalesce(s, p.status) AS status, CASE WHEN s IS NOT NULL THEN '{AS_OF}' ELSE {iso('date_collected')} END AS updated_at
  FROM p LEFT JOIN last ON p.id = last.id""",
)
def apply_status(spark, sf):
    changed = store.apply_status(b.postings(spark, sf), _updates(spark, sf), instant(AS_OF))
    return changed.select("id", "status", format_instant("updated_at").alias("updated_at"))


@query(
    "apply_scores",
    P
    + f""", {UPDATES}, v AS (SELECT * FROM u WHERE source IN ('ai', 'manual') AND score BETWEEN 1 AND 10),
  m AS (SELECT id, arg_max(score, seq) AS score, arg_max(reason, seq) AS reason FROM v WHERE source = 'manual' GROUP BY id),
  a AS (SELECT id, arg_min(score, seq) AS score, arg_min(reason, seq) AS reason FROM v WHERE source = 'ai' GROUP BY id)
  SELECT p.id,
    CASE WHEN m.id IS NOT NULL THEN m.score WHEN p.score IS NULL AND a.id IS NOT NULL THEN a.score ELSE p.score END AS score,
    CASE WHEN m.id IS NOT NULL THEN m.reason WHEN p.score IS NULL AND a.id IS NOT NULL THEN a.reason ELSE p.score_reason END AS score_reason,
    CASE WHEN m.id IS NOT NULL THEN 'manual' WHEN p.score IS NULL AND a.id IS NOT NULL THEN 'ai' ELSE p.score_source END AS score_source
  FROM p LEFT JOIN m ON p.id = m.id LEFT JOIN a ON p.id = a.id""",
)
def apply_scores(spark, sf):
    changed = store.apply_scores(b.postings(spark, sf), _updates(spark, sf), instant(AS_OF))
    return changed.select("id", "score", "score_reason", "score_source")


@query(
    "validate",
    f"""WITH {UPDATES} SELECT seq, array_to_string(list_filter([
    CASE WHEN source NOT IN ('ai', 'manual') THEN 'bad score source' END,
    CASE WHEN score NOT BETWEEN 1 AND 10 THEN 'score out of range' END,
    CASE WHEN NOT ({VALID}) THEN 'bad status' END], lambda x: x IS NOT NULL), '; ') AS errors
  FROM u WHERE source NOT IN ('ai', 'manual') OR score NOT BETWEEN 1 AND 10 OR NOT ({VALID})""",
)
def validate(spark, sf):
    _, rejected = store.validate(_updates(spark, sf), {**store.score_rules(), **store.status_rules()})
    return rejected.select("seq", F.array_join("errors", "; ").alias("errors"))


@query(
    "table_roundtrip",
    P + f" SELECT id, title, company, source, date_posted, {iso('date_collected')} AS date_collected, score FROM p",
)
def table_roundtrip(spark, sf):
    """One half replaces the (empty) table, the other is appended, and both are read back."""
    from postmill.sources.tables import postings_table

    stored, arriving = b.halves(spark, sf)
    table = postings_table(spark, scratch_dir(spark, "roundtrip"))
    table.replace(stored)
    table.append(arriving)
    return table.read().select("id", "title", "company", "source", "date_posted", format_instant("date_collected").alias("date_collected"), "score")


@query(
    "watchlist_upsert",
    """WITH w AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 4 <> 0 THEN 'https://c.example/' || c_custkey END AS careers_url,
      c_custkey % 10 <> 0 AS active FROM customer),
    u AS (SELECT trim(name) AS name, nullif(trim(url), '') AS url, seq FROM (
      SELECT ' ' || CASE WHEN o_orderkey % 9 = 0 THEN 'New ' || o_custkey WHEN o_orderkey % 9 = 1 THEN '' ELSE c_name END || ' ' AS name,
        CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE 'https://n.example/' || o_orderkey END AS url, o_orderkey AS seq
      FROM orders JOIN customer ON o_custkey = c_custkey) t),
    l AS (SELECT name, arg_max({'url': url}, seq).url AS url FROM u WHERE name <> '' GROUP BY name)
    SELECT coalesce(w.name, l.name) AS name, CASE WHEN l.name IS NOT NULL THEN l.url ELSE w.careers_url END AS careers_url,
      CASE WHEN l.name IS NOT NULL THEN true ELSE w.active END AS active, w.name IS NULL AS added
    FROM w FULL JOIN l ON w.name = l.name""",
)
def watchlist_upsert(spark, sf):
    key = F.col("o_orderkey")
    rows = b.table(spark, sf, "orders").join(b.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    name = F.when(key % 9 == 0, F.concat(F.lit("New "), "o_custkey")).when(key % 9 == 1, "").otherwise(F.col("c_name"))
    rows = rows.select(
        F.concat(F.lit(" "), name, F.lit(" ")).alias("name"),
        F.when(key % 5 == 0, " ").otherwise(F.concat(F.lit("https://n.example/"), key)).alias("careers_url"),
        key.alias("seq"),
    )
    out = store.upsert_watchlist(b.watchlist(spark, sf), rows, instant(AS_OF))
    added = F.col("added_at") == instant(AS_OF)
    return out.select("name", "careers_url", "active", added.alias("added"))


@query(
    "watchlist_deactivate",
    """SELECT c_custkey AS id, c_name AS name FROM customer
    WHERE c_custkey % 10 <> 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""",
)
def watchlist_deactivate(spark, sf):
    big = b.table(spark, sf, "orders").filter("o_totalprice > 400000")
    names = big.join(b.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_name").alias("name"))
    return store.active_watchlist(store.deactivate_watchlist(b.watchlist(spark, sf), names)).select("id", "name")


# --- filters, lists and aggregates --------------------------------------------------------


@query(
    "lookback_summary",
    P
    + f""", q AS (SELECT source, {POSTED} AS d, id FROM p)
  SELECT source, CAST(GROUPING(source) AS INTEGER) AS is_total, count(*) AS collected,
    count(*) FILTER (WHERE d < DATE '1997-01-01') AS skipped, count(*) FILTER (WHERE d IS NULL) AS undated,
    count(*) FILTER (WHERE id % 2 = 1) AS new
  FROM q GROUP BY ROLLUP (source)""",
)
def lookback_summary(spark, sf):
    cutoff = F.lit("1997-01-01").cast("date")
    return aggregates.collection_summary(b.postings(spark, sf), cutoff, F.col("id") % 2 == 1)


@query("within_lookback", P + f" SELECT id, date_posted FROM p WHERE {POSTED} IS NULL OR {POSTED} >= DATE '1997-01-01'")
def within_lookback(spark, sf):
    return filters.within_lookback(b.postings(spark, sf).select("id", "date_posted"), F.lit("1997-01-01").cast("date"))


WORDS = ("the", "und", "que")


@query(
    "keyword_filter",
    """SELECT doc_id, n_chars FROM documents
    WHERE regexp_matches(source || ' ' || lang || ' ' || text, '(?i)(^|[^a-z0-9])(the|und|que)([^a-z0-9]|$)')""",
)
def keyword_filter(spark, sf):
    docs = b.table(spark, sf, "documents").select(
        "doc_id", "n_chars", F.col("source").alias("title"), F.col("lang").alias("location"), F.col("text").alias("description")
    )
    return filters.keyword_filter(docs, WORDS).select("doc_id", "n_chars")


@query(
    "location_filter",
    P
    + """ SELECT id, source, location FROM p WHERE length(source) % 5 = 0
    OR EXISTS (SELECT 1 FROM nation WHERE n_regionkey = length(source) % 5 AND contains(lower(location), lower(n_name)))""",
)
def location_filter(spark, sf):
    """Each source allows the places of one region (names match as substrings); the sources of
    region 0 have an empty list and allow everything."""
    places = b.table(spark, sf, "nation").groupBy("n_regionkey").agg(F.collect_set("n_name").alias("locations"))
    names = b.table(spark, sf, "customer").select(F.lower("c_mktsegment").alias("source")).distinct()
    allowed = F.when(F.col("n_regionkey") == 0, F.array().cast("array<string>")).otherwise(F.col("locations"))
    dim = names.join(places, F.length("source") % 5 == F.col("n_regionkey"), "left").select("source", allowed.alias("locations"))
    rows = lookup_join(b.postings(spark, sf).select("id", "source", "location"), dim, ["source"], "id", "inner")
    return filters.location_filter(rows, F.col("locations")).select("id", "source", "location")


NEWEST = ", row_number() OVER (ORDER BY date_collected DESC, id DESC) AS position"


@query("list_postings_newest", P + f" SELECT id, title, status, score{NEWEST} FROM p WHERE status = 'new' AND score >= 3")
def list_postings_newest(spark, sf):
    return numbered(filters.list_postings(b.postings(spark, sf), status="new", min_score=3)).select("id", "title", "status", "score", "position")


@query(
    "list_postings_score",
    P + " SELECT id, source, score, row_number() OVER (ORDER BY score DESC NULLS LAST, date_collected DESC, id DESC) AS position FROM p WHERE source = 'building'",
)
def list_postings_score(spark, sf):
    rows = filters.list_postings(b.postings(spark, sf), source="building", sort_by="score", min_score=1)
    return numbered(rows).select("id", "source", "score", "position")


@query(
    "list_postings_keyword",
    P + f""" SELECT id, title, company{NEWEST} FROM p WHERE lower(title) LIKE '%medium%b_ild%' OR lower(company) LIKE '%medium%b_ild%'
    OR lower(location) LIKE '%medium%b_ild%' OR lower(description) LIKE '%medium%b_ild%'""",
)
def list_postings_keyword(spark, sf):
    return numbered(filters.list_postings(b.postings(spark, sf), keyword="Medium%b_ILD")).select("id", "title", "company", "position")


@query(
    "filter_values",
    P + " SELECT DISTINCT 'source' AS field, source AS value FROM p UNION SELECT 'status', status FROM p UNION SELECT 'company', company FROM p",
)
def filter_values(spark, sf):
    return aggregates.filter_values(b.postings(spark, sf))


@query("company_stats", P + " SELECT count(*) AS total_jobs, max(date_posted) AS latest_job_date, max(score) AS top_score FROM p WHERE lower(company) = 'customer#000000042'")
def company_stats(spark, sf):
    return aggregates.company_stats(b.postings(spark, sf), "CUSTOMER#000000042")


@query("stats_by_company", P + " SELECT lower(company) AS company_key, count(*) AS total_jobs, max(date_posted) AS latest_job_date, max(score) AS top_score FROM p GROUP BY 1")
def stats_by_company(spark, sf):
    return aggregates.stats_by_company(b.postings(spark, sf))


@query(
    "field_quality",
    P
    + """, s AS (SELECT lower(c_mktsegment) AS source FROM customer UNION SELECT lower(s_name) FROM supplier),
  q AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE coalesce(location, '') = '') AS l,
      count(*) FILTER (WHERE coalesce(date_posted, '') = '') AS d, count(*) FILTER (WHERE length(description) < 200) AS c FROM p GROUP BY 1)
  SELECT s.source, coalesce(n, 0) AS rows, coalesce(l, 0) AS missing_location, coalesce(d, 0) AS missing_date,
    coalesce(c, 0) AS short_description, coalesce(n, 0) > 0 AS ok FROM s LEFT JOIN q ON s.source = q.source""",
)
def field_quality(spark, sf):
    names = b.table(spark, sf, "customer").select(F.lower("c_mktsegment").alias("source"))
    silent = b.table(spark, sf, "supplier").select(F.lower("s_name").alias("source"))
    return aggregates.field_quality(b.postings(spark, sf), names.union(silent))


@query("count_postings", P + " SELECT count(*) AS total FROM p")
def count_postings(spark, sf):
    return aggregates.count_postings(b.postings(spark, sf))


@query(
    "preview",
    P
    + """ SELECT id, source, title, more FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY id) AS k,
    greatest(count(*) OVER (PARTITION BY source) - 10, 0) AS more FROM p) t WHERE k <= 10""",
)
def preview(spark, sf):
    return aggregates.preview(b.postings(spark, sf), 10, ["id"]).select("id", "source", "title", "more")


@query(
    "cap_per_source",
    P + " SELECT id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY id) AS k FROM p) t WHERE k <= 60",
)
def cap_per_source(spark, sf):
    return dedupe.cap_per_source(b.postings(spark, sf).select("id", "source"), 60, ["id"])


@query("top_scoring", P + " SELECT id, title, company, score, url FROM p WHERE score IS NOT NULL ORDER BY score DESC, date_collected DESC, id DESC LIMIT 5")
def top_scoring(spark, sf):
    return filters.top_scoring(b.postings(spark, sf)).select("id", "title", "company", "score", "url")


@query("unscored", P + f" SELECT id, title{NEWEST} FROM p WHERE score IS NULL")
def unscored(spark, sf):
    return numbered(filters.order_newest(filters.unscored(b.postings(spark, sf)))).select("id", "title", "position")


@query(
    "export_order",
    P + " SELECT id, title, score, date_posted, row_number() OVER (ORDER BY score DESC NULLS LAST, coalesce(date_posted, '') DESC, id DESC) AS position FROM p",
)
def export_order(spark, sf):
    return numbered(filters.order_export(b.postings(spark, sf))).select("id", "title", "score", "date_posted", "position")


ESCAPED = "replace(replace(replace({0}, '&', '&amp;'), '\"', '&quot;'), '''', '&#x27;')"


@query(
    "render_cards",
    P
    + f""" SELECT id, '<article class="card"><h2>' || {ESCAPED.format('title')} || '</h2><p class="meta">' || {ESCAPED.format('company')} || ' | '
    || {ESCAPED.format('location')} || ' | Posted: ' || coalesce(date_posted, 'Unknown date') || '</p>'
    || coalesce('<div class="score">Score: ' || score || '/10</div>', '')
    || coalesce('<p class="reason">' || {ESCAPED.format('score_reason')} || '</p>', '')
    || '<a href="' || {ESCAPED.format('url')} || '">Open job posting</a></article>' AS card FROM p""",
)
def render_cards(spark, sf):
    return reports.render_cards(b.postings(spark, sf))


@query("written_cards", ORACLES["render_cards"].replace(" SELECT id, '<article", " SELECT count(*) OVER () AS written, '<article"))
def written_cards(spark, sf):
    """The cards' file, read back line by line, with the number that writing reported."""
    path = scratch_dir(spark, "cards")
    written = write_cards(reports.render_cards(b.postings(spark, sf)), path)
    return spark.read.text(path).select(F.lit(written).alias("written"), F.col("value").alias("card"))


@query(
    "watchlist_report",
    P
    + """, s AS (SELECT lower(company) AS k, count(*) AS n, max(date_posted) AS d, max(score) AS t FROM p GROUP BY 1)
  SELECT c_name AS name, CASE WHEN c_custkey % 4 <> 0 THEN 'https://c.example/' || c_custkey ELSE '' END AS careers_url,
    coalesce(n, 0) AS total_jobs, coalesce(d, '') AS latest_job_date, coalesce(CAST(t AS VARCHAR), '') AS top_score
  FROM customer LEFT JOIN s ON lower(c_name) = k WHERE c_custkey % 10 <> 0""",
)
def watchlist_report(spark, sf):
    return reports.watchlist_report(b.watchlist(spark, sf), b.postings(spark, sf))


CONTACTS = """c AS (
  SELECT regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') AS company_key,
    CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'Person ' || c_custkey || CASE
      WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN ' (peer - ' || c_mktsegment || ')'
      WHEN c_custkey % 2 = 0 THEN ' (peer)' WHEN c_custkey % 3 = 0 THEN ' (' || c_mktsegment || ')' ELSE '' END END AS person,
    CASE WHEN c_custkey % 5 = 0 THEN 'ask first' ELSE '' END AS notes
  FROM customer WHERE c_custkey % 4 <> 3),
k AS (SELECT company_key, CASE WHEN person <> '' AND notes <> '' THEN person || ' | ' || notes WHEN person <> '' THEN person
    WHEN notes <> '' THEN notes ELSE 'company is on your local list; no contacts yet' END AS connection FROM c)"""
JOINED = "LEFT JOIN k ON regexp_replace(lower(company), '[^a-z0-9]+', '', 'g') = company_key"


@query("attach_connections", P + f", {CONTACTS} SELECT id, company, connection FROM p {JOINED}")
def attach_connections(spark, sf):
    return joins.attach_connections(b.postings(spark, sf).select("id", "company"), b.connections(spark, sf))


@query(
    "postings_view",
    P
    + f""", {CONTACTS} SELECT id, title, company, connection,
    score || '/10 (' || CASE WHEN score_source = 'manual' THEN 'manual' ELSE 'AI' END || ')' AS score_text,
    coalesce(date_posted, 'Unknown') AS posted_text FROM p {JOINED} WHERE status = 'applied'""",
)
def postings_view(spark, sf):
    view = reports.postings_view(b.postings(spark, sf), b.connections(spark, sf), status="applied", sort_by="score")
    return view.select("id", "title", "company", "connection", "score_text", "posted_text")


@query(
    "recent_local",
    P
    + """ SELECT id, location, date_posted FROM p WHERE id % 11 <> 0 AND id % 13 <> 0 AND o_orderdate >= DATE '2001-06-01' - 700
    AND (contains(lower(location), 'nation_1') OR contains(lower(location), '_7'))""",
)
def recent_local(spark, sf):
    rows = b.postings(spark, sf).select("id", "location", "date_posted")
    return filters.accept_recent_local(rows, 700, ("nation_1", "_7"), F.lit("2001-06-01").cast("date"))


# --- runs and reports ---------------------------------------------------------------------


@query(
    "latest_run",
    R + f""" SELECT id, source, {iso('started_at')} AS started_at, status, jobs_found FROM (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY started_at DESC, id DESC) AS k FROM r) t WHERE k = 1""",
)
def latest_run(spark, sf):
    latest = run_ops.latest_run_per_source(b.runs(spark, sf))
    return latest.select("id", "source", format_instant("started_at").alias("started_at"), "status", "jobs_found")


PRIOR = """max(jobs_found) OVER (PARTITION BY source ORDER BY started_at, id ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"""


@query("recent_yield", R + f" SELECT id, source, coalesce({PRIOR} > 0, false) AS had_postings FROM r WHERE status <> 'running'")
def recent_yield(spark, sf):
    return run_ops.recent_yield(b.runs(spark, sf)).select("id", "source", "had_postings")


@query(
    "had_postings_recently",
    R + """ SELECT source, bool_or(jobs_found > 0) AS had_postings FROM (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY started_at DESC, id DESC) AS k FROM r WHERE status <> 'running') t
    WHERE k <= 7 GROUP BY source""",
)
def had_postings_recently(spark, sf):
    return run_ops.had_postings_recently(b.runs(spark, sf))


STATUS_SQL = f"""SELECT id, source, CASE WHEN status = 'error' THEN 'error'
    WHEN jobs_found = 0 AND coalesce({PRIOR} > 0, false) THEN 'warning' ELSE 'ok' END AS derived_status,
    CASE WHEN status = 'error' THEN 0 ELSE jobs_found END AS jobs_found,
    CASE WHEN status = 'error' THEN 0 ELSE jobs_inserted END AS jobs_inserted
  FROM r WHERE status <> 'running'"""


@query("run_status", R + " " + STATUS_SQL)
def run_status(spark, sf):
    return run_ops.run_status(b.runs(spark, sf)).select("id", "source", "derived_status", "jobs_found", "jobs_inserted")


@query(
    "health",
    R + f""" SELECT CASE status WHEN 'ok' THEN '🟢 ok' WHEN 'error' THEN '🔴 error' ELSE '⏳ running' END AS label, source,
    {iso('started_at')} AS last_run, jobs_found, jobs_inserted, coalesce(error_message, '') AS error FROM (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY started_at DESC, id DESC) AS k FROM r) t WHERE k = 1""",
)
def health(spark, sf):
    return reports.collection_health(b.runs(spark, sf)).withColumn("last_run", format_instant("last_run"))


@query(
    "health_banner",
    R + """ SELECT count(*) AS problems, CASE WHEN count(*) > 0 THEN count(*) || ' collector(s) need attention' ELSE 'all collectors healthy' END AS banner
    FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY started_at DESC, id DESC) AS k FROM r) t
    WHERE k = 1 AND status IN ('error', 'warning')""",
)
def health_banner(spark, sf):
    return reports.health_banner(b.runs(spark, sf))


@query(
    "runs_since",
    R + f""" SELECT id, source, {iso('started_at')} AS started_at, status, row_number() OVER (ORDER BY r.started_at, source, id) AS position
    FROM r WHERE r.started_at >= TIMESTAMP '2024-01-10 12:00:00'""",
)
def runs_since(spark, sf):
    rows = numbered(run_ops.runs_since(b.runs(spark, sf), instant(RUNS_AS_OF)))
    return rows.select("id", "source", format_instant("started_at").alias("started_at"), "status", "position")


TODAY = "started_at >= TIMESTAMP '2024-01-10'"


@query(
    "todays_runs",
    R + f" SELECT id, source, status, jobs_found, jobs_inserted, error_message, row_number() OVER (ORDER BY source, started_at, id) AS position FROM r WHERE {TODAY}",
)
def todays_runs(spark, sf):
    rows = numbered(run_ops.todays_runs(b.runs(spark, sf), instant(RUNS_AS_OF)))
    return rows.select("id", "source", "status", "jobs_found", "jobs_inserted", "error_message", "position")


@query("failed_runs", R + " SELECT id, source, error_message FROM r WHERE status = 'error'")
def failed_runs(spark, sf):
    return run_ops.failed_runs(b.runs(spark, sf)).select("id", "source", "error_message")


@query(
    "run_health_counts",
    R + " SELECT count(*) FILTER (WHERE status = 'error') AS failures, count(*) FILTER (WHERE status IN ('error', 'warning')) AS need_attention FROM r",
)
def run_health_counts(spark, sf):
    return run_ops.run_health_counts(b.runs(spark, sf))


@query(
    "fold_run_events",
    R + f""" SELECT id, source, {iso('started_at')} AS started_at,
    CASE WHEN status = 'running' THEN NULL ELSE {iso("started_at + INTERVAL 90 SECOND")} END AS finished_at,
    status, CASE WHEN status = 'running' THEN 0 ELSE jobs_found END AS jobs_found, CASE WHEN status = 'running' THEN NULL ELSE error_message END AS error_message FROM r""",
)
def fold_run_events(spark, sf):
    """Every run starts; all but the running ones finish 90 seconds later. A later event with an
    unknown status is ignored."""
    rows = b.runs(spark, sf)
    start = run_ops.start_events(rows)
    finish = run_ops.settled(rows).withColumns(
        {"finished_at": F.col("started_at") + F.expr("INTERVAL 90 SECONDS"), "event_seq": F.lit(1).cast("long")}
    )
    bad = finish.filter(F.col("id") % 3 == 0).withColumns({"status": F.lit("exploded"), "event_seq": F.lit(2).cast("long")})
    folded = run_ops.fold_run_events(start.unionByName(finish).unionByName(bad))
    return folded.select(
        "id", "source", format_instant("started_at").alias("started_at"), format_instant("finished_at").alias("finished_at"),
        "status", "jobs_found", "error_message",
    )


MICROS = "strftime(started_at, '%Y-%m-%dT%H:%M:%S.%f')"


@query(
    "daily_summary",
    R.replace("WITH r AS", P + ", r AS")
    + f""", t AS (SELECT *, row_number() OVER (ORDER BY score DESC, date_collected DESC, id DESC) AS k FROM p WHERE score IS NOT NULL),
  heads AS (SELECT * FROM (VALUES (0, 'Daily summary'), (1, ''), (2, 'New jobs collected today: 12'), (3, 'Jobs scored: 7'), (4, ''), (5, 'Top 5 highest scoring jobs:')) v(n, line))
  SELECT 1 AS section, '' AS source, '' AS at, CAST(0 AS BIGINT) AS id, CAST(n AS INTEGER) AS line_no, line FROM heads
  UNION ALL SELECT 2, '', '', 0, CAST(3 * (k - 1) AS INTEGER), k || '. ' || title || ' - ' || company FROM t WHERE k <= 5
  UNION ALL SELECT 2, '', '', 0, CAST(3 * (k - 1) + 1 AS INTEGER), '   Score: ' || score || '/10' FROM t WHERE k <= 5
  UNION ALL SELECT 2, '', '', 0, CAST(3 * (k - 1) + 2 AS INTEGER), '   URL: ' || url FROM t WHERE k <= 5
  UNION ALL SELECT 2, '', '', 0, 0, 'No scored jobs found.' WHERE NOT EXISTS (SELECT 1 FROM t)
  UNION ALL SELECT 3, '', '', 0, 0, '' WHERE EXISTS (SELECT 1 FROM r WHERE {TODAY})
  UNION ALL SELECT 3, '', '', 0, 1, 'Collector health (today''s runs):' WHERE EXISTS (SELECT 1 FROM r WHERE {TODAY})
  UNION ALL SELECT 4, source, {MICROS}, id, 0, CASE status WHEN 'error' THEN '[FAILED] ' || source || ': ' || coalesce(error_message, 'None')
      ELSE '[OK] ' || source || ': ' || jobs_found || ' found, ' || jobs_inserted || ' new' END FROM r WHERE {TODAY}""",
)
def daily_summary(spark, sf):
    return reports.daily_summary(b.postings(spark, sf), b.runs(spark, sf), instant(RUNS_AS_OF), 12, 7)


@query(
    "summary_subject",
    R + f""" SELECT 'Daily summary' || CASE WHEN count(*) > 0 THEN ' - ' || count(*) || ' collector failure' || CASE WHEN count(*) = 1 THEN '' ELSE 's' END
    ELSE '' END AS subject FROM r WHERE status = 'error' AND {TODAY}""",
)
def summary_subject(spark, sf):
    return reports.summary_subject(b.runs(spark, sf), instant(RUNS_AS_OF))


@query(
    "failure_alert",
    R + f""", f AS (SELECT * FROM r WHERE status = 'error' AND {TODAY})
  SELECT 1 AS section, '' AS source, '' AS at, CAST(0 AS BIGINT) AS id, 0 AS line_no,
    'ALERT - ' || count(*) || ' collector failure' || CASE WHEN count(*) = 1 THEN '' ELSE 's' END AS line FROM f HAVING count(*) > 0
  UNION ALL SELECT 2, source, {MICROS}, id, 0, '[FAILED] ' || source || ': ' || coalesce(error_message, 'None') FROM f""",
)
def failure_alert(spark, sf):
    return reports.failure_alert(b.runs(spark, sf), instant(RUNS_AS_OF))


# --- text and dates -----------------------------------------------------------------------


@query(
    "parse_dates",
    P
    + """ SELECT id, CASE WHEN id % 5 IN (0, 1, 2) OR id % 5 = 3 AND month(o_orderdate) = 5 THEN strftime(o_orderdate, '%Y-%m-%d') END AS row_date,
    CASE WHEN id % 5 = 3 OR id % 5 = 0 AND month(o_orderdate) = 5 THEN strftime(o_orderdate, '%Y-%m-%d') END AS long_date,
    CASE WHEN id % 5 IN (1, 2) THEN strftime(o_orderdate, '%Y-%m-%d') END AS listing_date,
    CASE WHEN id % 5 = 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS typed_date,
    strftime(o_orderdate, '%Y-%m-%d') AS epoch_date, strftime(o_orderdate, '%Y-%m-%d') AS week_date,
    strftime(o_orderdate, '%Y-%m-%d') AS compact_date FROM p""",
)
def parse_dates(spark, sf):
    """Order dates written in five ways and read back by each family of formats. May has the same short and long name, so it is read as either."""
    orders = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("d"))
    styles = ["MMM d, yyyy", "dd.MM.yyyy", "yyyy-MM-dd", "MMMM dd, yyyy", "yyyy/MM/dd"]
    written = F.element_at(F.array(*[F.date_format("d", s) for s in styles]), (F.col("id") % 5 + 1).cast("int"))
    rows = orders.withColumn("t", F.when(F.col("id") % 5 == 0, F.regexp_replace(written, "^May ", "may ")).otherwise(written))
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), "d"), F.lit("-W"), F.lpad(F.weekofyear("d").cast("string"), 2, "0"), F.lit("-"), (F.weekday("d") + 1).cast("string"))

    def row_date(formats):
        return dates.iso_date(dates.parse_date_any("t", formats))

    return rows.select(
        "id", row_date(dates.TABLE_ROW_FORMATS).alias("row_date"), row_date(dates.LONG_MONTH_FORMATS).alias("long_date"), row_date(dates.LISTING_FORMATS).alias("listing_date"),
        dates.iso_date(dates.posted_on("t")).alias("typed_date"),
        dates.iso_date(dates.epoch_ms_to_date(F.unix_millis(F.col("d").cast("timestamp")))).alias("epoch_date"),
        dates.iso_date(dates.posted_on(week)).alias("week_date"),
        dates.iso_date(dates.posted_on(F.concat(F.date_format("d", "yyyyMMdd"), F.lit("T1")))).alias("compact_date"),
    )


@query(
    "instant_roundtrip",
    """SELECT event_id AS id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') END AS instant FROM events""",
)
def instant_roundtrip(spark, sf):
    """Event times written in UTC, with an offset, without a zone, and unreadably."""
    e = b.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"))
    plain = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    shifted = F.concat(F.date_format(F.col("ts") + F.expr("INTERVAL 90 MINUTES"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+01:30"))
    written = F.element_at(F.array(format_instant("ts"), shifted, plain, F.concat(F.lit("x"), plain)), (F.col("id") % 4 + 1).cast("int"))
    return e.select("id", format_instant(dates.parse_instant(written)).alias("instant"))


@query(
    "label_extract",
    P
    + """ SELECT id, CASE WHEN id % 4 = 0 THEN location WHEN id % 4 = 1 THEN 'berlin ' || title WHEN id % 4 = 2 THEN '' ELSE '' END AS place,
    CASE WHEN id % 4 = 0 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN id % 4 = 2 THEN 'soon' END AS posted,
    location AS after_label FROM p""",
)
def label_extract(spark, sf):
    rows = b.postings(spark, sf).select("id", "title", "location", F.col("date_collected"))
    day = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "dd.MM.yyyy").alias("day"))
    k = F.col("id") % 4
    card = (
        F.when(k == 0, F.concat("title", F.lit(" Standort: "), "location", F.lit(" | Posted: never Date Posted: "), "day", F.lit(" now")))
        .when(k == 1, F.concat(F.lit("Team berlin "), "title", F.lit(", anywhere"))).when(k == 2, F.concat(F.lit("Office: "), F.repeat(F.lit("far "), 30), F.lit("Published:  soon")))
        .otherwise("nothing here")
    )
    page = F.concat(F.lit("Jobs Location(s): "), "location", F.lit(" - "), "title", F.lit(" and more"))
    return (
        rows.join(day, "id")
        .withColumns({"card": card, "page": page})
        .select(
            "id",
            labels.extract_location("card").alias("place"),
            labels.extract_date_posted("card").alias("posted"),
            labels.location_after_label("page", "title").alias("after_label"),
        )
    )


@query("strip_html", None)
def strip_html(spark, sf):
    return b.table(spark, sf, "pages").select("page_id", html.strip_html("html").alias("text"))


DROP = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
ORACLES["strip_html"] = rf"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(html, '{DROP}', ' ', 'g'), '(?s)</?[a-zA-Z][^>]*>|<![^>]*>', ' ', 'g'),
    '&nbsp;', chr(160)), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'),
    '[\s\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x{{1c}}-\x{{1f}}\x{{85}}\x{{0b}}]+', ' ', 'g')) AS text FROM pages"""


LINKS = r"""l AS (SELECT page_id, url AS base, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS tag FROM (
    SELECT page_id, url, regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', ' ', 'g'),
      '(?is)<a\b[^>]*?\bhref\s*=\s*"[^"]*"[^>]*>.*?</a') AS a FROM pages) t),
  h AS (SELECT page_id, base, pos, regexp_extract(tag, 'href\s*=\s*"([^"]*)"', 1) AS href,
    trim(regexp_replace(regexp_replace(replace(tag, '</a', ''), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM l),
  v AS (SELECT *, CASE WHEN href LIKE 'http%' THEN href WHEN href LIKE '//%' THEN regexp_extract(base, '^([a-z]+:)', 1) || href
    WHEN href LIKE '/%' THEN regexp_extract(base, '^([a-z]+://[^/?#]*)', 1) || href
    WHEN href LIKE '#%' THEN regexp_extract(base, '^([^#]*)', 1) || href
    ELSE regexp_extract(base, '^(.*/)', 1) || href END AS url FROM h)"""


def _page_links(spark, sf):
    from postmill.sources.listings import page_links

    pages = b.table(spark, sf, "pages").select("page_id", "url", F.col("html").alias("body"))
    return page_links(pages)


@query("page_links", f"WITH {LINKS} SELECT page_id, pos, href, url, text FROM v")
def page_links(spark, sf):
    return _page_links(spark, sf).select("page_id", F.col("pos").cast("long").alias("pos"), "href", "url", "text")


@query(
    "url_absolutize",
    r"""SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) || '/a/c?x=' || page_id AS dotted,
    regexp_extract(url, '^(https?:)', 1) || '//cdn.example/' || page_id AS protocol_relative,
    regexp_extract(url, '^([^#]*)', 1) || '#p' || page_id AS fragment,
    'https://other.example/' || page_id AS absolute FROM pages""",
)
def url_absolutize(spark, sf):
    pages = b.table(spark, sf, "pages").withColumn("n", F.col("page_id").cast("string"))

    def joined(*parts):
        return html.absolutize_url("url", F.concat(*[F.lit(p) for p in parts], F.col("n")))

    return pages.select(
        "page_id", joined("/a/./b/../c?x=").alias("dotted"), joined("//cdn.example/").alias("protocol_relative"),
        joined("#p").alias("fragment"), joined("https://other.example/").alias("absolute"),
    )


@query(
    "job_url_filter",
    f"""WITH {LINKS} SELECT page_id, pos, url, text FROM v WHERE length(text) >= 4 AND contains(lower(url), 'example')
    AND (contains(lower(url), 'e') OR contains(lower(url), 'job')) AND NOT contains(lower(url), 'login') AND NOT contains(lower(url), 'st')
    AND lower(text) NOT IN ('search', 'then')""",
)
def job_url_filter(spark, sf):
    rules = labels.LinkRules(domains=("example",), markers=("job", "e"), skip=("login", "st"), blocked_titles=("search", "then"))
    links = _page_links(spark, sf).filter(labels.is_job_url("url", "text", rules))
    return links.select("page_id", F.col("pos").cast("long").alias("pos"), "url", "text")


@query("event_json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def event_json_props(spark, sf):
    props = F.try_parse_json("props")
    return b.table(spark, sf, "events").select("event_id", F.try_variant_get(props, "$.k", "bigint").alias("k"))


@query(
    "string_or_blank",
    "SELECT event_id, event_type AS label, '' AS number, '' AS whole, '' AS missing FROM events",
)
def string_or_blank(spark, sf):
    """Text, number, object and missing leaves of a JSON value."""
    value = F.to_json(F.struct(F.concat(F.lit(" "), "event_type", F.lit("\n")).alias("label"), F.col("value").alias("number")))
    v = F.try_parse_json(value)

    def leaf(name):
        return text.string_or_blank(F.try_variant_get(v, f"$.{name}", "variant"))

    return b.table(spark, sf, "events").select(
        "event_id", leaf("label").alias("label"), leaf("number").alias("number"), text.string_or_blank(v).alias("whole"), leaf("nope").alias("missing")
    )


@query(
    "search_requests",
    """WITH t AS (SELECT DISTINCT lower(s_name) AS source FROM supplier),
    k AS (SELECT source, generate_subscripts(ks, 1) - 1 AS term_no, unnest(ks) AS term FROM (
      SELECT source, CASE WHEN length(source) % 2 = 0 THEN ['retrieval', 'generative', 'llm'] ELSE ['llm', 'retrieval', 'generative'] END AS ks FROM t) x)
    SELECT source, split_part(source, '#', 1) AS kind, CAST(n AS INTEGER) AS template_no, CAST(term_no AS INTEGER) AS term_no,
      'https://' || split_part(source, '#', 2) || '.example/' || n || '?q=' || term AS url
    FROM k, (VALUES (0), (1)) v(n)""",
)
def search_requests(spark, sf):
    """Two templates and a keyword list per supplier, keywords with their stand-ins."""
    from postmill.sources.registry import search_requests, search_terms

    names = b.table(spark, sf, "supplier").select(F.lower("s_name").alias("source")).distinct()
    words = F.when(F.length("source") % 2 == 0, F.array(F.lit("rag"), F.lit("llm"))).otherwise(F.array(F.lit("llm"), F.lit("rag"), F.lit("generative")))
    sources = names.withColumn("keywords", search_terms(words))
    host = F.split_part("source", F.lit("#"), F.lit(2))
    templates = names.select("source", F.explode(F.array(F.lit(0), F.lit(1))).alias("template_no")).withColumn(
        "template", F.concat(F.lit("https://"), host, F.lit(".example/"), F.col("template_no").cast("string"), F.lit("?q={keyword}"))
    )
    kind = labels.source_kind(F.replace("source", F.lit("#"), F.lit("_")))
    return search_requests(sources, templates).withColumn("kind", kind)


@query(
    "score_batch",
    P
    + """ SELECT id, CASE WHEN length(title) % 3 = 1 THEN NULL ELSE length(location) % 10 + 1 END AS score,
    CASE WHEN length(title) % 3 = 1 THEN NULL ELSE title || ' in ' || location END AS reason, 'ai' AS source FROM p WHERE score IS NULL""",
)
def score_batch(spark, sf):
    return scoring.score_batch(b.postings(spark, sf), length_scorer())


def length_scorer() -> Callable[[str], str]:
    """A deterministic stand-in for a model: by title and location length, failing on some.

    Nested, so that it travels to the executors by value.
    """

    def score(prompt: str) -> str:
        import json

        fields = dict(line.split(": ", 1) for line in prompt.split("\n")[:3])
        if len(fields["Title"]) % 3 == 1:
            raise RuntimeError("no answer")
        return json.dumps({"score": len(fields["Location"]) % 10 + 1, "reason": f" {fields['Title']} in {fields['Location']} "})

    return score


@query(
    "scoring_summary",
    P + " SELECT count(*) FILTER (WHERE length(title) % 3 <> 1) AS scored, count(*) FILTER (WHERE length(title) % 3 = 1) AS failed FROM p WHERE score IS NULL",
)
def scoring_summary(spark, sf):
    return aggregates.scoring_summary(scoring.score_batch(b.postings(spark, sf), length_scorer()))
