import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from postmill.functions.dates import instant
from postmill.operators import aggregates, dedupe, filters, joins, reports, runs, scoring, skew, store
from postmill.plans.maintenance import run_cleanup, run_scoring
from postmill.schema import POSTING_IN, POSTINGS, RUNS, WATCHLIST
from postmill.sources.connections import load_connections
from postmill.sources.tables import postings_table, write_cards

def now():
    return instant("2026-07-10T08:00:00Z")


EPOCH = datetime(2026, 1, 1)


def stored(spark, rows):
    """Stored postings from dicts; what is not given has a plain value."""
    full = []
    for i, row in enumerate(rows, start=1):
        base = {
            "id": i, "title": "AI Engineer", "company": "SAP", "location": "Berlin", "source": "test", "url": f"https://x.example/{i}",
            "description": "", "date_posted": None, "date_collected": EPOCH, "dedupe_key": f"k::{i}::", "status": "new", "score": None,
            "score_reason": None, "score_source": None, "created_at": EPOCH, "updated_at": EPOCH,
        }
        full.append(tuple({**base, **row}[f.name] for f in POSTINGS))
    return spark.createDataFrame(full, POSTINGS)


def batch(spark, rows):
    full = [(r["title"], r.get("company", "SAP"), r.get("location", "Berlin"), "fake", r.get("url", "https://x.example/1"), "d", None, "2026-07-01T00:00:00Z", i) for i, r in enumerate(rows)]
    schema = "title string, company string, location string, source string, url string, description string, date_posted string, date_collected string, pos int"
    return spark.createDataFrame(full, schema)


def run_rows(spark, rows):
    full = [(i, s, EPOCH + timedelta(hours=h), None, status, found, 0, None) for i, s, h, status, found in rows]
    return spark.createDataFrame(full, RUNS)


def test_first_url_wins(spark):
    rows = spark.createDataFrame([("s", "a/1", 0), ("s", "a/1", 1), ("s", "a/2", 2), ("t", "a/1", 3)], "source string, url string, pos int")
    assert sorted(r.pos for r in dedupe.dedupe_by_url(rows, ["pos"]).collect()) == [0, 2, 3]


def test_insert_is_idempotent_and_order_decides(spark):
    rows = [{"title": "A"}, {"title": "a!"}, {"title": "B", "url": None}, {"title": "C"}]
    arriving = batch(spark, rows)
    first = store.new_postings(stored(spark, []), arriving, now(), ["pos"]).collect()
    assert [(r.title, r.status, r.dedupe_key) for r in sorted(first, key=lambda r: r.id)] == [("A", "new", "sap::a::berlin"), ("C", "new", "sap::c::berlin")]
    have = spark.createDataFrame(first, POSTINGS)
    assert store.new_postings(have, arriving.orderBy(F.rand(1)), now(), ["pos"]).count() == 0
    more = store.new_postings(have, batch(spark, [{"title": "D"}]), now(), ["pos"]).first()
    assert more.id > max(r.id for r in first)
    shuffled = store.new_postings(stored(spark, []), arriving.repartition(7).orderBy(F.desc("pos")), now(), ["pos"]).collect()
    assert {r.title for r in shuffled} == {"A", "C"}


@pytest.mark.parametrize("id_span", [1, 3, 1 << 20])
def test_duplicates_match_a_brute_force_ranking(spark, id_span):
    rng = random.Random(5)
    rows = [
        {"title": rng.choice(["Dev", " dev", "Ops"]), "company": rng.choice(["SAP", "sap ", "X"]), "dedupe_key": rng.choice(["a", "b"]), "id": i * 2}
        for i in range(60)
    ]
    groups = {}
    for r in rows:
        groups.setdefault((r["title"].strip().lower(), r["company"].strip().lower()), []).append(r)
    want = {}
    for members in groups.values():
        if len(members) > 1 and len({m["dedupe_key"] for m in members}) > 1:
            want.update({m["id"]: k for k, m in enumerate(members, start=1) if k > 1})
    table = stored(spark, rows)
    assert {r.id: r.duplicate_rank for r in dedupe.find_duplicates(table, id_span=id_span).collect()} == want
    assert {r.id for r in dedupe.flag_duplicates(table, id_span=id_span).filter("is_duplicate").collect()} == set(want)


def test_same_role_in_two_cities_counts_unless_location_matters(spark):
    rows = stored(spark, [{"location": "Berlin"}, {"location": "Munich"}])
    assert dedupe.find_duplicates(rows).count() == 1
    assert dedupe.find_duplicates(rows, match_location=True).count() == 0


def test_rekeying(spark):
    legacy = {"dedupe_key": "sap::ai engineer"}
    done = store.rekey_legacy(stored(spark, [legacy]))
    assert [r.dedupe_key for r in done.collect()] == ["sap::ai engineer::berlin"]
    assert [r.dedupe_key for r in store.rekey_legacy(done).collect()] == ["sap::ai engineer::berlin"]
    both = store.rekey_legacy(stored(spark, [{"dedupe_key": "sap::ai engineer::berlin"}, legacy])).collect()
    assert [(r.id, r.dedupe_key) for r in both] == [(1, "sap::ai engineer::berlin")]
    assert [r.id for r in store.rekey_legacy(stored(spark, [legacy, legacy])).collect()] == [1]


def test_latest_runs_and_history(spark):
    rows = run_rows(spark, [(1, "bmw", 1, "ok", 3), (2, "bmw", 2, "error", 0), (3, "sap", 1, "ok", 1), (4, "bmw", 2, "ok", 0)])
    assert {r.source: r.id for r in runs.latest_run_per_source(rows).collect()} == {"bmw": 4, "sap": 3}
    history = run_rows(spark, [(1, "bmw", 1, "ok", 10), *[(i, "bmw", i, "warning", 0) for i in (2, 3, 4)], (9, "sap", 1, "running", 5)])
    assert [(r.source, r.had_postings) for r in runs.had_postings_recently(history, 3).collect()] == [("bmw", False)]
    assert [(r.source, r.had_postings) for r in runs.had_postings_recently(history, 4).collect()] == [("bmw", True)]


@pytest.mark.parametrize("chunk, n", [("hour", 7), ("day", 3), ("year", 7), ("hour", 1)])
def test_history_is_exact_across_chunks(spark, chunk, n):
    rng = random.Random(n)
    rows = [(i, rng.choice(["hot", "hot", "cold"]), rng.randrange(0, 90), rng.choice(["ok", "ok", "error", "running"]), rng.choice([0, 0, 0, 4])) for i in range(160)]
    want = {}
    for source in ("hot", "cold"):
        done = sorted((r for r in rows if r[1] == source and r[3] != "running"), key=lambda r: (r[2], r[0]))
        for k, r in enumerate(done):
            want[r[0]] = any(p[4] > 0 for p in done[max(0, k - n) : k])
    got = {r.id: r.had_postings for r in runs.recent_yield(run_rows(spark, rows), n, chunk).collect()}
    assert got == want


def test_run_events_fold(spark):
    start = runs.start_events(spark.createDataFrame([(1, "sap", EPOCH), (2, "bmw", EPOCH)], "id long, source string, started_at timestamp"))
    end = start.filter("id = 1").withColumns({"finished_at": F.lit(EPOCH + timedelta(minutes=1)), "status": F.lit("ok"), "jobs_found": F.lit(5).cast("long"), "event_seq": F.lit(1).cast("long")})
    bad = end.withColumns({"status": F.lit("exploded"), "event_seq": F.lit(2).cast("long")})
    folded = {r.id: r for r in runs.fold_run_events(start.union(end).union(bad)).collect()}
    assert (folded[1].status, folded[1].jobs_found, folded[1].finished_at) == ("ok", 5, EPOCH + timedelta(minutes=1))
    assert (folded[2].status, folded[2].finished_at) == ("running", None)
    valid, rejected = store.validate(bad, store.run_rules())
    assert (valid.count(), rejected.first().errors) == (0, ["bad status"])


def test_scores_and_statuses(spark):
    table = stored(spark, [{}, {"score": 4, "score_source": "ai"}, {}, {}])
    updates = spark.createDataFrame(
        [(1, 7, "a", "ai", 1), (1, 9, "b", "ai", 2), (2, 8, "c", "ai", 1), (3, 2, "d", "ai", 1), (3, 3, "e", "manual", 2), (3, 5, None, "manual", 3), (4, 11, "x", "ai", 1), (4, 3, "x", "robot", 1)],
        "id long, score int, reason string, source string, seq long",
    )
    got = {r.id: (r.score, r.score_reason, r.score_source) for r in store.apply_scores(table, updates, now()).collect()}
    assert got == {1: (7, "a", "ai"), 2: (4, None, "ai"), 3: (5, None, "manual"), 4: (None, None, None)}
    last = {r.id: r.score for r in store.apply_scores(table, updates, now(), only_unscored=False).collect()}
    assert last == {1: 9, 2: 8, 3: 5, 4: None}
    marks = spark.createDataFrame([(1, "relevant", 1), (1, "applied", 2), (2, "bogus", 1)], "id long, status string, seq long")
    assert {r.id: r.status for r in store.apply_status(table, marks, now()).collect()} == {1: "applied", 2: "new", 3: "new", 4: "new"}


def test_list_options(spark):
    table = stored(spark, [{"score": 3, "company": "A"}, {"score": None}, {"score": 9, "date_collected": EPOCH + timedelta(days=1)}, {"score": 9}])
    ids = lambda **options: [r.id for r in filters.list_postings(table, **options).collect()]
    assert ids() == [3, 4, 2, 1]
    assert ids(sort_by="score") == [3, 4, 1, 2]
    assert ids(min_score=1) == [3, 4, 2, 1]
    assert ids(min_score=2) == [3, 4, 1]
    assert ids(company="A") == [1]
    assert ids(keyword="ENGIN%R") == [3, 4, 2, 1]
    with pytest.raises(ValueError):
        ids(sort_by="oldest")
    assert [r.id for r in filters.top_scoring(table, 2).collect()] == [3, 4]
    assert [r.id for r in filters.order_export(table).collect()] == [4, 3, 1, 2]


def test_lookback_keeps_unreadable_dates(spark):
    rows = spark.createDataFrame([(None,), ("not-a-date",), ("2026-07-09",), ("2026-05-01",), ("20260501",)], "date_posted string")
    kept = filters.within_lookback(rows, F.lit("2026-06-10").cast("date"))
    assert {r.date_posted for r in kept.collect()} == {None, "not-a-date", "2026-07-09"}


def test_watchlist(spark):
    have = spark.createDataFrame([(1, "SAP", "https://old", EPOCH, False), (2, "Bosch", "https://b", EPOCH, True)], WATCHLIST)
    rows = spark.createDataFrame([(" SAP ", " ", 1), ("sap", "https://s", 2), ("  ", "x", 3), ("Zeiss", "u", 4), ("Zeiss", "v", 5)], "name string, careers_url string, seq int")
    got = {r.name: r for r in store.upsert_watchlist(have, rows, now()).collect()}
    assert set(got) == {"SAP", "Bosch", "sap", "Zeiss"}
    assert (got["SAP"].id, got["SAP"].careers_url, got["SAP"].active, got["SAP"].added_at) == (1, None, True, EPOCH)
    assert (got["Zeiss"].careers_url, got["Zeiss"].id > got["sap"].id > 2) == ("v", True)
    gone = store.deactivate_watchlist(have, spark.createDataFrame([("Bosch",)], "name string"))
    assert store.active_watchlist(gone).count() == 0
    postings = stored(spark, [{"company": "sap", "score": 3, "date_posted": "2026-01-02"}, {"company": "SAP", "date_posted": "not-a-date"}])
    (row,) = [r for r in joins.watchlist_stats(have, postings).collect() if r.name == "SAP"]
    assert (row.total_jobs, row.latest_job_date, row.top_score) == (2, "not-a-date", 3)


def test_connections(spark, tmp_path):
    path = tmp_path / "contacts.json"
    path.write_text(
        '{"companies": [{"company": " Meriton ", "aliases": [], "connections": [{"name": "Example Person", "relationship": "Former colleague", "notes": "Ask."},'
        ' {"name": 5}], "notes": ""}, {"company": "Accenture", "aliases": ["Accentric", 7, ""], "connections": [], "notes": "Add contacts."},'
        ' {"company": 3}, {"company": "accentric"}]}'
    )
    found = load_connections(spark, str(path))
    assert {r.company_key: r.company for r in found.collect()} == {"meriton": "Meriton", "accenture": "Accenture", "accentric": "accentric"}
    rows = stored(spark, [{"company": "MERITON!"}, {"company": "Accenture"}, {"company": "Accentric"}, {"company": "None"}])
    labels = {r.company: r.connection for r in joins.attach_connections(rows, found).collect()}
    assert labels["MERITON!"] == "Example Person (Former colleague - Ask.)"
    assert labels["Accenture"] == "Add contacts."
    assert labels["Accentric"].startswith("company is on your local list")
    assert labels["None"] is None
    assert load_connections(spark, str(tmp_path / "missing.json")).count() == 0
    path.write_text("{oops")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        load_connections(spark, str(path)).collect()


def test_salted_join_equals_plain_join(spark):
    big = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"))
    dim = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("unused", 4)], "key string, v int")
    for how in ("left", "inner"):
        want = sorted(big.join(dim, "key", how).select("id", "key", "v").collect(), key=lambda r: r.id)
        got = skew.salted_join(big, dim, ["key"], "id", how, min_rows=500, fan_out=8).select("id", "key", "v")
        assert sorted(got.collect(), key=lambda r: r.id) == want
    assert [r.key for r in skew.hot_keys(big, ["key"], 500).collect()] == ["hot"]
    assert sorted(r.v or 0 for r in skew.lookup_join(big, dim, ["key"], "id", rows=2).select("v").collect()) == sorted(r.v or 0 for r in big.join(dim, "key", "left").collect())


def test_score_responses(evaluate):
    given = {
        '{"score": 7.9, "reason": " fits "}': (7, "fits"), '{"score": "7", "reason": "x"}': (7, "x"), '{"score": "7.5", "reason": "x"}': None,
        '{"score": true, "reason": null}': (1, "None"), '{"score": 0, "reason": "x"}': None, '{"score": 11, "reason": "x"}': None,
        '{"score": 5, "reason": "  "}': None, '{"score": 5}': None, '{"reason": "x"}': None, "not json": None, '{"score": null, "reason": "x"}': None,
        '{"score": 5, "reason": 12}': (5, "12"), '{"score": 1e1, "reason": true}': (10, "True"), '{"score": [5], "reason": "x"}': None,
        '[5, "x"]': None, '{"score": " 8 ", "reason": "x"}': (8, "x"),
    }
    got = evaluate(list(given), scoring.parse_score_response)
    assert [None if g is None else tuple(g) for g in got] == list(given.values())


def test_failed_scorer_leaves_rows_unscored(spark):
    def scorer(prompt):
        if "Broken" in prompt:
            raise RuntimeError("no answer")
        return '{"score": 6, "reason": "ok"}'

    table = stored(spark, [{"title": "Broken"}, {"title": "Fine"}, {"score": 2}])
    got = {r.id: r.score for r in scoring.score_batch(table, scorer).collect()}
    assert got == {1: None, 2: 6}
    summary = aggregates.scoring_summary(scoring.score_batch(table, scorer)).first()
    assert (summary.scored, summary.failed) == (1, 1)


def test_equal_prompts_are_asked_once_and_failures_again(spark, tmp_path):
    log = str(tmp_path / "log")

    def scorer(prompts):
        import time
        import uuid

        with open(f"{log}-{uuid.uuid4().hex}", "w") as out:
            out.write("\x1e".join(prompts))
        time.sleep(0.01)
        if len(prompts) > 3:
            raise RuntimeError("too many")
        return ['{"score": 5, "reason": "ok"}' if "Good" in p else "no JSON" if "Odd" in p else None for p in prompts]

    table = stored(spark, [{"title": t} for t in ["Good"] * 40 + ["Odd"] * 2 + ["Never", "Good 2"]] + [{"score": 4}])
    got = [(r.id, r.score, r.source) for r in scoring.score_prompts(table.coalesce(1), scorer, group=3, concurrency=2, tries=3).orderBy("id").collect()]
    assert got == [(i, 5 if i <= 40 or i == 44 else None, "ai") for i in range(1, 45)]
    asked = [p for f in tmp_path.iterdir() for p in f.read_text().split("\x1e")]
    counts = {name: sum(f"Title: {name}\n" in p for p in asked) for name in ("Good", "Odd", "Never", "Good 2")}
    assert counts == {"Good": 1, "Odd": 3, "Never": 3, "Good 2": 1}
    # A call that raises is as if nothing had been answered.
    assert {r.score for r in scoring.score_prompts(table.filter("id in (1, 42, 43, 44)").coalesce(1), scorer, group=9, tries=2).collect()} == {None}


def test_tables_version_and_jobs(spark, tmp_path):
    table = postings_table(spark, str(tmp_path))
    assert table.read().count() == 0
    table.replace(stored(spark, [{"title": "Dev", "dedupe_key": "a"}, {"title": "dev", "dedupe_key": "b"}]))
    assert table.append(stored(spark, [{"id": 3, "title": "Old", "source": "other"}]), token="t:1") == 2
    assert table.append(stored(spark, [{"id": 4}]), token="t:1") == 2
    assert sorted(r.id for r in table.read().collect()) == [1, 2, 3]
    report = run_cleanup(table, 30, now()).first()
    assert (report.duplicates_found, report.stale_found, report.deleted, report.archived) == (1, 3, 1, 2)
    assert {r.id: r.status for r in table.read().collect()} == {1: "ignored", 3: "ignored"}
    assert table.read(version=2).count() == 3
    counts = run_scoring(table, lambda prompt: '{"score": 3, "reason": "r"}', now()).first()
    assert (counts.scored, counts.failed) == (2, 0)
    assert {r.score for r in table.read().collect()} == {3}


def test_cards(spark, tmp_path):
    rows = stored(spark, [{"title": "<A>", "score": 3, "score_reason": ""}, {"score": 9, "date_posted": ""}])
    path = str(tmp_path / "cards")
    assert write_cards(reports.cards_or_notice(rows), path) == 2
    lines = [r.value for r in spark.read.text(path).collect()]
    assert lines[0].count("Score: 9/10") == 1 and "Unknown date" in lines[0]
    assert "&lt;A&gt;" in lines[1] and "reason" not in lines[1]
    assert [r.card for r in reports.cards_or_notice(stored(spark, [])).collect()] == [reports.EMPTY_CARD]


def test_summary_of_nothing_and_view(spark):
    empty_runs = spark.createDataFrame([], RUNS)
    lines = [r.line for r in reports.daily_summary(stored(spark, [{}]), empty_runs, now(), 1, 0).collect()]
    assert lines[-1] == "No scored jobs found." and len(lines) == 7
    assert reports.failure_alert(empty_runs, now()).count() == 0
    assert reports.summary_subject(empty_runs, now()).first().subject == "Daily summary"
    contacts = load_connections(spark, "/nonexistent/contacts.json")
    view = reports.postings_view(stored(spark, [{"score": 2, "score_source": "manual"}, {}]), contacts, sort_by="score")
    assert [(r.score_text, r.posted_text, r.connection) for r in view.collect()] == [("2/10 (manual)", "Unknown", None), (None, "Unknown", None)]
