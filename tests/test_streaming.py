from datetime import datetime, timedelta

from pyspark.sql import functions as F

from postmill.functions.dates import instant
from postmill.schema import RUNS
from postmill.sources.tables import StoredTable, postings_table
from postmill.streaming import health, ingest

SCHEMA = "title string, company string, location string, source string, url string, description string, date_posted string, date_collected string, pos int"


def write(spark, folder, titles):
    rows = [(t, "SAP", "Berlin", "fake", f"https://x.example/{t}", "d", None, "2026-07-01T00:00:00Z", i) for i, t in enumerate(titles)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_ingest_takes_only_new_files_and_keys(spark, tmp_path):
    folder, check = str(tmp_path / "landed"), str(tmp_path / "check")
    table = postings_table(spark, str(tmp_path / "tables"))

    def run():
        schema = spark.createDataFrame([], SCHEMA).schema
        landed = ingest.read_landing(spark, folder, schema)
        ingest.ingest_stream(landed, lambda d: d, table, check, instant("2026-07-10T00:00:00Z"), ("pos",)).awaitTermination()
        return sorted(r.title for r in table.read().collect())

    write(spark, folder, ["A", "B", "a"])
    assert run() == ["A", "B"]
    assert run() == ["A", "B"]
    write(spark, folder, ["b", "C"])
    assert run() == ["A", "B", "C"]
    # A replay of a committed batch adds nothing.
    before = table.versions().count()
    table.append(table.read(), token="ingest:0")
    assert table.versions().count() == before


def test_health_matches_the_batch_rule_over_batches(spark, tmp_path):
    from postmill.operators.runs import run_status

    start = datetime(2026, 1, 1)
    rows = [(i, f"s{i % 3}", start + timedelta(minutes=7 * i), None, "error" if i % 11 == 0 else "ok", 4 if i % 13 == 0 else 0, 0, None) for i in range(90)]
    frame = spark.createDataFrame(rows, RUNS)
    folder = str(tmp_path / "runs")
    judged = StoredTable(spark, str(tmp_path / "judged"), health.JUDGED)
    tail = StoredTable(spark, str(tmp_path / "tail"), health.TAIL)
    for low in (0, 30, 60):
        frame.filter(F.col("id").between(low, low + 29)).coalesce(1).write.mode("append").parquet(folder)
        stream = ingest.read_landing(spark, folder, RUNS)
        health.run_health_stream(stream, judged, tail, str(tmp_path / "check")).awaitTermination()
    pick = lambda d: {r.id: (r.had_postings, r.derived_status) for r in d.collect()}
    assert pick(judged.read()) == pick(run_status(frame))
    assert {r["count"] for r in tail.read().groupBy("source").count().collect()} == {7}


def test_late_runs_are_judged_with_stored_history(spark, tmp_path):
    from postmill.operators.runs import run_status

    start = datetime(2026, 1, 1)
    rows = [(i, "s", start + timedelta(hours=i), None, "ok", 3 if i == 3 else 0, 0, None) for i in range(40)]
    frame, folder = spark.createDataFrame(rows, RUNS), str(tmp_path / "runs")
    judged, tail = StoredTable(spark, str(tmp_path / "judged"), health.JUDGED), StoredTable(spark, str(tmp_path / "tail"), health.TAIL)
    for part in ("id <> 6 and id < 20", "id <> 6 and id >= 20", "id = 6"):
        frame.filter(part).coalesce(1).write.mode("append").parquet(folder)
        health.run_health_stream(ingest.read_landing(spark, folder, RUNS), judged, tail, str(tmp_path / "check")).awaitTermination()
    (late,) = judged.read().filter("id = 6").collect()
    assert (late.had_postings, late.derived_status) == (True, "warning")
    assert judged.versions().count() == 3
    assert [(r.had_postings, r.derived_status) for r in run_status(frame).filter("id = 6").collect()] == [(True, "warning")]
    assert sorted(r.id for r in tail.read().collect()) == list(range(33, 40))


def test_first_sightings_and_daily_counts_lose_no_late_row(spark, tmp_path):
    start = datetime(2026, 1, 20)
    frame = spark.createDataFrame([(i, "ab"[i == 5], start - timedelta(days=9 if i == 5 else 0), None, "ok", i, 0, None) for i in range(6)], RUNS)
    folder = str(tmp_path / "runs")
    first, daily = StoredTable(spark, str(tmp_path / "first"), RUNS), StoredTable(spark, str(tmp_path / "daily"), ingest.DAILY_COUNTS)
    for part in ("id < 3", "id in (3, 4)", "id = 5"):
        frame.filter(part).write.mode("append").parquet(folder)
        ingest.first_sightings_stream(ingest.read_landing(spark, folder, RUNS), first, str(tmp_path / "c1"), ("source",), ("id",)).awaitTermination()
        ingest.daily_counts_stream(ingest.read_landing(spark, folder, RUNS), daily, str(tmp_path / "c2")).awaitTermination()
    assert sorted((r.source, r.id) for r in first.read().collect()) == [("a", 0), ("b", 5)]
    assert first.versions().count() == daily.versions().count() == 3
    assert sorted((r.day.day, r.source, r.runs, r.jobs_found) for r in ingest.daily_totals(daily.read()).collect()) == [(11, "b", 1, 5), (20, "a", 5, 10)]


EVENTS = "key string, at timestamp, n int"


def land(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_watermark_drops_late_rows_and_lets_keys_return(spark, tmp_path):
    day = lambda d: datetime(2026, 1, d)
    folder, out = str(tmp_path / "events"), StoredTable(spark, str(tmp_path / "out"), spark.createDataFrame([], EVENTS).schema)

    def run(*rows):
        land(spark, folder, rows, EVENTS)
        landed = ingest.read_landing(spark, folder, out.schema)
        # Each run is a query of its own that goes on from the checkpoint.
        ingest.recent_sightings_stream(landed, out, str(tmp_path / "check"), ("key",), "at", "2 days").awaitTermination()
        return sorted(r.n for r in out.read().collect())

    assert run(("a", day(1), 1), ("b", day(1), 2)) == [1, 2]
    assert run(("a", day(2), 3), ("c", day(10), 4)) == [1, 2, 4]  # a is known still
    assert run(("d", day(5), 5), ("a", day(10), 6)) == [1, 2, 4, 6]  # d comes too late, a has left the state
    assert run(("a", day(11), 7)) == [1, 2, 4, 6]
    versions = out.versions().count()
    assert run(("c", day(11), 8)) == [1, 2, 4, 6]
    out.append(out.read(), token="recent:0")
    assert out.versions().count() >= versions and sorted(r.n for r in out.read().collect()) == [1, 2, 4, 6]


def test_closed_days_are_written_once_and_late_runs_apart(spark, tmp_path):
    folder, hour = str(tmp_path / "runs"), timedelta(hours=1)
    start, ids = datetime(2026, 1, 1), iter(range(1000))
    closed, late = StoredTable(spark, str(tmp_path / "closed"), ingest.CLOSED_DAYS), StoredTable(spark, str(tmp_path / "late"), ingest.DAILY_COUNTS)
    marks = StoredTable(spark, str(tmp_path / "marks"), ingest.MARKS)

    def run(*hours):
        land(spark, folder, [(next(ids), "s", start + h * hour, None, "error" if h % 2 else "ok", 1, 0, None) for h in hours], RUNS)
        landed = ingest.read_landing(spark, folder, RUNS)
        ingest.closed_days_stream(landed, closed, str(tmp_path / "c1"), "12 hours").awaitTermination()
        ingest.late_counts_stream(ingest.read_landing(spark, folder, RUNS), late, marks, str(tmp_path / "c2"), "12 hours").awaitTermination()
        days = sorted((r.day.day, r.runs, r.errors) for r in closed.read().collect())
        return days, sorted((r.day.day, r.runs) for r in ingest.daily_totals(late.read()).collect())

    assert run(1, 2, 30) == ([], [])
    assert run(3, 40) == ([(1, 3, 2)], [])  # the watermark has reached hour 28, behind day 1
    assert run(4, 5, 41) == ([(1, 3, 2)], [(1, 2)])
    assert run(100, 6) == ([(1, 3, 2), (2, 3, 1)], [(1, 3)])
    assert marks.read().count() == 4


def judge_all(spark, folder, judged, edges, tmp_path, n):
    for stream, check in ((health.run_health_states, "check"), (health.late_runs_stream, "check-late")):
        query = stream(ingest.read_landing(spark, folder, RUNS), judged, edges, str(tmp_path / check), n=n)
        assert query.awaitTermination(120), "the stream goes on"


def test_health_states_match_the_batch_rule(spark, tmp_path):
    from postmill.operators.runs import run_status

    start = datetime(2026, 1, 1)
    kinds = lambda i: "running" if i % 17 == 0 else "error" if i % 11 == 0 else "ok"
    rows = [(i, f"s{i % 2 if i % 5 else 0}", start + timedelta(minutes=7 * i), None, kinds(i), 4 if i % 23 == 0 else 0, 0, None) for i in range(160)]
    frame, folder = spark.createDataFrame(rows, RUNS), str(tmp_path / "runs")
    judged, edges = StoredTable(spark, str(tmp_path / "judged"), health.VERDICTS), StoredTable(spark, str(tmp_path / "edges"), health.EDGES)
    late = [i for i in range(20, 60, 9)]
    parts = [[i for i in range(k, min(k + 60, 160)) if i not in late] for k in (0, 60, 120)] + [late]
    for ids in parts:
        frame.filter(F.col("id").isin(ids)).coalesce(1).write.mode("append").parquet(folder)
        judge_all(spark, folder, judged, edges, tmp_path, 4)
    got = {r.id: (r.had_postings, r.derived_status) for r in judged.read().collect()}
    on_time = {r.id: (r.had_postings, r.derived_status) for r in run_status(frame.filter(~F.col("id").isin(late)), 4).collect()}
    every = {r.id: (r.had_postings, r.derived_status) for r in run_status(frame, 4).collect()}
    assert got == {**on_time, **{i: every[i] for i in late if i in every}}
    assert judged.read().count() == len(got)
    # A source's hour is a key of its own; its edges are at most its first and last runs.
    newest = edges.read().groupBy("source", "chunk_end", "batch_id").count()
    assert newest.agg(F.max("count")).first()[0] <= 8


def test_runs_behind_a_late_one_see_it(spark, tmp_path):
    start = datetime(2026, 1, 1)
    rows = [(i, "s", start + timedelta(hours=i), None, "ok", 5 if i == 3 else 0, 0, None) for i in range(12)]
    frame, folder = spark.createDataFrame(rows, RUNS), str(tmp_path / "runs")
    judged, edges = StoredTable(spark, str(tmp_path / "judged"), health.VERDICTS), StoredTable(spark, str(tmp_path / "edges"), health.EDGES)
    for ids in ((0, 1, 2, 4, 5, 6, 7, 8), (3,), (9, 10, 11)):
        frame.filter(F.col("id").isin(*ids)).coalesce(1).write.mode("append").parquet(folder)
        judge_all(spark, folder, judged, edges, tmp_path, 7)
    got = {r.id: (r.had_postings, r.derived_status) for r in judged.read().collect()}
    assert [i for i, (had, _) in sorted(got.items()) if had] == [9, 10] and got[9] == (True, "warning") and got[11] == (False, "ok")
