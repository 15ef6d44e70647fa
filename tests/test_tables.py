"""Stored tables: updates by units, bucketed keys, checked writes, and statistics that follow appended rows."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.operators import dedupe, incremental, store
from postmill.schema import POSTINGS
from postmill.sources.keys import KeyIndex, key_index
from postmill.sources.tables import Refused, StoredTable, postings_table, rejected_table

NOW = datetime(2026, 7, 10)


def postings(spark, rows):
    base = {
        "title": "T", "company": "C", "location": "L", "source": "s", "url": "u", "description": "d", "date_posted": None, "date_collected": NOW, "dedupe_key": "k",
        "status": "new", "score": None, "score_reason": None, "score_source": None, "created_at": NOW, "updated_at": NOW,
    }
    return spark.createDataFrame([tuple({**base, **r}[f.name] for f in POSTINGS) for r in rows], POSTINGS)


def files(table):
    """The files that hold the table's rows."""
    return {r[0] for r in table.read().select("_metadata.file_path").distinct().collect()}


@pytest.fixture
def table(spark, tmp_path):
    table = postings_table(spark, str(tmp_path))
    for k in range(3):
        table.append(postings(spark, [{"id": 100 * k + i, "source": f"s{i % 4}", "dedupe_key": f"{k}-{i}"} for i in range(8)]))
    return table


def test_an_update_keeps_the_files_of_other_units(spark, table):
    before, rows = files(table), {r.id: r for r in table.read().collect()}
    ids = spark.createDataFrame([(101,), (5,), (999,)], "id long")
    table.update(lambda rows: rows.withColumn("status", F.when(F.col("id").isin(101, 5), "applied").otherwise(F.col("status"))), ids)
    after = files(table)
    # Unit s1 of the first commit holds 1 and 5, that of the second 101 and 105; the other ten stay.
    assert len(before & after) == len(before) - 2 and len(after - before) >= 1
    now = {r.id: r for r in table.read().collect()}
    assert now.keys() == rows.keys() and {i for i in now if now[i] != rows[i]} == {5, 101}
    # Earlier versions read as they were, and a further update meets the rewritten unit.
    assert {r.id: r for r in table.read(3).collect()} == rows
    table.update(lambda rows: store.delete_by_id(rows, ids), ids)
    assert {r.id for r in table.read().collect()} == rows.keys() - {5, 101}
    assert table.update(lambda rows: rows, F.col("id") == -1) == 5
    plan = table.read()._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "commit" in plan.split("PartitionFilters")[1]


def test_a_repeated_token_updates_once(spark, table):
    double = lambda rows: rows.withColumn("score", F.coalesce("score", F.lit(1)) + 1)
    for _ in range(2):
        table.update(double, F.col("id") == 2, token="t")
    assert {r.score for r in table.read().filter("id = 2").collect()} == {2}


def test_null_partition_values_are_units(spark, tmp_path):
    table = StoredTable(spark, str(tmp_path), T.StructType.fromDDL("id long, source string"), ["source"])
    table.append(spark.createDataFrame([(1, None), (2, "a"), (3, "")], "id long, source string"))
    table.update(lambda rows: rows.filter("id <> 1"), F.col("id") == 1)
    assert {r.id for r in table.read().collect()} == {2, 3}


def test_added_rows_between_versions(spark, table):
    assert {r.id for r in table.added(1).collect()} == {100 * k + i for k in (1, 2) for i in range(8)}
    assert {r.id for r in table.added(1, 2).collect()} == {100 + i for i in range(8)}
    assert table.added(3).count() == 0
    table.update(lambda rows: rows, F.col("id") == 0)
    with pytest.raises(ValueError):
        table.added(3)


def test_only_the_buckets_of_a_batch_are_read(spark, tmp_path):
    table = postings_table(spark, str(tmp_path))
    table.append(postings(spark, [{"id": i, "dedupe_key": f"key {i}"} for i in range(500)]))
    index = key_index(table, buckets=64)
    batch = postings(spark, [{"id": 900, "dedupe_key": "key 7"}, {"id": 901, "dedupe_key": "new"}])
    near = index.near(batch)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    used = {r[0] for r in batch.select(index.bucket()).collect()}
    scanned = near.withColumn("f", F.col("_metadata.file_path")).select("f").distinct().collect()
    assert scanned and all(int(r.f.split("bucket=")[1].split("/")[0]) in used for r in scanned)
    assert index.table.read().select("bucket").distinct().count() == 64 > len(used)
    assert [r.id for r in index.unseen(batch).collect()] == [901]
    # The index follows appended rows without reading others again, and deletions by starting anew.
    table.append(postings(spark, [{"id": 901, "dedupe_key": "new"}]))
    assert key_index(table, buckets=64).unseen(batch).count() == 0
    assert index.table.versions().count() == 2 and key_index(table, buckets=64).table.versions().count() == 2
    table.update(lambda rows: rows.filter("id <> 7"), F.col("id") == 7)
    assert [r.id for r in key_index(table, buckets=64).unseen(batch).collect()] == [900]
    assert index.table.versions().agg(F.max("version")).first()[0] == 3


def test_null_keys_are_keys(spark, tmp_path):
    rows = spark.createDataFrame([("a", None, 1), (None, None, 2)], "x string, y long, id int")
    table = StoredTable(spark, str(tmp_path), rows.schema)
    table.append(rows.limit(1))
    index = KeyIndex(spark, f"{table.path}/k", table.schema, ["x", "y"], 8).follow(table)
    assert [r.id for r in index.unseen(rows).collect()] == [2]


def test_a_commit_that_breaks_rules_is_not_recorded(spark, tmp_path):
    table = postings_table(spark, str(tmp_path))
    table.rules["bad status"] = ~F.col("status").isin("new")
    with pytest.raises(Refused, match="bad status"):
        table.append(postings(spark, [{"id": 1}, {"id": 2, "status": "odd"}]))
    nullable = T.StructType([T.StructField(f.name, f.dataType) for f in POSTINGS])
    with pytest.raises(Refused, match="title is missing"):
        table.append(spark.createDataFrame(postings(spark, [{"id": 1}]).collect(), nullable).withColumn("title", F.lit(None).cast("string")))
    assert table.version() == 0 and table.read().count() == 0
    table.append(postings(spark, [{"id": 1}]))
    assert table.read().count() == 1


def test_valid_rows_are_appended_and_others_kept(spark, tmp_path):
    table = postings_table(spark, str(tmp_path))
    batch = postings(spark, [{"id": 1, "dedupe_key": "a"}, {"id": 2, "dedupe_key": "a"}, {"id": 3, "dedupe_key": "b", "status": "odd"}, {"id": 4, "dedupe_key": "b"}])
    rejected = rejected_table(table)
    counts = {r.error: r.rows for r in store.append_valid(table, batch, store.posting_rules(), rejected, token="1").collect()}
    assert counts == {"": 2, "dedupe_key repeats": 1, "bad status": 1}
    assert {r.id for r in table.read().collect()} == {1, 4}
    again = {r.error: r.rows for r in store.append_valid(table, batch, store.posting_rules(), rejected, token="2").collect()}
    assert again == {"dedupe_key is stored": 3, "bad status": 1}
    store.append_valid(table, batch, store.posting_rules(), rejected, token="1")
    assert table.read().count() == 2 and {(r.id, *r.errors) for r in rejected.read().collect()} >= {(2, "dedupe_key repeats"), (3, "bad status")}
    assert rejected.read().count() == 6


def test_incremental_duplicates_equal_the_full_search(spark, tmp_path):
    dice = random.Random(4)
    ids = dice.sample(range(1000), 60)
    rows = [{"id": i, "title": dice.choice(["Dev", " dev", "Ops"]), "company": dice.choice("ABCD"), "dedupe_key": dice.choice("kkkl")} for i in ids]
    table = postings_table(spark, str(tmp_path))
    found = incremental.Duplicates(table, str(tmp_path / "found"))
    stats = incremental.company_partials(table, str(tmp_path / "stats"))
    for k in range(0, 60, 15):
        table.append(postings(spark, rows[k : k + 15]))
        found.follow()
        stats.follow()
        found.follow()
        want = sorted(r.id for r in dedupe.find_duplicates(table.read()).collect())
        assert sorted(r.id for r in found.read().collect()) == want
    assert {(r.company_key, r.total_jobs) for r in stats.read().collect()} == {(c, sum(r["company"].lower() == c for r in rows)) for c in "abcd"}
    assert stats.table.versions().count() == 4
    stats.compact()
    assert sum(r.total_jobs for r in stats.table.read().collect()) == 60 and stats.table.read().count() == 4
    # After deletions all is counted anew.
    doomed = found.read()
    table.update(lambda rows: store.delete_by_id(rows, doomed), doomed)
    found.follow()
    stats.follow()
    assert found.read().count() == 0 and sum(r.total_jobs for r in stats.read().collect()) == table.read().count()
