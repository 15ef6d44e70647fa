"""The pipeline against brute force, stage by stage, on the smallest tables."""

import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_simhash import brute_fingerprint, brute_roots
from test_tiling import brute_tiles, words

import corpus_pipeline
from postmill.llm.encoder import Encoder
from postmill.llm.mixing import mixture
from postmill.llm.quality import quality, train

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    table = {r.doc_id: r for r in docs.collect()}
    outs = []
    for k, (_, function) in enumerate(corpus_pipeline.STAGES):
        function(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        outs.append(docs)
        if k < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
            assert all(r == table[r.doc_id] for r in docs.collect())
    model = train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"), rows=2_000)
    good = {r.doc_id for r in quality(spark.read.parquet(f"{SF}/documents.parquet"), model).collect() if r.kept}
    assert {r.doc_id for r in outs[0].collect()} == good
    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality == 0}
    assert len(bad & good) <= 0.05 * len(bad)
    roots = brute_roots({i: brute_fingerprint(table[i].text) for i in good}, 3)
    assert {r.doc_id for r in outs[1].collect()} == set(roots.values())
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = set()
    for i in set(roots.values()):
        text = words(table[i].text)
        seeds = {tuple(text[k : k + 5]) for k in range(len(text) - 4)}
        for item in items:
            if any(tuple(item[k : k + 5]) in seeds for k in range(len(item) - 4)) and sum(n for *_, n in brute_tiles(item, text, 5)) >= 0.8 * len(item):
                leaks.add(i)
    assert {r.doc_id for r in outs[2].collect()} == set(roots.values()) - leaks and leaks
    copies = {r.doc_id: r.copies for r in mixture(outs[2]).collect() if r.copies}
    mixed = [r.doc_id for r in outs[3].collect()]
    assert {i: mixed.count(i) for i in set(mixed)} == copies
    rows = sorted(outs[4].collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(mixed)
    codec, at = Encoder().library, 0
    for r in rows:
        ids = np.array([*codec.encode(table[r.doc_id].text, add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_run_is_all_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100 and 4 <= len(corpus_pipeline.STAGES) <= 5


def staged(spark, docs, folder):
    """The rows of every stage's result."""
    out = []
    for k, (_, function) in enumerate(corpus_pipeline.STAGES):
        function(spark, docs, SF).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs.collect())
    return out


def test_nulls_repeats_and_clashing_names(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    names = corpus_pipeline.COLUMNS
    good = " ".join(f"clear{i} words{i % 7} of an{i % 11} honest text{i % 13}." for i in range(60))
    odd = [(None, good + " first", "en", "odd", 1), (None, good + " and another one at the end of it", None, None, None), (900_000, None, "en", "odd", 0), (900_001, "", "en", "odd", 0), (900_002, " \n", None, "odd", 0),
           (900_003, "repeated " + good, "en", "odd", 1), (900_003, "repeated " + good, "en", "odd", 1), (900_004, "long " * 50_000, "en", "odd", 1)]
    rows = docs.select(*names).unionAll(spark.createDataFrame(odd, docs.select(*names).schema))
    clashing = rows.select("*", F.lit("x").alias("TEXT"), F.lit(7).alias("Doc_Id"), F.lit(1).alias("row"), F.lit(2).alias("copies"))
    plain, clash = staged(spark, rows, tmp_path / "plain"), staged(spark, clashing, tmp_path / "clash")
    assert [sorted(map(str, r)) for r in plain] == [sorted(map(str, r)) for r in clash]
    ids = [{r.doc_id for r in stage} for stage in plain]
    # Texts without words, and one word again and again, fail the quality rules.
    assert not ids[0] & {900_000, 900_001, 900_002, 900_004} and all(after <= before for before, after in zip(ids, ids[1:]))
    assert sum(r.doc_id == 900_003 for r in plain[0]) in (0, 2) and sum(r.doc_id == 900_003 for r in plain[1]) <= 1
    assert len(plain[4]) == len(plain[3])


def test_empty_table(spark, tmp_path):
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert [len(rows) for rows in staged(spark, none, tmp_path)] == [0] * 5
