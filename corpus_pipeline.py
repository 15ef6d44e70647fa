"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

Stages judge rows, so a null or repeated doc_id is no burden: see the operators for what each does with null and empty texts, ties and repeated rows. Extra
columns are left out, even if their names differ from those of documents in case alone. An empty table passes through as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postmill.llm import mixing, quality, records, simhash, tiling
from postmill.llm.shared import batches_of_texts, columns
from postmill.session import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the classifier keep. It is trained on the labelled documents of the input."""
    batches_of_texts(spark)
    return quality.keep(columns(docs, *COLUMNS), quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), rows=2_000))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the least doc_id."""
    batches_of_texts(spark)
    return simhash.one_of_each(columns(docs, *COLUMNS), shingle=3, distance=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    batches_of_texts(spark)
    return tiling.clean(columns(docs, *COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), seed=5, threshold=0.8)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(columns(docs, *COLUMNS), weights=(5, 2, 1), share=1.5, most=2.0, seed=42)


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token records of the mix; a row for each record, as read back."""
    batches_of_texts(spark)
    return records.token_records(docs, vocabulary="byte_bpe_50k.json", end_id=0)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixture),
    ("token records", token_records),
]

#: SQL can express neither the classifier nor the fingerprints nor the encoding; tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
