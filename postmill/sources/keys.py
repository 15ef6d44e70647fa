"""The keys of a stored table, in buckets, so that a batch is tested without reading the table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.sources.tables import StoredTable

BUCKETS = 64


class KeyIndex:
    """The keys of one stored table, a partition for each bucket of their hash. It is derived: it follows the table's versions, and can be made anew."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str] = ("dedupe_key",), buckets: int = BUCKETS):
        self.keys, self.buckets = list(keys), buckets
        fields = [f for f in schema if f.name in self.keys]
        self.table = StoredTable(spark, path, T.StructType([*fields, T.StructField("bucket", T.IntegerType())]), ["bucket"])

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _keyed(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.keys, self.bucket().alias("bucket"))

    def follow(self, table: StoredTable) -> KeyIndex:
        """Take in what the table has got since it was last followed: appended rows alone, or all rows if some were changed."""
        last = self.table.versions().agg(F.max(F.substring("token", 9, 20).cast("long"))).first()[0] or 0
        now = table.version()
        if now > last:
            token = f"version={now}"
            try:
                self.table.append(self._keyed(table.added(last, now)), token)
            except ValueError:
                self.table.replace(self._keyed(table.read(now)), token)
        return self

    def near(self, batch: DataFrame) -> DataFrame:
        """The stored keys in the buckets of the batch's keys; the other buckets' files are not read. One number a bucket reaches the driver."""
        used = sorted(r[0] for r in batch.select(self.bucket()).distinct().collect())
        return self.table.read().filter(F.col("bucket").isin(used)).select(*self.keys)

    def unseen(self, batch: DataFrame) -> DataFrame:
        """The rows whose key is not stored; a null is a value like any other. ``batch`` is read twice."""
        stored = self.near(batch).toDF(*[f"_{k}" for k in self.keys])
        same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.keys))
        return batch.join(stored, same, "left_anti")


def key_index(table: StoredTable, keys: Sequence[str] = ("dedupe_key",), buckets: int = BUCKETS) -> KeyIndex:
    """The table's own index, kept beside it and up to date with it."""
    return KeyIndex(table.spark, f"{table.path}/keys-{'-'.join(keys)}", table.schema, keys, buckets).follow(table)
