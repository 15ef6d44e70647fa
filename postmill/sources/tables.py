"""Stored tables: Parquet folders with a version list.

Every commit writes a new folder and then adds one row to the version list, so readers never see
half a write, a writer may read the table it replaces, and a batch insert writes only its rows.
A commit may also take the place of some units of earlier ones, a unit being one partition of one
commit: an update rewrites the units that hold its rows, and the files of all others stay.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.schema import POSTINGS, RUN_EVENTS, WATCHLIST

class Refused(ValueError):
    """Rows of a commit break the table's rules. Nothing of it is in the table."""


VERSIONS = "version long, folder string, replaces boolean, token string, supersedes array<string>"
_UNIT = "_unit"


class StoredTable:
    """One table below ``path``. One writer at a time is assumed.

    Columns that may not be null, and ``rules`` (name: condition that breaks it), hold for every row: the write itself counts what breaks them, and a
    commit with such a row is not recorded.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, partition_by: Sequence[str] = (), rules: Mapping[str, Column] | None = None):
        self.spark, self.path, self.schema, self.partition_by = spark, path.rstrip("/"), schema, list(partition_by)
        required = {f"{f.name} is missing": F.col(f.name).isNull() for f in schema if not f.nullable}
        self.rules = {**required, **(rules or {})}

    def versions(self) -> DataFrame:
        try:
            return self.spark.read.schema(VERSIONS).parquet(f"{self.path}/versions")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], VERSIONS)

    def read(self, version: int | None = None) -> DataFrame:
        """The table now, or as of a version; empty before the first commit."""
        return self._units(version).select(*self.schema.names)

    def added(self, since: int, until: int | None = None) -> DataFrame:
        """The rows that commits after version ``since`` appended, up to ``until``. Raises ValueError if rows were changed in between."""
        commits = self.versions().filter((F.col("version") > since) & (F.col("version") <= F.lit(until) if until is not None else F.lit(True))).collect()
        if any(c.replaces or c.supersedes for c in commits):
            raise ValueError(f"rows were changed after version {since}")
        return self._folders([c.folder for c in commits]).select(*self.schema.names)

    def version(self) -> int:
        return self.versions().select(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def _folders(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema).withColumn(_UNIT, F.lit(""))
        reader = self.spark.read.schema(self.schema).option("basePath", f"{self.path}/data")
        # The commit's folder and those in it are partition columns, so a test of units skips files.
        parts = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("commit", *self.partition_by)]
        return reader.parquet(*[f"{self.path}/data/{f}" for f in folders]).withColumn(_UNIT, F.concat_ws("/", *parts))

    def _units(self, version: int | None = None) -> DataFrame:
        """The table's rows with the unit that holds each."""
        commits = self.versions()
        if version is not None:
            commits = commits.filter(F.col("version") <= version)
        base = commits.filter("replaces").select(F.coalesce(F.max("version"), F.lit(0))).scalar()
        # One short row per commit since the last replacement.
        commits = commits.filter(F.col("version") >= base).collect()
        rows = self._folders([c.folder for c in commits])
        gone = [unit for c in commits for unit in c.supersedes or []]
        return rows.filter(~F.col(_UNIT).isin(gone)) if gone else rows

    def update(self, change: Callable[[DataFrame], DataFrame], where: Column | DataFrame, token: str | None = None) -> int:
        """Put ``change(rows)`` in the place of the units that hold a row of ``where``: a condition, or a frame of ``id``. Other units keep their files.

        ``change`` gets all rows of those units, and must leave alone those it isn't meant for. One row a unit reaches the driver.
        """
        rows = self._units()
        held = rows.filter(where) if isinstance(where, Column) else rows.join(where.select("id"), "id", "left_semi")
        touched = sorted(r[0] for r in held.select(_UNIT).distinct().collect())
        if not touched:
            return self.version()
        return self._commit(change(rows.filter(F.col(_UNIT).isin(touched)).select(*self.schema.names)), False, token, touched)

    def replace(self, df: DataFrame, token: str | None = None) -> int:
        """Make ``df`` the table's content. Returns the new version."""
        return self._commit(df, True, token)

    def append(self, df: DataFrame, token: str | None = None) -> int:
        """Add rows. A repeated ``token`` (a replayed stream batch) adds nothing."""
        return self._commit(df, False, token)

    def _commit(self, df: DataFrame, replaces: bool, token: str | None, supersedes: Sequence[str] = ()) -> int:
        versions = self.versions()
        last, seen = versions.agg(
            F.coalesce(F.max("version"), F.lit(0)),
            F.coalesce(F.bool_or(F.col("token") == F.lit(token)), F.lit(False)),
        ).first()
        if token is not None and seen:
            return last
        folder = f"commit={last + 1:08d}-{uuid.uuid4().hex}"
        rows = df.select(*[F.col(f.name).cast(f.dataType) for f in self.schema])
        if self.partition_by:
            # Few files per value, and a value with many rows still goes to many tasks.
            rows = rows.hint("rebalance", *self.partition_by)
        broken = Observation()
        if self.rules:
            # Each count in a field of its own, which no rule's text can clash with.
            rows = rows.observe(broken, *[F.count_if(F.coalesce(test, F.lit(True))).alias(f"rule_{i}") for i, test in enumerate(self.rules.values())])
        rows.write.partitionBy(*self.partition_by).parquet(f"{self.path}/data/{folder}")
        if self.rules:
            counts = {name: n for name, n in zip(self.rules, (broken.get[f"rule_{i}"] for i in range(len(self.rules)))) if n}
            if counts:
                raise Refused(f"not committed: {counts}")
        entry = self.spark.createDataFrame([(last + 1, folder, replaces, token, list(supersedes))], VERSIONS)
        entry.coalesce(1).write.mode("append").parquet(f"{self.path}/versions")
        return last + 1


def rejected_table(table: StoredTable) -> StoredTable:
    """Where rows that the table refuses are kept, with what they break: beside it, and without rules."""
    fields = [T.StructField(f.name, f.dataType) for f in table.schema]
    return StoredTable(table.spark, f"{table.path}/rejected", T.StructType([*fields, T.StructField("errors", T.ArrayType(T.StringType()))]))


def postings_table(spark: SparkSession, root: str) -> StoredTable:
    return StoredTable(spark, f"{root}/postings", POSTINGS, ["source"])


def run_events_table(spark: SparkSession, root: str) -> StoredTable:
    """Starts and ends of runs. operators.runs.fold_run_events reads them as runs."""
    return StoredTable(spark, f"{root}/runs", RUN_EVENTS)


def watchlist_table(spark: SparkSession, root: str) -> StoredTable:
    return StoredTable(spark, f"{root}/watchlist", WATCHLIST)


def write_cards(cards: DataFrame, path: str) -> int:
    """Write one card per line, in order, and return how many were written."""
    written = Observation("cards")
    cards.select("card").observe(written, F.count(F.lit(1)).alias("rows")).write.text(path)
    return written.get["rows"]
