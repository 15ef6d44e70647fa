"""Statistics and duplicates that follow a stored table: each version's new rows are folded into mergeable partials, and only touched groups are looked at."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.functions.text import ascii_lower
from postmill.operators.dedupe import _group_columns
from postmill.session import stage
from postmill.sources.tables import StoredTable

#: name: (how rows are folded, how partials are merged), as SQL.
Folds = dict[str, tuple[str, str]]

COMPANY_FOLDS: Folds = {
    "total_jobs": ("count(1)", "sum(total_jobs)"),
    "latest_job_date": ("max(date_posted)", "max(latest_job_date)"),
    "top_score": ("max(score)", "max(top_score)"),
}
# A group's rows count as duplicates if it has more than one row and more than one key.
GROUP_FOLDS: Folds = {
    "rows": ("count(1)", "sum(rows)"),
    "first_id": ("min(id)", "min(first_id)"),
    "low_key": ("min(dedupe_key)", "min(low_key)"),
    "high_key": ("max(dedupe_key)", "max(high_key)"),
}


def folded(folds: Folds, merge: bool = False) -> list[Column]:
    return [F.expr(how[merge]).alias(name) for name, how in folds.items()]


def is_duplicate_group(prefix: str = "") -> Column:
    return (F.col(f"{prefix}rows") > 1) & (F.col(f"{prefix}low_key") != F.col(f"{prefix}high_key"))


class Partials:
    """Mergeable aggregates of a stored table, a commit for each version that was followed."""

    def __init__(self, table: StoredTable, path: str, keys: dict[str, Column], folds: Folds):
        self.source, self.keys, self.folds = table, keys, folds
        empty = self._fold(table.spark.createDataFrame([], table.schema))
        self.table = StoredTable(table.spark, path, T.StructType([T.StructField(f.name, f.dataType) for f in empty.schema]))

    def _fold(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*[c.alias(name) for name, c in self.keys.items()]).agg(*folded(self.folds))

    def _merge(self, parts: DataFrame) -> DataFrame:
        return parts.groupBy(*self.keys).agg(*folded(self.folds, merge=True))

    def followed(self) -> int:
        """The version that was followed last."""
        return self.table.versions().filter("token like 'version=%'").agg(F.max(F.substring("token", 9, 20).cast("long"))).first()[0] or 0

    def follow(self) -> None:
        """Fold in what the table has got since. Its rows are read from the new commits alone, unless rows were changed: then all are."""
        last, now = self.followed(), self.source.version()
        if now > last:
            token = f"version={now}"
            try:
                self.table.append(self._fold(self.source.added(last, now)), token)
            except ValueError:
                self.table.replace(self._fold(self.source.read(now)), token)

    def read(self) -> DataFrame:
        return self._merge(self.table.read())

    def compact(self) -> None:
        """One row a group instead of one for each commit that touched it."""
        self.table.replace(self.read())


def company_partials(table: StoredTable, path: str) -> Partials:
    return Partials(table, path, {"company_key": ascii_lower("company")}, COMPANY_FOLDS)


class Duplicates:
    """The ids of a table's duplicate rows, kept up to date: all rows but the lowest id of a duplicate group (see dedupe.find_duplicates)."""

    def __init__(self, table: StoredTable, path: str, match_location: bool = False):
        self.source = table
        self.groups = Partials(table, f"{path}/groups", _group_columns(match_location), GROUP_FOLDS)
        self.found = StoredTable(table.spark, f"{path}/found", T.StructType([T.StructField("id", T.LongType())]))

    def _keyed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns(self.groups.keys)

    def follow(self) -> None:
        """Take in the table's new rows.

        A new row is a duplicate if its group is one now and has a lower id. Rows that were there before become duplicates where a group became one, and
        where a new row has the lowest id: only for groups that became one are stored rows read, by a semi join of the table with those groups.
        """
        last, now = self.groups.followed(), self.source.version()
        if now <= last:
            return
        try:
            added = stage(self._keyed(self.source.added(last, now)).select("id", "dedupe_key", *self.groups.keys), "added")
        except ValueError:
            return self._again(now)
        names = list(self.groups.keys)
        new = self.groups._merge(added.groupBy(*names).agg(*folded(GROUP_FOLDS)))
        renamed = new.toDF(*[f"_{c}" for c in new.columns])
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names]
        old = self.groups._merge(self.groups.table.read().join(renamed, same, "left_semi")).select(*names, *[F.col(c).alias(f"old_{c}") for c in GROUP_FOLDS])
        both = old.join(renamed, same, "right")
        after = {
            "rows": F.coalesce("old_rows", F.lit(0)) + F.col("_rows"),
            "first_id": F.least("old_first_id", "_first_id"),
            "low_key": F.least("old_low_key", "_low_key"),
            "high_key": F.greatest("old_high_key", "_high_key"),
        }
        touched = both.select(*[F.col(f"_{c}").alias(c) for c in names], *[c.alias(n) for n, c in after.items()], *[f"old_{c}" for c in GROUP_FOLDS])
        touched = stage(touched.filter(is_duplicate_group()), "touched")
        was = F.coalesce(is_duplicate_group("old_"), F.lit(False))
        ids = [self._later(added, touched.select(*names, "first_id"), names)]
        # The group's first row so far, if a new one has a lower id.
        ids.append(touched.filter(was & (F.col("old_first_id") > F.col("first_id"))).select(F.col("old_first_id").alias("id")))
        became = touched.filter(~was & F.col("old_rows").isNotNull()).select(*names, "first_id")
        if not became.isEmpty():
            ids.append(self._later(self._keyed(self.source.read(last)).select("id", *names), became, names))
        self.found.append(ids[0].unionAll(ids[1]) if len(ids) == 2 else ids[0].unionAll(ids[1]).unionAll(ids[2]), f"version={now}")
        self.groups.table.append(new, f"version={now}")

    def _again(self, now: int) -> None:
        from postmill.operators.dedupe import find_duplicates

        self.found.replace(find_duplicates(self.source.read(now).select("id", "title", "company", "location", "dedupe_key"), "normalized_location" in self.groups.keys).select("id"), f"version={now}")
        self.groups.follow()

    @staticmethod
    def _later(rows: DataFrame, groups: DataFrame, names: Sequence[str]) -> DataFrame:
        """Ids of rows behind their group's first one."""
        other = groups.toDF(*[f"_{c}" for c in groups.columns])
        return rows.join(other, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names]).filter(F.col("id") > F.col("_first_id")).select("id")

    def read(self) -> DataFrame:
        """(id), each once."""
        return self.found.read()
