"""First-wins selection, duplicate groups and set difference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions.text import ascii_lower

# Duplicate ranking splits a group by id range, so that no task sorts more than this many ids.
ID_SPAN = 1 << 20


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int = 1) -> DataFrame:
    """The first ``n`` rows per key.

    The rank bound lets Spark keep only ``n`` rows per key and map task before the shuffle
    (WindowGroupLimit), so a key with a third of all rows still ships few of them.
    """
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(ranked)).filter(F.col("_rank") <= n).drop("_rank")


def dedupe_by_url(df: DataFrame, order: Sequence[Column | str] = ("seq", "pos")) -> DataFrame:
    """First posting per source and URL, in arrival order."""
    return first_rows(df, ["source", "url"], order)


def cap_per_source(df: DataFrame, n: int | None, order: Sequence[Column | str] = ("seq", "pos")) -> DataFrame:
    """First ``n`` rows of every source; None keeps all."""
    return df if n is None else first_rows(df, ["source"], order, n)


def left_out(df: DataFrame, n: int) -> DataFrame:
    """(source, rows): how many rows of each source a cap of ``n`` leaves out."""
    return df.groupBy("source").agg((F.count(F.lit(1)) - n).alias("rows")).filter("rows > 0")


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The latest row per key."""
    return first_rows(df, keys, [F.desc(c) for c in order])


def except_stored(batch: DataFrame, stored: DataFrame, key: str = "dedupe_key") -> DataFrame:
    """Batch rows whose key is not stored.

    The stored keys are first reduced to those in the batch. The batch is the smaller side by
    far, so that step can run as a broadcast or Bloom-filtered semi join, and the big key column
    is not shuffled for every batch.
    """
    seen = stored.select(key).join(batch.select(key), key, "left_semi")
    return batch.join(seen, key, "left_anti")


def _group_columns(match_location: bool) -> dict[str, Column]:
    cols = {"normalized_title": ascii_lower(F.trim("title")), "normalized_company": ascii_lower(F.trim("company"))}
    if match_location:
        cols["normalized_location"] = ascii_lower(F.trim("location"))
    return cols


def duplicate_groups(df: DataFrame, match_location: bool = False) -> DataFrame:
    """Groups of equal title and company with more than one row and more than one key.

    Keys are never NULL, so min <> max says the same as a distinct count without its expansion.
    """
    cols = _group_columns(match_location)
    return (
        df.groupBy(*[c.alias(name) for name, c in cols.items()])
        .agg(F.count(F.lit(1)).alias("rows"), F.min("dedupe_key").alias("_lo"), F.max("dedupe_key").alias("_hi"))
        .filter((F.col("rows") > 1) & (F.col("_lo") != F.col("_hi")))
        .drop("_lo", "_hi")
    )


def _group_slices(keyed: DataFrame, names: list[str]) -> DataFrame:
    """Per duplicate group and id range: first id of the group, rows in earlier ranges."""
    slices = keyed.groupBy(*names, "_slice").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("id").alias("_first"),
        F.min("dedupe_key").alias("_lo"),
        F.max("dedupe_key").alias("_hi"),
    )
    # One row per id range here, not per posting, so a group of any size is a short window.
    group = Window.partitionBy(*names)
    earlier = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return (
        slices.select(
            *names,
            "_slice",
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
            F.sum("_n").over(group).alias("_rows"),
            F.min("_first").over(group).alias("_first_id"),
            F.min("_lo").over(group).alias("_min_key"),
            F.max("_hi").over(group).alias("_max_key"),
        )
        .filter((F.col("_rows") > 1) & (F.col("_min_key") != F.col("_max_key")))
        .select(*names, "_slice", "_before", "_first_id")
    )


def _keyed(df: DataFrame, match_location: bool, id_span: int) -> tuple[DataFrame, list[str]]:
    cols = _group_columns(match_location)
    keyed = df.withColumns({**cols, "_slice": F.floor(F.col("id") / id_span)})
    return keyed, list(cols)


def find_duplicates(df: DataFrame, match_location: bool = False, id_span: int = ID_SPAN) -> DataFrame:
    """Every row of a duplicate group but its lowest id, with its rank in the group.

    Groups are cut into id ranges: rows are ranked within a range, and the rows of earlier
    ranges are added. The location does not count unless ``match_location`` is set, so one role
    in two cities is a duplicate, as in the stored clean-up rule.
    """
    keyed, names = _keyed(df, match_location, id_span)
    within = Window.partitionBy(*names, "_slice").orderBy("id")
    return (
        keyed.join(_group_slices(keyed, names), [*names, "_slice"])
        .withColumn("duplicate_rank", (F.row_number().over(within) + F.col("_before")).cast("long"))
        .filter(F.col("duplicate_rank") > 1)
        .select(*df.columns, "duplicate_rank")
    )


def order_duplicates(dups: DataFrame) -> DataFrame:
    return dups.orderBy(ascii_lower("company"), ascii_lower("title"), "id")


def flag_duplicates(df: DataFrame, match_location: bool = False, id_span: int = ID_SPAN) -> DataFrame:
    """``df`` with ``is_duplicate``: true for the rows :func:`find_duplicates` returns."""
    keyed, names = _keyed(df, match_location, id_span)
    flag = F.coalesce(F.col("id") > F.col("_first_id"), F.lit(False))
    return (
        keyed.join(_group_slices(keyed, names), [*names, "_slice"], "left")
        .withColumn("is_duplicate", flag)
        .select(*df.columns, "is_duplicate")
    )
