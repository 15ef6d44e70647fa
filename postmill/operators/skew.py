"""Joins against lookup tables that stay balanced when one key holds much of the big side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A lookup is broadcast only when a count proves it has at most this many rows.
BROADCAST_ROWS = 100_000
# At most this many keys are ever treated as hot, so the hot list itself is always broadcastable.
HOT_KEYS = 256
HOT_MIN_ROWS = 1_000_000
FAN_OUT = 64


def is_small(dim: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when ``dim`` has at most ``rows`` rows. Stops counting just beyond that."""
    return dim.select(F.lit(1)).limit(rows + 1).count() <= rows


def hot_keys(big: DataFrame, keys: Sequence[str], min_rows: int = HOT_MIN_ROWS) -> DataFrame:
    """The keys with at least ``min_rows`` rows, at most HOT_KEYS of them, largest first."""
    counts = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return counts.orderBy(F.desc("_rows")).limit(HOT_KEYS).filter(F.col("_rows") >= min_rows).drop("_rows")


def salted_join(
    big: DataFrame,
    dim: DataFrame,
    keys: Sequence[str],
    spread: str,
    how: str = "left",
    min_rows: int = HOT_MIN_ROWS,
    fan_out: int = FAN_OUT,
) -> DataFrame:
    """Shuffle join in which rows of a hot key go to ``fan_out`` tasks.

    ``spread`` is a column that varies within a key; its hash picks the task, so a re-run task
    routes its rows as before. Only the lookup rows of hot keys are replicated.
    """
    keys = list(keys)
    hot = F.broadcast(hot_keys(big, keys, min_rows).withColumn("_hot", F.lit(True)))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(fan_out)).cast("int")).otherwise(0)
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(fan_out - 1))).otherwise(F.array(F.lit(0)))
    left = big.join(hot, keys, "left").withColumn("_salt", salt).drop("_hot")
    right = dim.join(hot, keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def lookup_join(
    big: DataFrame, dim: DataFrame, keys: Sequence[str], spread: str, how: str = "left", rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Join with a lookup of one row per key: broadcast if its counted size allows, else salted."""
    if is_small(dim, rows):
        return big.join(F.broadcast(dim), list(keys), how)
    return salted_join(big, dim, keys, spread, how)
