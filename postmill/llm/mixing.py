"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

A source's target is a number of words. Each document first takes the whole copies that its expected number holds, with certainty. The fractional
rest is its inclusion probability pi for one copy more: documents are ranked by the odds of a random number u over the odds of pi, and the ranking is
taken from its start until the words still missing are reached.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.shared import columns
from postmill.operators.ordering import numbered
from postmill.session import stage

#: Bins of the ranking for one source. Only the bin in which the target is reached is sorted, so no task sorts a source.
BINS = 1 << 15
_UNIT = float(1 << 52)


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column, seed: int) -> Column:
    """A random number in (0, 1) that depends on the document alone, so a task that runs again draws the same."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(_UNIT)


def _share_out(rows: DataFrame, total: Column, bound: Column, weight: Column, within: list[str]) -> DataFrame:
    """``rows`` with ``level``, such that min(bound, level * weight) adds up to ``total``; null where every row is at its bound.

    In order of bound over weight, rows before some place are at their bound, and the level is what they leave over the weight behind them.
    The windows have one row for a source (or a source's tier).
    """
    order = Window.partitionBy(*within).orderBy("_ratio", "_at")
    every, before = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_bound", bound).withColumn("_weight", weight).withColumn("_ratio", F.when(F.col("_weight") > 0, F.col("_bound") / F.col("_weight")))
    rows = rows.withColumn("_at", F.monotonically_increasing_id())
    left = total - F.coalesce(F.sum("_bound").over(before), F.lit(0.0))
    weight_left = F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    rows = rows.withColumn("_level", F.when(weight_left > 0, left / weight_left))
    open_level = F.when(F.col("_level") * F.col("_weight") < F.col("_bound"), F.col("_level"))
    return rows.withColumn("level", F.first(open_level, ignorenulls=True).over(every)).drop("_bound", "_weight", "_ratio", "_at", "_level")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size, target) for ``sizes(source, source_size)``.

    Sources in order of code points, null last, get ``weights`` in turn. Targets share ``share`` times all sizes by weight; none is over ``most``
    times its source's size, and what would be over goes to the others by weight.
    """
    # String order is the order of UTF-8 bytes, which is that of code points.
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    rows = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights)).cast("int") + 1))
    rows = rows.withColumn("_sum", F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy()))
    bound = F.lit(float(most)) * F.col("source_size")
    rows = _share_out(rows, F.col("_sum"), bound, F.col("_w"), [])
    return rows.select("source", "source_size", F.coalesce(F.least(bound, F.col("level") * F.col("_w")), bound).alias("target"))


def shares(sized: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, tier, words, source_size, target, whole, pi) for ``sized(source, tier, size)``: a document of that source and tier has ``whole``
    certain copies and one more with probability ``pi``. Expected copies follow the tier, none over ``most``."""
    rows = stage(sized.groupBy("source", "tier").agg(F.sum("size").alias("words")), "tiers")
    goal = stage(targets(rows.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most), "targets")
    rows = _with(rows, goal, "source")
    rows = _share_out(rows, F.col("target"), F.lit(float(most)) * F.col("words"), F.col("words") * F.col("tier"), ["source"])
    copies = F.least(F.lit(float(most)), F.coalesce(F.col("level") * F.col("tier"), F.lit(float(most))))
    # A number of copies that is whole but for rounding is whole.
    copies = F.when(F.abs(copies - F.round(copies)) < 1e-9, F.round(copies)).otherwise(copies)
    return stage(rows.select("source", "tier", "words", "source_size", "target", F.floor(copies).alias("whole"), (copies - F.floor(copies)).alias("pi")), "shares")


def _with(rows: DataFrame, small: DataFrame, *keys: str) -> DataFrame:
    """``rows`` and the columns of ``small``, which has one row a key and is a stored table of known size; nulls are a key."""
    other = small.toDF(*[f"_{k}" if k in keys else k for k in small.columns])
    on = [rows[k].eqNullSafe(other[f"_{k}"]) for k in keys]
    return rows.join(other, on, "left").drop(*[f"_{k}" for k in keys])


def _rank() -> Column:
    odds = F.col("draw") / (F.lit(1.0) - F.col("draw"))
    return F.when((F.col("pi") > 0) & (F.col("size") > 0), odds / (F.col("pi") / (F.lit(1.0) - F.col("pi"))))


def _bin() -> Column:
    return F.floor(F.lit(float(BINS)) * (F.col("rank") / (F.lit(1.0) + F.col("rank"))))


def cuts(sized: DataFrame, table: DataFrame) -> DataFrame:
    """(source, last_bin, stop_rank, stop_draw, stop_rows, stop_taken): where each source's ranking stops; no row for a source that draws nothing.

    Bins are summed map-side, and a window adds up at most BINS rows a source. The documents of the one bin in which the target lies are summed by
    rank (copies of one row are one rank) and ordered. A document is taken if its middle lies before the target, so the error is at most half a
    document; of the ``stop_rows`` rows that repeat one document at the very stop, ``stop_taken`` are.
    """
    missing = table.groupBy("source").agg((F.first("target") - F.sum(F.col("whole") * F.col("words"))).alias("missing"))
    missing = stage(missing, "missing")
    ranked = _with(sized, table, "source", "tier").withColumn("rank", _rank()).filter("rank is not null").withColumn("bin", _bin())
    bins = ranked.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    over = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = _with(bins.withColumn("before", F.coalesce(F.sum("words").over(over), F.lit(0))), missing, "source").filter("before < missing")
    last = stage(bins.groupBy("source").agg(F.max("bin").alias("last_bin"), F.max("before").alias("before"), F.first("missing").alias("missing")), "bins")
    inside = _with(ranked.select("source", "bin", "rank", "draw", "size"), last, "source").filter("bin = last_bin")
    rows = inside.groupBy("source", "rank", "draw").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"), F.first("before").alias("before"), F.first("missing").alias("missing"))
    so_far = F.col("before") + F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("rank", "draw").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = F.least(F.col("rows"), F.greatest(F.lit(0), F.ceil((F.col("missing") - so_far) / (F.col("words") / F.col("rows")) - 0.5)))
    rows = rows.withColumn("taken", taken).filter("taken < rows")
    stop = F.min(F.struct("rank", "draw", "rows", F.col("taken").cast("long").alias("taken")))
    stops = rows.groupBy("source").agg(stop.alias("stop"))
    return stage(_with(last.select("source", "last_bin"), stops, "source").select("source", "last_bin", "stop.*").toDF("source", "last_bin", "stop_rank", "stop_draw", "stop_rows", "stop_taken"), "cuts")


def sized(docs: DataFrame, seed: int, tier: str | None = None) -> DataFrame:
    """(doc_id, source, size, tier, draw) of every row."""
    rows = columns(docs, "doc_id", "source", "text", *([tier] if tier else []))
    own = F.greatest(F.coalesce(F.col(tier).cast("double"), F.lit(0.0)), F.lit(0.0)) if tier else F.lit(1.0)
    return rows.select("doc_id", "source", word_count(F.col("text")).alias("size"), own.alias("tier"), draw(F.col("doc_id"), F.col("text"), seed).alias("draw"))


def copies(rows: DataFrame, table: DataFrame, stops: DataFrame) -> DataFrame:
    """``rows(source, tier, size, draw, ...)`` with source_size, target and ``copies``. Only the two small tables are joined: nothing is shuffled, but for
    rows that repeat one document at a source's stop, if there are any: they are numbered, so that just as many are taken as the stop says."""
    names = [*rows.columns, "source_size", "target", "copies"]
    rows = _with(_with(rows, table.drop("words"), "source", "tier"), stops, "source").withColumn("rank", _rank()).withColumn("bin", _bin())
    earlier = (F.col("rank") < F.col("stop_rank")) | ((F.col("rank") == F.col("stop_rank")) & (F.col("draw") < F.col("stop_draw")))
    at_stop = F.coalesce((F.col("bin") == F.col("last_bin")) & (F.col("rank") == F.col("stop_rank")) & (F.col("draw") == F.col("stop_draw")), F.lit(False))

    def counted(taken: Column) -> Column:
        more = (F.col("bin") < F.col("last_bin")) | ((F.col("bin") == F.col("last_bin")) & (F.col("stop_rank").isNull() | earlier)) | (at_stop & taken)
        return (F.coalesce(F.col("whole"), F.lit(0)) + F.when(more, 1).otherwise(0)).alias("copies")

    if stops.filter("stop_rows > 1").isEmpty():
        return rows.withColumn("copies", counted(F.col("stop_taken") > 0)).select(*names)
    single = rows.filter(~at_stop | (F.col("stop_rows") == 1)).withColumn("copies", counted(F.col("stop_taken") > 0)).select(*names)
    repeated = numbered(rows.filter(at_stop & (F.col("stop_rows") > 1)).orderBy("source", F.monotonically_increasing_id()), "_place")
    first = stage(repeated.groupBy("source").agg((F.min("_place") - 1).alias("_first")), "first-places")
    repeated = _with(repeated, first, "source").withColumn("copies", counted(F.col("_place") - F.col("_first") <= F.col("stop_taken")))
    return single.unionByName(repeated.select(*names))


def mixture(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 42, tier: str | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of ``docs(doc_id, source, text)``.

    ``size`` is the number of words, ``copies`` how often the mix holds the document, ``taken`` = size * copies. ``tier`` names a column with the
    document's relative weight within its source (few distinct values; null and negative: 0). Copies are whole or none, at most ``most`` rounded up.
    A null source is a source of its own; null, empty and blank texts have size 0 and are taken as often as the whole copies say; a repeated row is
    a document of its own; a null doc_id is a value like any other; extra columns are left out; an empty table gives no rows.
    """
    rows = stage(sized(docs, seed, tier), "sizes")
    table = shares(rows, weights, share, most)
    found = copies(rows, table, cuts(rows, table))
    return found.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 42, tier: str | None = None) -> DataFrame:
    """The mixed documents themselves, each row as often as it is taken, with the columns of ``docs``."""
    rows = stage(sized(docs, seed, tier), "sizes")
    table = shares(rows, weights, share, most)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = {n: F.col(f"c{docs.columns.index(n)}") for n in ("doc_id", "source", "text", *([tier] if tier else []))}
    own = F.greatest(F.coalesce(at[tier].cast("double"), F.lit(0.0)), F.lit(0.0)) if tier else F.lit(1.0)
    marked = plain.select(*plain.columns, at["source"].alias("source"), word_count(at["text"]).alias("size"), own.alias("tier"), draw(at["doc_id"], at["text"], seed).alias("draw"))
    found = copies(marked, table, cuts(rows, table)).filter("copies > 0")
    found = found.select(*plain.columns, F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_copy"))
    return found.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(docs.columns)])
