"""How filters interact: what each one removes under every order in which they may be applied.

A document's failures are a bit mask, so all that the orders need is the number of documents of each part and mask. Each such cell is folded over the
array of all orders, which is a constant of the plan: ``transform`` goes through the orders, ``aggregate`` through the filters of one. That gives a
struct of counts for each order and step, weighted by the cell; cells are merged by sums element by element.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.shared import columns

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
#: n filters have n! orders, and each cell becomes n! * n structs.
MOST_FILTERS = 6
_SPACE = r"[\x20\x09-\x0D]+"


def text_rules(text: Column, min_words: int = 200, min_distinct: int = 50, max_capitals: int = 3, signs: str = "#$%&*|") -> dict[str, Column]:
    """Conditions under which a text fails: A too few words, B too few distinct words (percent), C too many capitals (percent), D any of some signs."""
    words = F.array_remove(F.split(text, _SPACE), "")
    n_words, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    return {
        "A": n_words < min_words,
        "B": 100 * distinct < min_distinct * n_words,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > max_capitals * F.char_length(text).cast("long"),
        "D": text.rlike("[" + "".join(f"\\{s}" for s in signs) + "]"),
    }


def flags(labels: DataFrame) -> DataFrame:
    """(doc_id, good, toxic), 0 or 1: whether any label of a document says quality 1, or toxic 1. Labels without doc_id belong to no document."""
    rows = columns(labels, "doc_id", "quality", "toxic").filter("doc_id is not null")
    says = {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    return rows.groupBy("doc_id").agg(*[F.max(F.when(c, 1).otherwise(0)).alias(name) for name, c in says.items()])


def cells(docs: DataFrame, labels: DataFrame, rules: Mapping[str, Column], repeats: int | None) -> DataFrame:
    """(part, mask, n, good, toxic): the documents of each part and set of failed filters. Bit i of ``mask`` is the i-th rule; bit ``repeats``, if
    given, is set for a text that equals one of a smaller doc_id.

    Only numbers and a SHA-256 of the text leave a task. Rows are added up by text before the least doc_id of a text is sought, so copies, however
    many, are few rows there: one for each part and kind of label.
    """
    rows = columns(docs, "doc_id", "text", "lang").select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    mask = F.lit(0)
    for bit, fails in enumerate(rules.values()):
        mask = mask + F.when(fails, 1 << bit).otherwise(0)
    key = F.unhex(F.sha2("text", 256)) if repeats is not None else F.lit(None).cast("binary")
    rows = rows.select("doc_id", "part", mask.alias("mask"), key.alias("key")).groupBy("doc_id", "part", "mask", "key").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(flags(labels), "doc_id", "left").na.fill(0, ["good", "toxic"])
    if repeats is not None:
        with_id = F.col("doc_id").isNotNull()
        texts = rows.groupBy("key", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(~with_id, F.col("n")).otherwise(0)).alias("loose"), F.min(F.when(with_id, F.struct("doc_id", "n"))).alias("first"))
        least = F.min("first.doc_id").over(Window.partitionBy("key"))
        once = F.col("loose") + F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0)
        texts = texts.withColumn("once", once)
        either = F.array(F.struct("mask", F.col("once").alias("n")), F.struct((F.col("mask") + (1 << repeats)).alias("mask"), (F.col("n") - F.col("once")).alias("n")))
        rows = texts.select("part", "good", "toxic", F.explode(either).alias("e")).select("part", "e.*", "good", "toxic").filter("n > 0")
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def _orders(n: int) -> Column:
    return F.expr("array(" + ", ".join(f"array({', '.join(map(str, o))})" for o in permutations(range(n))) + ")")


def fold(orders: Column) -> Column:
    """For a cell (mask, n, good, toxic): the counts of every order's every step, as one array of structs."""
    n, mask, none = F.col("n"), F.col("mask"), F.lit(0).cast("long")

    def step(state: Column, rule: Column) -> Column:
        fails, alive = F.getbit(mask, rule) == 1, state["alive"]
        gone = alive & fails
        counts = {
            "kept": F.when(alive & ~fails, n),
            "removed": F.when(gone, n),
            "redundant": F.when(~alive & fails, n),
            "unique_fails": F.when(fails & (F.bit_count(mask) == 1), n),
            "good_lost": F.when(gone, F.col("good")),
            "toxic_lost": F.when(gone, F.col("toxic")),
        }
        own = F.struct(*[F.coalesce(c, none).alias(name) for name, c in counts.items()])
        return F.struct((alive & ~fails).alias("alive"), F.concat(state["steps"], F.array(own)).alias("steps"))

    start = F.struct(F.lit(True).alias("alive"), F.array().cast("array<struct<" + ", ".join(f"{c}: bigint" for c in COUNTS) + ">>").alias("steps"))
    return F.flatten(F.transform(orders, lambda order: F.aggregate(order, start, step, lambda state: state["steps"])))


def interactions(table: DataFrame, names: str) -> DataFrame:
    """(part, filter_order, step, filter, COUNTS, shapley) from ``cells(part, mask, n, good, toxic)``, one row for each part, order and step.

    ``names`` has a letter for each bit. ``shapley`` is what the step's filter removes, summed over all orders. An empty table gives no rows.
    """
    if len(names) > MOST_FILTERS:
        raise ValueError(f"at most {MOST_FILTERS} filters")
    steps = table.select("part", F.posexplode(fold(_orders(len(names)))).alias("at", "c")).groupBy("part", "at").agg(*[F.sum(f"c.{c}").alias(c) for c in COUNTS])
    order = F.element_at(F.array(*[F.lit("".join(o)) for o in permutations(names)]), F.floor(F.col("at") / len(names)).cast("int") + 1)
    steps = steps.withColumn("filter_order", order).withColumn("step", (F.col("at") % len(names) + 1).cast("int"))
    steps = steps.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    # One row for each order: n! rows a window.
    shapley = F.sum("removed").over(Window.partitionBy("part", "filter"))
    return steps.select("part", "filter_order", "step", "filter", *COUNTS, shapley.alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """The interactions of the text rules A to D (see :func:`text_rules` for ``limits``) and of E, a text that equals one of a smaller doc_id.

    A null text is empty, and a null lang is the part ``''``. A row without doc_id never fails E and makes no other row fail it; rows that repeat one
    doc_id and text fail it together or not at all; rows of one doc_id with different texts are documents of their own, with that doc_id's labels.
    A document without label is neither good nor toxic. Extra columns are left out; an empty table gives no rows.
    """
    return interactions(cells(docs, labels, text_rules(F.col("text"), **limits), repeats=4), "ABCDE")
