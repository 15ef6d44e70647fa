"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.session import stage


def _nearest(edges: DataFrame, node: str, other: str) -> DataFrame:
    return edges.groupBy(F.col(node).alias("node")).agg(F.min(other).alias("least"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the component's least node.

    Each round joins every node's larger neighbours, then its smaller ones, to the least node among them. The number of rounds grows with the
    logarithm of a component's diameter. A round is staged in the shared folder, so lineage stays short. Minima are taken before the shuffle,
    and the joins have one row a node on one side, which adaptive execution can split when a node has very many edges.
    Self-loops, repeated and reversed edges and nulls change nothing; an empty table gives an empty one.
    """
    edges = edges.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = stage(edges, "edges"), None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _nearest(both, "a", "b").select("node", F.least("node", "least").alias("least"))
        large = both.join(least, F.col("a") == F.col("node")).filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        least = _nearest(large, "a", "b")
        small = large.join(least, F.col("a") == F.col("node")).select(F.when(F.col("b") == F.col("least"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("least").alias("b"))
        edges = stage(small.filter("a <> b").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
