"""Connected components of an edge list by alternating large and small stars.

Every round is two joins and two combinable minima; nothing gathers a node's
neighbours in one row, and each round's edges are written to the shared folder.
Self-loops and null ends are ignored; an empty edge list gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.sources.shared import discard, materialize


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _round(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
    low = large.groupBy("b").agg(F.min("a").alias("m"))
    moved = large.join(low, "b").filter("m < a").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(low.select(F.col("m").alias("a"), "b")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", scope: str = "default") -> DataFrame:
    """(node, root): each node that has an edge, with the smallest node of its component; roots included."""
    edges = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a < b").distinct()
    edges = materialize(edges, "edges", scope)
    mark = _mark(edges)
    while mark[0]:
        after = materialize(_round(edges), "edges", scope)
        discard(edges)
        edges, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    roots = edges.select("a").distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(roots.select(F.col("a").alias("node"), F.col("a").alias("root")))
