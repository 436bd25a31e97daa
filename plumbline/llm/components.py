"""Connected components of a link table by alternating large-star and small-star steps.

Every node points to the smallest node it knows; the number of rounds grows with the logarithm of the longest path.
Each round is written to the shared checkpoint folder. Neighbours are never gathered in one row: a node's minimum is a
partial aggregate that is joined back, and a hot node's rows can be split by the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (x, y) with x > y."""
    both = edges if not large else edges.union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
    least = both.groupBy("x").agg(F.min("y").alias("m"))
    least = least.select("x", F.least("x", "m").alias("m"))
    joined = both.join(least, "x")
    if large:
        moved = joined.where(F.col("y") > F.col("x")).select(F.col("y").alias("x"), F.col("m").alias("y"))
    else:
        moved = joined.select(F.col("y").alias("x"), F.col("m").alias("y")).union(least.select("x", F.col("m").alias("y")))
    return moved.where(F.col("x") != F.col("y")).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) of every node of links (x, y): the label is the smallest node it reaches."""
    edges = cut(links.where(F.col("x") != F.col("y")).select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
    for _ in range(most_rounds):
        edges = cut(_step(_step(edges, True), False))
        # stars: every node has one edge, and no centre has any
        several = edges.groupBy("x").agg(F.count("*").alias("n")).where("n > 1").select("x")
        inner = edges.select("x").join(edges.select(F.col("y").alias("x")), "x", "left_semi")
        if not several.limit(1).count() and not inner.limit(1).count():
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("y").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return edges.select(F.col("x").alias("node"), F.col("y").alias("label")).union(roots)
