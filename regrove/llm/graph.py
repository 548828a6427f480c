"""Connected components by alternating stars: every round is a grouping with partial minima and a join, cut by a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regrove.llm.common import written


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a > b) after each node has sent its larger (or smaller) neighbours to its least one."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    if large:  # only nodes with a smaller neighbour or themselves as the least
        least = least.select("a", F.least("a", "m").alias("m"))
        sent = edges.select(F.col("b").alias("a"), F.col("a").alias("v")).join(least, "a").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        own = least.select("a", F.col("m").alias("b"))
        sent = edges.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(own)
    return sent.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of `edges` (a, b) that isn't the least of its component, with that least node.

    Nodes of any ordered type; direction, repeats and loops of the edges don't matter, rows with a null are ignored. An empty
    table gives an empty one.
    """
    edges = written(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), (F.isnull("a") | F.isnull("b")).alias("n"))
        .where("not n and a <> b").drop("n").distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        edges = written(_star(_star(edges, large=True), large=False), "stars")
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
