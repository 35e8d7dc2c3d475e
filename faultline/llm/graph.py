"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import standing_on, unlink, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).filter("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    ties = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
    return ties.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of ``edges`` (a, b): root is the least node of the component. Each round is a
    written table, so the plan doesn't grow; groups are only ever reduced to their least neighbour."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    mark = None
    while True:
        after = written(_small_star(_large_star(now)), "edges")
        n, fan, total = after.agg(F.count("*"), F.count_distinct("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        unlink(now)
        now = after
        # each node has one edge, to a root, when nothing changes any more
        if n == fan and (n, total) == mark:
            break
        mark = (n, total)
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return standing_on(roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), now)
