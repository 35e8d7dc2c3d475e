"""Ordered rename folding: every old path to its last name."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Up to so many rename edges are folded on the driver; beyond, components are found first and folded one by one.
DRIVER_EDGES = 200_000
_own_dir: list[str] = []


def fold(edges: list[tuple[str, str]]) -> dict[str, str]:
    """Old path to last name, from (old, new) in processing order: the root of the old path is tied to the root of
    the new one, which keeps its name. There is no limit on the length of a chain."""
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        top = x
        while parent.get(top, top) != top:
            top = parent[top]
        while parent.get(x, x) != x:
            parent[x], x = top, parent[x]
        return top

    for old, new in edges:
        if old and new:
            a, b = root(old), root(new)
            if a != b:
                parent[a] = b
    return {x: root(x) for x in parent}


def edges_of(history: DataFrame) -> DataFrame:
    """(seq, pos, old_path, path) of the renames."""
    return history.filter((F.col("kind") == "renamed") & F.col("old_path").isNotNull() & (F.col("old_path") != "")).select("seq", "pos", "old_path", "path")


def _written(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:  # only where the cluster names no shared folder, as in tests
        if not _own_dir:
            import tempfile

            _own_dir.append(tempfile.mkdtemp(prefix="faultline-"))
        at = f"file://{_own_dir[0]}"
    path = f"{at.rstrip('/')}/faultline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of an undirected edge table (a, b), by alternating large and small stars over written tables."""
    now = _written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    mark = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).filter("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").union(low.select("a", F.col("m").alias("b"))).distinct()
        now = _written(small)
        n, total = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        fan = now.agg(F.count_distinct("a")).first()[0]
        if n == fan and mark == (n, total):
            break
        mark = (n, total)
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def aliases(edges: DataFrame, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """(path, canonical) of all renamed paths. Names depend on the order of edges, groups don't: many edges are
    first grouped to components, whose edges are then folded in order, each component on its own."""
    spark: SparkSession = edges.sparkSession
    few = edges.select("seq", "pos", "old_path", "path").limit(driver_edges + 1).toPandas()
    if len(few) <= driver_edges:
        ordered = few.sort_values(["seq", "pos", "old_path", "path"], kind="stable")
        found = fold(list(zip(ordered["old_path"], ordered["path"])))
        return spark.createDataFrame(sorted(found.items()), "path string, canonical string")
    roots = components(edges.select(F.col("old_path").alias("a"), F.col("path").alias("b")))
    grouped = edges.join(roots.withColumnRenamed("node", "path"), "path")

    def named(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["seq", "pos", "old_path", "path"], kind="stable")
        return pd.DataFrame(sorted(fold(list(zip(group["old_path"], group["path"]))).items()), columns=["path", "canonical"])

    return grouped.groupBy("root").applyInPandas(named, "path string, canonical string")
