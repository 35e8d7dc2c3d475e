"""Pairs of files that change together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.config import Coupling
from faultline.functions import scalars
from faultline.operators import filters


#: A commit's first file counts so much more in ``_single``: the commits are summed with the files, in one pass.
FIRST = 1 << 32


def eligible(history: DataFrame, most: int) -> DataFrame:
    """(sha, at, file, later): the distinct lower-cased live paths of commits with 2 to ``most`` of them, each with its
    place and those behind it, at most ``most`` - 1. A commit's rows are sorted once and looked at in that order, so
    neither a huge commit nor a task's rows are gathered; pairs come from the lists, without a join of the history with
    itself."""
    in_order = Window.partitionBy("sha").orderBy("file")
    rows = filters.live(history).select("sha", F.lower("path").alias("file"))
    rows = rows.withColumn("again", F.lag("file").over(in_order).eqNullSafe(F.col("file")) & (F.row_number().over(in_order) > 1)).filter("NOT again")
    whole, behind = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), in_order.rowsBetween(1, max(most - 1, 1))
    listed = rows.select("sha", "file", F.row_number().over(in_order).alias("at"), F.count("*").over(whole).alias("n"), F.collect_list("file").over(behind).alias("later"))
    return listed.filter(F.col("n").between(2, most)).select("sha", "at", "file", "later")


def _pairs(files: DataFrame) -> DataFrame:
    return files.filter("file IS NOT NULL").select(F.col("file").alias("file_a"), F.explode("later").alias("file_b"))


def _single(files: DataFrame) -> DataFrame:
    """(file, counts): a file's commits, and FIRST for each commit whose first file it is."""
    return files.groupBy("file").agg(F.sum(F.when(F.col("at") == 1, FIRST + 1).otherwise(1)).alias("counts"))


def analyze(history: DataFrame, config: Coupling) -> tuple[DataFrame, DataFrame]:
    """(pairs, stats): all pairs that pass the filters, and one row of totals before the filters."""
    files = eligible(history, config.max_files_per_commit)
    single = _single(files)
    commits, n = F.shiftright("counts", 32), F.col("counts") % FIRST
    paired = _pairs(files).groupBy("file_a", "file_b").agg(F.count("*").alias("co_commit_count"))
    totals = single.agg(F.coalesce(F.sum(commits), F.lit(0)).alias("total_commits"), F.count("file").alias("total_files"))
    enough = paired.filter(F.col("co_commit_count") >= config.min_co_commits)
    a = single.select(F.col("file").alias("file_a"), n.alias("file_a_commit_count"))
    b = single.select(F.col("file").alias("file_b"), n.alias("file_b_commit_count"))
    both, na, nb = F.col("co_commit_count"), F.col("file_a_commit_count"), F.col("file_b_commit_count")
    rows = enough.join(a, "file_a").join(b, "file_b").crossJoin(F.broadcast(totals))
    pairs = rows.select(
        "file_a", "file_b", "co_commit_count", "file_a_commit_count", "file_b_commit_count",
        scalars.jaccard(both, na, nb).alias("jaccard"),
        scalars.confidence(both, na).alias("confidence"),
        scalars.lift(both, na, nb, F.col("total_commits")).alias("lift"),
    ).filter(F.col("jaccard") >= config.min_jaccard_threshold)
    return pairs, totals.crossJoin(paired.agg(F.count("*").alias("total_pairs")))


def top(pairs: DataFrame, most: int) -> DataFrame:
    """The pairs with the greatest Jaccard coefficient; 0 gives none."""
    if most < 0:
        raise ValueError("top pairs can't be negative")
    return pairs.orderBy(F.desc("jaccard"), "file_a", "file_b").limit(most)
