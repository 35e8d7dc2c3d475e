"""Commit metrics: diffusion, size and entropy of every commit. Deleted rows count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions import scalars


def metrics(history: DataFrame) -> DataFrame:
    """One pass over a commit's rows. With churn c of T in all, entropy is log2(T) less the mean of log2(c) weighted
    by c, as a share of log2 of the number of rows; without any churn it is 1 if there are two rows or more."""
    churn = (F.col("lines_added") + F.col("lines_deleted")).cast("double")
    folder, part = F.lower(scalars.directory(F.col("path"))), F.lower(scalars.subsystem(F.col("path")))
    rows = history.select("sha", "lines_added", "lines_deleted", F.when(folder != "", folder).alias("folder"), F.when(part != "", part).alias("part"), churn.alias("c"), *[c for c in ("seq", "when", "when_iso", "author_name", "author_email", "message") if c in history.columns])
    facts = [F.first(c).alias(c) for c in rows.columns if c in ("seq", "when", "when_iso", "author_name", "author_email", "message")]
    agg = rows.groupBy("sha").agg(
        F.count("*").alias("file_count"),
        F.size(F.collect_set("folder")).cast("long").alias("directory_count"),
        F.greatest(F.size(F.collect_set("part")), F.lit(1)).cast("long").alias("subsystem_count"),
        F.sum("lines_added").alias("lines_added"),
        F.sum("lines_deleted").alias("lines_deleted"),
        F.sum(F.when(F.col("c") > 0, F.col("c") * F.log2("c")).otherwise(0.0)).alias("weighted"),
        *facts,
    )
    total = (F.col("lines_added") + F.col("lines_deleted")).cast("double")
    spread = scalars.clamp((F.log2(total) - F.col("weighted") / total) / F.log2(F.col("file_count").cast("double")))
    entropy = F.when(F.col("file_count") <= 1, 0.0).when(total <= 0, 1.0).otherwise(spread)
    return agg.withColumn("change_entropy", entropy).drop("weighted")
