"""File metrics of a growing history: each micro-batch adds mergeable partials, and metrics are read from them.

Counts, sums, latest times and sets of contributors merge in any order, so a partial is one row a path and
contributor, and one a path and time for bursts. A batch overwrites its own folder, so that a repeated batch counts
once. Names are those of the changes: renames are folded over the whole history, not over batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from faultline.operators import files, filters


def append(history: DataFrame, at: str, found=(), trigger: dict | None = None) -> StreamingQuery:
    """Starts a query that adds the partials of a streaming ``history`` to the folder ``at``."""

    def add(batch: DataFrame, number: int) -> None:
        people = files.by_author(batch, found)
        times = filters.live(batch).groupBy("path", F.unix_micros("when").alias("at")).agg(F.count("*").alias("n"))
        people.write.mode("overwrite").parquet(f"{at}/people/batch={number}")
        times.write.mode("overwrite").parquet(f"{at}/times/batch={number}")

    writer = history.writeStream.foreachBatch(add).option("checkpointLocation", f"{at}/checkpoint")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def metrics(spark: SparkSession, at: str, window_days: int = 7) -> DataFrame:
    """File metrics of all batches so far."""
    people = spark.read.parquet(f"{at}/people").groupBy("path", "author").agg(F.sum("n").alias("n"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.max("last").alias("last"), F.sum("fixes").alias("fixes"))
    totals = people.groupBy("path").agg(
        F.sum("n").alias("commit_count"),
        F.sum("added").alias("added_lines"),
        F.sum("deleted").alias("deleted_lines"),
        F.max("last").alias("last_modified"),
        F.count("*").alias("contributor_count"),
        (F.max("n") / F.sum("n")).alias("ownership_ratio"),
        F.sum("fixes").alias("bugfix_count"),
    )
    span = (window_days if window_days > 0 else 7) * files.DAY_MICROS
    times = spark.read.parquet(f"{at}/times").groupBy("path", "at").agg(F.sum("n").alias("n"))
    spread = times.withColumn("own", F.floor(F.col("at") / F.lit(span)).cast("long")).withColumn("stretch", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    near = F.sum("n").over(Window.partitionBy("path", "stretch").orderBy("at").rangeBetween(-span, 0))
    bursts = spread.withColumn("near", near).filter("stretch = own").groupBy("path").agg((F.max("near") / F.sum("n")).alias("burst_score"))
    return totals.join(bursts, "path")
