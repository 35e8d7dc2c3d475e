"""File metrics: changes, churn, contributors, ownership, bursts and bug fixes of every path."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators import filters

DAY_MICROS = 86_400_000_000


def canonical(history: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """Paths by their last name. ``aliases`` (path, canonical) is left to the planner to broadcast or shuffle."""
    if aliases is None:
        return history
    names = aliases.select("path", "canonical")
    return history.join(names, "path", "left").withColumn("path", F.coalesce("canonical", "path")).drop("canonical")


def by_author(history: DataFrame, found=()) -> DataFrame:
    """One row a path and contributor: the level below file metrics, which also gives ownership. ``last_iso`` is there if
    the history has ``when_iso``: an aggregate of strings sorts all rows, one of numbers doesn't."""
    rows = filters.live(history)
    fix = F.when(filters.is_bugfix(found), 1).otherwise(0)
    iso = [F.max_by("when_iso", "when").alias("last_iso")] if "when_iso" in history.columns else []
    return rows.groupBy("path", F.lower("author_email").alias("author")).agg(
        F.count("*").alias("n"),
        F.sum("lines_added").alias("added"),
        F.sum("lines_deleted").alias("deleted"),
        F.max("when").alias("last"),
        *iso,
        F.sum(fix).alias("fixes"),
    )


def burst(history: DataFrame, days: int = 7) -> DataFrame:
    """(path, burst_score): most changes within ``days`` days, both ends included, as a share of all.

    Changes at the same time are counted first. Time is cut to stretches of ``days``; each row also goes to the next
    stretch as context, so that a window partition is a stretch of a path and not its whole history."""
    span = (days if days > 0 else 7) * DAY_MICROS
    times = filters.live(history).groupBy("path", F.unix_micros("when").alias("at")).agg(F.count("*").alias("n"))
    own = F.floor(F.col("at") / F.lit(span)).cast("long")
    spread = times.withColumn("own", own).withColumn("stretch", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    w = Window.partitionBy("path", "stretch").orderBy("at").rangeBetween(-span, 0)
    most = spread.withColumn("near", F.sum("n").over(w)).filter("stretch = own")
    return most.groupBy("path").agg((F.max("near") / F.sum("n")).alias("burst_score"))


def metrics(history: DataFrame, found=(), window_days: int = 7, aliases: DataFrame | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """All file metrics. ``history`` has changes with their commits' columns; ``sizes`` is (path, line_count)."""
    rows = canonical(history, aliases)
    people = by_author(rows, found)
    dated = "last_iso" in people.columns
    files = people.groupBy("path").agg(
        F.sum("n").alias("commit_count"),
        F.sum("added").alias("added_lines"),
        F.sum("deleted").alias("deleted_lines"),
        F.max("last").alias("last_modified"),
        *[F.max_by("last_iso", "last").alias("last_modified_iso")] * dated,
        F.count("*").alias("contributor_count"),
        (F.max("n") / F.sum("n")).alias("ownership_ratio"),
        F.sum("fixes").alias("bugfix_count"),
    )
    if not dated:
        files = files.withColumn("last_modified_iso", F.lit(None).cast("string"))
    out = files.join(burst(rows, window_days), "path")
    if sizes is None:
        return out.withColumn("file_size", F.lit(0).cast("long"))
    return out.join(sizes.select("path", F.col("line_count").cast("long").alias("file_size")), "path", "left").fillna({"file_size": 0})


def bugfix_totals(history: DataFrame, found) -> DataFrame:
    """total_bugfixes: commits whose message matches."""
    return history.filter(filters.is_bugfix(found)).agg(F.count_distinct("sha").alias("total_bugfixes"))
