"""Norms over all rows, weighted scores and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.config import CommitScoring, Scoring
from faultline.functions import scalars
from faultline.operators.filters import instant

FILE_PARTS = ("commit", "churn", "recency", "burst", "ownership", "bugfix", "complexity")


def _context(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """One row of least and greatest values; 0 for no rows."""
    parts = []
    for name, c in columns.items():
        parts += [F.coalesce(F.min(c), F.lit(0)).alias(f"{name}_min"), F.coalesce(F.max(c), F.lit(0)).alias(f"{name}_max")]
    return df.agg(*parts)


def file_context(files: DataFrame) -> DataFrame:
    return _context(files, {"commit": F.col("commit_count"), "churn": F.col("added_lines") + F.col("deleted_lines"), "bugfix": F.col("bugfix_count"), "size": F.col("file_size")})


def commit_context(commits: DataFrame) -> DataFrame:
    return _context(commits, {"files": F.col("file_count"), "folders": F.col("directory_count"), "parts": F.col("subsystem_count"), "churn": F.col("lines_added") + F.col("lines_deleted")})


def file_features(files: DataFrame, half_life: int, until: str) -> DataFrame:
    """``files`` with ``f_<part>``, the seven features in [0, 1]. The norms are a one-row broadcast."""
    def norm(c: Column, name: str) -> Column:
        return scalars.norm_log(c, F.col(f"{name}_min"), F.col(f"{name}_max"))

    days = scalars.days_between(instant(until), F.col("last_modified"))
    features = {
        "commit": norm(F.col("commit_count"), "commit"),
        "churn": norm(F.col("added_lines") + F.col("deleted_lines"), "churn"),
        "recency": scalars.recency_decay(days, half_life),
        "burst": F.col("burst_score"),
        "ownership": F.lit(1.0) - F.col("ownership_ratio"),
        "bugfix": norm(F.col("bugfix_count"), "bugfix"),
        "complexity": norm(F.col("file_size"), "size"),
    }
    files = files.persist()  # read twice, for the norms and for the scores; far smaller than the history
    both = files.crossJoin(F.broadcast(file_context(files)))
    return both.select(*files.columns, *[v.alias(f"f_{k}") for k, v in features.items()])


def score_files(files: DataFrame, scoring: Scoring, until: str, with_complexity: bool = False, explain: bool = False) -> DataFrame:
    """risk_score of every file; without measured sizes the weight of complexity is 0 and isn't given to others."""
    weights = dict(zip(FILE_PARTS, scoring.weights.as_list()))
    if not with_complexity:
        weights["complexity"] = 0.0
    rows = file_features(files, scoring.half_life_days, until)
    parts = {k: F.lit(w) * F.col(f"f_{k}") for k, w in weights.items()}
    total = None
    for p in parts.values():
        total = p if total is None else total + p
    breakdown = [F.struct(*[p.alias(k) for k, p in parts.items()]).alias("breakdown")] if explain else []
    return rows.select(*files.columns, scalars.clamp(total).alias("risk_score"), *breakdown)


def score_commits(commits: DataFrame, scoring: CommitScoring, explain: bool = False) -> DataFrame:
    def norm(c: Column, name: str) -> Column:
        return scalars.norm_log(c, F.col(f"{name}_min"), F.col(f"{name}_max"))

    w = scoring.weights
    rows = commits.crossJoin(F.broadcast(commit_context(commits)))
    wide = norm(F.col("file_count"), "files") + norm(F.col("directory_count"), "folders") + norm(F.col("subsystem_count"), "parts")
    parts = {
        "diffusion": F.lit(w.diffusion) * (wide / 3.0),
        "size": F.lit(w.size) * norm(F.col("lines_added") + F.col("lines_deleted"), "churn"),
        "entropy": F.lit(w.entropy) * F.col("change_entropy"),
    }
    score = scalars.clamp(parts["diffusion"] + parts["size"] + parts["entropy"])
    level = scalars.risk_level(F.col("risk_score"), scoring.thresholds.high, scoring.thresholds.medium)
    breakdown = [F.struct(*[p.alias(k) for k, p in parts.items()]).alias("breakdown")] if explain else []
    # behind a generator, so that a filter by level isn't pushed to the join and the score computed again for each mention
    return rows.select(*commits.columns, F.explode(F.array(score)).alias("risk_score"), *breakdown).withColumn("risk_level", level)


def ranked(items: DataFrame, score: str, *ties: str, top: int = 0) -> DataFrame:
    """By score, then the tie-breakers; a top is a bounded heap a partition, not a sort of all."""
    ordered = items.orderBy(F.desc(score), *ties)
    return ordered.limit(top) if top > 0 else ordered


def ci_summary(items: DataFrame) -> DataFrame:
    """Counts and the greatest score, by the default thresholds."""
    level = scalars.risk_level(F.col("risk_score"))
    return items.agg(
        F.count("*").alias("total_files"),
        F.count_if(level == "high").alias("high_risk_count"),
        F.count_if(level == "medium").alias("medium_risk_count"),
        F.coalesce(F.max("risk_score"), F.lit(0.0)).alias("max_risk_score"),
    )


def gate(items: DataFrame, threshold: float) -> DataFrame:
    """exceeded, and the greatest score: whether any score reaches the threshold (0: never)."""
    most = F.max("risk_score")
    return items.agg(most.alias("max_score"), F.coalesce((F.lit(threshold) > 0) & (most >= threshold), F.lit(False)).alias("exceeded"))
