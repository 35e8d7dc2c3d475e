"""Row filters over a history; each one is a plain predicate, so it reaches the scan where it can."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import patterns


def instant(t: str) -> Column:
    """An ISO date or time; without an offset it is UTC, whatever the session's time zone."""
    at = datetime.fromisoformat(t)
    return F.lit(at if at.tzinfo else at.replace(tzinfo=timezone.utc))


def time_range(history: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Both ends belong to the range."""
    if since is not None:
        history = history.filter(F.col("when") >= instant(since))
    if until is not None:
        history = history.filter(F.col("when") <= instant(until))
    return history


def globs(history: DataFrame, include=(), exclude=()) -> DataFrame:
    """By the new path, before anything is counted."""
    return history.filter(patterns.glob_filter(F.col("path"), tuple(include), tuple(exclude))) if include or exclude else history


def live(history: DataFrame) -> DataFrame:
    """Without deletions."""
    return history.filter(F.col("kind") != "deleted")


def is_bugfix(found=()) -> Column:
    return patterns.matches_any(F.col("message"), tuple(found))


def diff_paths(diff: DataFrame) -> DataFrame:
    """New and old paths of a diff, each once."""
    both = diff.select("path").union(diff.filter(F.col("old_path").isNotNull() & (F.col("old_path") != "")).select("old_path"))
    return both.distinct()


def in_diff(items: DataFrame, diff: DataFrame) -> DataFrame:
    """The scored items that a diff touches; runs behind the scores, which keep all files' norms."""
    return items.join(diff_paths(diff), "path", "left_semi")


def at_level(items: DataFrame, level: str | None) -> DataFrame:
    """high: high; medium: high and medium; anything else: all."""
    keep = {"high": ["high"], "medium": ["high", "medium"]}.get(level or "")
    return items.filter(F.col("risk_level").isin(keep)) if keep else items
