"""The four analyses as plans over a history."""

from __future__ import annotations

from pyspark.sql import DataFrame

from faultline.config import Config
from faultline.operators import calibration, commits, coupling, files, filters, scoring


def hotspots(history: DataFrame, config: Config, until: str, aliases: DataFrame | None = None, sizes: DataFrame | None = None, diff: DataFrame | None = None, explain: bool = False) -> DataFrame:
    """Scored files; a diff narrows what is shown, not what norms are taken from."""
    metrics = files.metrics(history, config.bugfix.patterns, config.burst.window_days, aliases, sizes)
    items = scoring.score_files(metrics, config.scoring, until, with_complexity=sizes is not None, explain=explain)
    return filters.in_diff(items, diff) if diff is not None else items


def risky_commits(history: DataFrame, config: Config, level: str | None = None, explain: bool = False) -> DataFrame:
    return filters.at_level(scoring.score_commits(commits.metrics(history), config.commit_scoring, explain), level)


def coupled(history: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    pairs, stats = coupling.analyze(history, config.coupling)
    return coupling.top(pairs, config.coupling.top_pairs), stats


def calibrated(history: DataFrame, config: Config, until: str, aliases: DataFrame | None = None, top_percent: int = calibration.TOP_PERCENT) -> calibration.Result | None:
    """None without any bug-fix commit. File sizes are not measured here."""
    if not any(p.strip() for p in config.bugfix.patterns):
        raise ValueError("no bug-fix patterns are configured")
    metrics = files.metrics(history, config.bugfix.patterns, config.burst.window_days, aliases)
    found = calibration.calibrate(metrics, config.scoring.weights, config.scoring.half_life_days, until, top_percent)
    # a file with a bug fix shows that there is a commit; only deletions may be in others
    if not found.bugfix_files and not files.bugfix_totals(history, config.bugfix.patterns).first()[0]:
        return None
    return found
