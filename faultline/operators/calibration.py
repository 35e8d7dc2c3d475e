"""Weights that rank past bug fixes best: recall of the top share, and a coordinate descent over it."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.config import Weights
from faultline.operators import scoring

STEP, LEAST_STEP, SWEEPS, GAIN = 0.05, 0.01, 100, 1e-10
TOP_PERCENT = 20
#: Scores are compared to so many digits, so that ranks don't depend on the order of sums.
DIGITS = 9
#: Files up to which the search runs over one matrix on the driver (64 bytes a file, and its path while they are sorted); beyond, each
#: trial is a job, with the same result.
DRIVER_FILES = 5_000_000


@dataclass(frozen=True)
class Result:
    total_files: int
    bugfix_files: int
    current_weights: Weights
    current_rate: float
    recommended_weights: Weights
    recommended_rate: float


def features(files: DataFrame, half_life: int, until: str) -> DataFrame:
    """(path, features, is_bugfix): the seven features in the order of weights; bug fixes are feature and label."""
    rows = scoring.file_features(files, half_life, until)
    return rows.select("path", F.array(*[F.col(f"f_{p}") for p in scoring.FILE_PARTS]).alias("features"), (F.col("bugfix_count") > 0).alias("is_bugfix"))


def detection_rate(rows: DataFrame, weights: list[float], top_percent: int = TOP_PERCENT) -> DataFrame:
    """One row: the share of bug-fixed files among the best ``top_percent`` by weighted score, to DIGITS. Only
    (score, path) rows above the cut are ranked, and ties go by path."""
    score = sum((F.lit(w) * F.col("features")[i] for i, w in enumerate(weights)), F.lit(0.0))
    scored = rows.select("path", "is_bugfix", F.round(score, DIGITS).alias("score"))
    n = scored.count()
    best = min(n, math.ceil(n * top_percent / 100))
    first = scored.orderBy(F.desc("score"), "path").limit(best) if best else scored.limit(0)
    hits = first.agg(F.count_if("is_bugfix").alias("hits"))
    return scored.agg(F.count_if("is_bugfix").alias("total")).crossJoin(hits).select(F.when(F.col("total") > 0, F.col("hits") / F.col("total")).otherwise(0.0).alias("rate"))


class _Matrix:
    """``detection_rate`` over arrays, with the same ranks."""

    def __init__(self, rows: DataFrame):
        table = rows.select("path", "features", "is_bugfix").orderBy("path").toArrow()
        self.x = table["features"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(scoring.FILE_PARTS))
        self.y = table["is_bugfix"].combine_chunks().to_numpy(zero_copy_only=False)

    def rate(self, weights: list[float], top_percent: int) -> float:
        total = int(self.y.sum())
        if not total:
            return 0.0
        best = min(len(self.x), math.ceil(len(self.x) * top_percent / 100))
        order = np.argsort(-np.round(self.x @ np.array(weights), DIGITS), kind="stable")[:best]
        return float(self.y[order].sum() / total)


def optimize(rate, parts: int = len(scoring.FILE_PARTS)) -> tuple[list[float], float]:
    """First-improvement descent from equal weights: moves a step of weight from one part to another whenever that
    raises the rate, and halves the step when a sweep brings nothing."""
    weights, step = [1 / parts] * parts, STEP
    best = rate(weights)
    for _ in range(SWEEPS):
        improved = False
        for i in range(parts):
            for j in range(parts):
                if i == j or weights[j] < step:
                    continue
                trial = list(weights)
                trial[i] += step
                trial[j] -= step
                if (r := rate(trial)) > best + GAIN:
                    weights, best, improved = trial, r, True
        if not improved:
            if step <= LEAST_STEP:
                break
            step /= 2
    return weights, best


def calibrate(files: DataFrame, current: Weights, half_life: int, until: str, top_percent: int = TOP_PERCENT) -> Result:
    """Keeps the current weights unless others are strictly better; reported weights are rounded, their rate isn't."""
    top_percent = top_percent if top_percent > 0 else TOP_PERCENT
    rows = features(files, half_life, until)
    n, fixed = rows.agg(F.count("*"), F.count_if("is_bugfix")).first()
    kept = None
    if n <= DRIVER_FILES:
        matrix = _Matrix(rows)
        rate = lambda w: matrix.rate(w, top_percent)
    else:
        kept = rows.persist()
        rate = lambda w: detection_rate(kept, w, top_percent).first()[0]
    now = rate(current.as_list())
    weights, best = optimize(rate)
    if kept is not None:
        kept.unpersist()
    if best > now:
        return Result(n, fixed, current, now, Weights(*[math.floor(w * 100 + 0.5) / 100 for w in weights]), best)
    return Result(n, fixed, current, now, current, now)
