"""Scalar functions over columns; all stay in the JVM's generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-10
DAY_SECONDS = 86400.0


def _lit(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def clamp(x: Column) -> Column:
    """Into [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _some(value: Column) -> Column:
    return F.when(value > 0, 1.0).otherwise(0.0)


def norm_log(value: Column, low: Column | float, high: Column | float) -> Column:
    """Logarithmic place of ``value`` between low and high; where they coincide, whether it is above 0."""
    v, a, b = value.cast("double"), _lit(low).cast("double"), _lit(high).cast("double")
    span = F.log(F.lit(1.0) + b) - F.log(F.lit(1.0) + a)
    place = (F.log(F.lit(1.0) + v) - F.log(F.lit(1.0) + a)) / span
    return F.when(F.abs(b - a) < TINY, _some(v)).when(span <= 0, _some(v)).otherwise(clamp(place))


def norm_minmax(value: Column, low: Column | float, high: Column | float) -> Column:
    """Linear place of ``value`` between low and high, with the same rule where they coincide."""
    v, a, b = value.cast("double"), _lit(low).cast("double"), _lit(high).cast("double")
    return F.when(F.abs(b - a) < TINY, _some(v)).otherwise(clamp((v - a) / (b - a)))


def recency_decay(days: Column, half_life: int) -> Column:
    """Halves every ``half_life`` days (30 if not positive); the future counts as now."""
    h = half_life if half_life > 0 else 30
    return clamp(F.exp(-F.log(F.lit(2.0)) / F.lit(float(h)) * F.greatest(F.lit(0.0), days)))


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(DAY_SECONDS * 1e6)


def risk_level(score: Column, high: float = 0.7, medium: float = 0.4) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def _slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def directory(path: Column) -> Column:
    """Before the last slash; empty without one, and for a slash at the start only."""
    p = _slashed(path)
    return F.substr(p, F.lit(1), F.length(p) - F.length(F.substring_index(p, "/", -1)) - 1)


def subsystem(path: Column) -> Column:
    """The first part of the directory; all of it where the path starts with a slash."""
    p = _slashed(path)
    return F.when(directory(path) == "", "").when(p.startswith("/"), directory(path)).otherwise(F.substring_index(p, "/", 1))


def first_line(message: Column, most: int = 100) -> Column:
    """The first line, cut to ``most`` bytes with three dots at the end; a newline at the very start doesn't count."""
    line = F.when(message.rlike(r"^[^\r\n]"), F.regexp_extract(message, r"^[^\r\n]*", 0)).otherwise(message)
    cut = F.concat(F.substring(F.encode(line, "UTF-8"), 1, most - 3).cast("string"), F.lit("..."))
    return F.when(F.octet_length(line) > most, cut).otherwise(line)


def line_count(content: Column) -> Column:
    """Newlines, and one more for an unfinished last line."""
    newlines = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))
    open_end = F.when((content != "") & ~content.endswith("\n"), 1).otherwise(0)
    return (newlines + open_end).cast("long")


def jaccard(both: Column, a: Column, b: Column) -> Column:
    return both.cast("double") / (a + b - both)


def confidence(both: Column, a: Column) -> Column:
    return both.cast("double") / a


def lift(both: Column, a: Column, b: Column, total: Column) -> Column:
    n = total.cast("double")
    return (both / n) / ((a / n) * (b / n))


def short_sha(sha: Column) -> Column:
    return F.substring(sha, 1, 8)


def round_half_away(x: Column, decimals: int) -> Column:
    return F.round(x, decimals)
