"""Settings: frozen records with the defaults, read from and written to JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace
from pathlib import Path
from typing import Any

FILE_NAME = ".faultline.json"


@dataclass(frozen=True)
class Weights:
    commit: float = 0.20
    churn: float = 0.20
    recency: float = 0.15
    burst: float = 0.10
    ownership: float = 0.10
    bugfix: float = 0.15
    complexity: float = 0.10

    def as_list(self) -> list[float]:
        return [getattr(self, f.name) for f in fields(self)]


@dataclass(frozen=True)
class Scoring:
    half_life_days: int = 30
    weights: Weights = field(default_factory=Weights)


@dataclass(frozen=True)
class Burst:
    window_days: int = 7


@dataclass(frozen=True)
class Bugfix:
    patterns: tuple[str, ...] = (r"\bfix(ed|es)?\b", r"\bbug\b", r"\bhotfix\b", r"\bpatch\b")


@dataclass(frozen=True)
class CommitWeights:
    diffusion: float = 0.35
    size: float = 0.35
    entropy: float = 0.30


@dataclass(frozen=True)
class Thresholds:
    high: float = 0.7
    medium: float = 0.4

    def classify(self, score: float) -> str:
        return "high" if score >= self.high else "medium" if score >= self.medium else "low"


@dataclass(frozen=True)
class CommitScoring:
    weights: CommitWeights = field(default_factory=CommitWeights)
    thresholds: Thresholds = field(default_factory=Thresholds)


@dataclass(frozen=True)
class Coupling:
    min_co_commits: int = 3
    min_jaccard_threshold: float = 0.1
    max_files_per_commit: int = 50
    top_pairs: int = 50


@dataclass(frozen=True)
class Filters:
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()


@dataclass(frozen=True)
class Config:
    scoring: Scoring = field(default_factory=Scoring)
    burst: Burst = field(default_factory=Burst)
    bugfix: Bugfix = field(default_factory=Bugfix)
    commit_scoring: CommitScoring = field(default_factory=CommitScoring)
    coupling: Coupling = field(default_factory=Coupling)
    filters: Filters = field(default_factory=Filters)


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.title() for x in rest)


def _merge(record: Any, found: dict[str, Any]) -> Any:
    """``record`` with the fields that ``found`` has; lists are replaced, null counts as absent."""
    change = {}
    for f in fields(record):
        if (value := found.get(camel(f.name))) is None:
            continue
        now = getattr(record, f.name)
        if is_dataclass(now):
            change[f.name] = _merge(now, value)
        elif isinstance(now, tuple):
            change[f.name] = tuple(value)
        else:
            change[f.name] = type(now)(value)
    return replace(record, **change)


def load(path: str | None = None) -> Config:
    """From ``path``; else from FILE_NAME in the working folder, else in the home folder; else the defaults. A
    missing file gives the defaults."""
    places = [Path(path)] if path else [Path(FILE_NAME), Path.home() / FILE_NAME]
    for place in places:
        if place.is_file():
            return _merge(Config(), json.loads(place.read_text(encoding="utf-8")))
    return Config()


def _plain(value: Any) -> Any:
    if isinstance(value, dict):
        return {camel(k): _plain(v) for k, v in value.items()}
    return list(value) if isinstance(value, tuple) else value


def save(config: Config, path: str) -> None:
    Path(path).write_text(json.dumps(_plain(asdict(config)), indent=2) + "\n", encoding="utf-8")
