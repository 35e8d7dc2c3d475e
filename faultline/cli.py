"""Command line: analyze, commits, coupling, calibrate."""

from __future__ import annotations

import argparse
import sys
import time
from dataclasses import replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import config as settings
from faultline.operators import filters, graph, scoring
from faultline.plans import reports
from faultline.sinks import reports as sinks
from faultline.sources import git

VERSION = "0.1.0"


class Failure(Exception):
    pass


def _day(value: str) -> datetime:
    try:
        return datetime.strptime(value, "%Y-%m-%d").replace(tzinfo=timezone.utc)
    except ValueError:
        raise argparse.ArgumentTypeError(f"invalid date: {value} (expected YYYY-MM-DD)") from None


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="faultline", description="Risk analysis of change history on Spark")
    top.add_argument("--version", action="version", version=VERSION)
    top.add_argument("--config", "-c", help="settings file")
    commands = top.add_subparsers(dest="command")
    common = argparse.ArgumentParser(add_help=False)
    add = common.add_argument
    add("--repo", "-r", default=".")
    add("--since", type=_day, help="first day, YYYY-MM-DD")
    add("--until", type=_day, help="last moment: the start of this day, YYYY-MM-DD")
    add("--branch", "-b", default="")
    add("--rename-detect", choices=list(git.RENAMES), default="simple")
    add("--include", action="append", help="glob of paths to keep; may be repeated")
    add("--exclude", action="append", help="glob of paths to leave out; may be repeated")
    add("--format", "-f", default="console", help="console, json, csv, markdown, ci")
    add("--top", "-n", type=int, default=50, help="rows to show; 0 for all")
    add("--output", "-o", default="")
    add("--explain", action="store_true")
    history = argparse.ArgumentParser(add_help=False)
    history.add_argument("--half-life", type=int)
    history.add_argument("--window-days", type=int)
    history.add_argument("--bug-patterns", action="append")
    a = commands.add_parser("analyze", aliases=["a"], parents=[common, history], help="files by risk")
    a.add_argument("--diff", default="", help="only files of base...head")
    a.add_argument("--ci-threshold", type=float, default=0.0)
    a.add_argument("--include-complexity", action="store_true")
    c = commands.add_parser("commits", aliases=["c"], parents=[common], help="commits by risk")
    c.add_argument("--risk-level", default="all")
    p = commands.add_parser("coupling", aliases=["cp"], parents=[common], help="files that change together")
    p.add_argument("--min-co-commits", type=int)
    p.add_argument("--min-jaccard", type=float)
    p.add_argument("--max-files", type=int)
    p.add_argument("--top-pairs", type=int)
    k = commands.add_parser("calibrate", parents=[common, history], help="weights that rank past bug fixes best")
    k.add_argument("--top-percent", type=int, default=20)
    return top


def configured(args: argparse.Namespace) -> settings.Config:
    """The settings, with what the flags set; lists from flags replace those of the settings."""
    c = settings.load(args.config)
    got = lambda name, now: now if getattr(args, name, None) is None else getattr(args, name)
    listed = lambda name, now: tuple(x.strip() for v in getattr(args, name, None) or () for x in [v]) or now
    return replace(
        c,
        scoring=replace(c.scoring, half_life_days=got("half_life", c.scoring.half_life_days)),
        burst=replace(c.burst, window_days=got("window_days", c.burst.window_days)),
        bugfix=replace(c.bugfix, patterns=listed("bug_patterns", c.bugfix.patterns)),
        coupling=replace(
            c.coupling,
            min_co_commits=got("min_co_commits", c.coupling.min_co_commits),
            min_jaccard_threshold=got("min_jaccard", c.coupling.min_jaccard_threshold),
            max_files_per_commit=got("max_files", c.coupling.max_files_per_commit),
            top_pairs=got("top_pairs", c.coupling.top_pairs),
        ),
        filters=replace(c.filters, include=listed("include", c.filters.include), exclude=listed("exclude", c.filters.exclude)),
    )


def session() -> SparkSession:
    return SparkSession.builder.appName("faultline").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()


class Command:
    def __init__(self, args: argparse.Namespace, spark: SparkSession | None = None):
        self.args, self.config = args, configured(args)
        self.spark = spark or session()
        self.until = args.until or datetime.now(timezone.utc)
        self.until_text = self.until.strftime("%Y-%m-%d %H:%M:%S")
        self.options = sinks.Options(args.format, args.top, args.output, args.explain)

    def history(self, detail: str = "full") -> DataFrame:
        a, f = self.args, self.config.filters
        rows = git.history(self.spark, a.repo, a.branch, a.since, a.until, a.rename_detect, detail)
        return filters.globs(rows, f.include, f.exclude).persist()

    def report(self, kind: str, items: DataFrame, totals: dict[str, int] | None = None) -> None:
        sinks.write(sinks.Report(kind, self.args.repo, self.until, items, self.args.since, totals or {}), self.options)

    def aliases(self, rows: DataFrame) -> DataFrame:
        return graph.aliases(graph.edges_of(filters.live(rows)))

    def analyze(self, rows: DataFrame) -> None:
        a, aliases, sizes = self.args, self.aliases(rows), None
        if a.include_complexity:
            from faultline.operators.files import canonical

            sizes = git.file_sizes(self.spark, a.repo, a.branch, canonical(filters.live(rows), aliases))
        diff = git.diff(self.spark, a.repo, a.diff) if a.diff else None
        items = reports.hotspots(rows, self.config, self.until_text, aliases, sizes, diff, a.explain)
        ranked = scoring.ranked(items.persist(), "risk_score", "path")
        self.report("files", ranked)
        if a.ci_threshold > 0:
            first = ranked.select("path", "risk_score").first()
            if first and first.risk_score >= a.ci_threshold:
                raise Failure(f"risk threshold exceeded: {first.path} has score {first.risk_score:.4f} (threshold: {a.ci_threshold:.4f})")

    def commits(self, rows: DataFrame) -> None:
        items = reports.risky_commits(rows, self.config, self.args.risk_level, self.args.explain)
        from faultline.functions.scalars import first_line

        self.report("commits", scoring.ranked(items.withColumn("message", first_line(F.col("message"))), "risk_score", "seq", "sha"))

    def coupling(self, rows: DataFrame) -> None:
        pairs, stats = reports.coupled(rows, self.config)
        commits, files, total = stats.first()
        self.report("coupling", pairs, {"commits": commits, "files": files, "pairs": total})

    def calibrate(self, rows: DataFrame) -> None:
        found = reports.calibrated(rows, self.config, self.until_text, self.aliases(rows), self.args.top_percent)
        if found is None:
            print("No bugfix commits found. Cannot calibrate weights.\nTry other --bug-patterns, or an earlier --since.")
        else:
            sys.stdout.write(sinks.calibration(found, self.args.top_percent))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = parser()
    args = p.parse_args(argv)
    if not args.command:
        p.print_help()
        return 0
    began = time.monotonic()
    name = {"a": "analyze", "c": "commits", "cp": "coupling"}.get(args.command, args.command)
    try:
        command = Command(args, spark)
        rows = command.history("paths" if name == "coupling" else "full")
        if rows.isEmpty():
            print("No commits found in the specified range.")
        else:
            getattr(command, name)(rows)
    except (Failure, git.GitError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    finally:
        print(f"\nCompleted in {time.monotonic() - began:.3f}s", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
