"""Reports as console tables, JSON, CSV, Markdown and newline-delimited JSON.

A report is a header and the first rows of a ranked DataFrame: rows come to the driver only up to ``top`` (or all, if
it is not positive, as the reports themselves are then asked for in full)."""

from __future__ import annotations

import csv
import io
import json
import sys
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.config import Thresholds
from faultline.operators.scoring import ci_summary

GREEN, RED, YELLOW, CYAN, PLAIN = "\x1b[32m", "\x1b[31m", "\x1b[33m", "\x1b[36m", "\x1b[0m"
LEVEL = {"high": (RED, "\U0001f534"), "medium": (YELLOW, "\U0001f7e1")}
ELLIPSIS = "..."


@dataclass(frozen=True)
class Options:
    format: str = "console"
    top: int = 50
    output: str = ""
    explain: bool = False


@dataclass
class Report:
    """``kind`` is files, commits or coupling; ``items`` are ranked; ``totals`` belong to coupling."""

    kind: str
    repo: str
    until: datetime
    items: DataFrame
    since: datetime | None = None
    totals: dict[str, int] = field(default_factory=dict)
    generated: datetime = field(default_factory=lambda: datetime.now(timezone.utc))


@dataclass(frozen=True)
class Column:
    """A value of a row, with its names and formats in the different reports; None: not shown there."""

    get: str
    csv: str
    as_csv: str
    key: str | None
    group: str | None = None
    table: str | None = None
    as_table: str = ""


FILES = [
    Column("path", "Path", "s", "path", None, "Path", "s"),
    Column("risk_score", "RiskScore", ".6f", "riskScore", None, "Score", ".4f"),
    Column("commit_count", "CommitCount", "d", "commitCount", "metrics", "Commits", "d"),
    Column("added_lines", "ChurnAdded", "d", "churnAdded", "metrics"),
    Column("deleted_lines", "ChurnDeleted", "d", "churnDeleted", "metrics"),
    Column("churn_total", "ChurnTotal", "d", "churnTotal", "metrics", "Churn", "d"),
    Column("last_modified", "LastModified", "t", "lastModified", "metrics"),
    Column("contributor_count", "Contributors", "d", "contributors", "metrics", "Contributors", "d"),
    Column("burst_score", "BurstScore", ".6f", "burstScore", "metrics", "Burst", ".2f"),
    Column("ownership_ratio", "OwnershipRatio", ".6f", "ownershipRatio", "metrics"),
    Column("bugfix_count", "BugfixCount", "d", "bugfixCount", "metrics", "Bugfixes", "d"),
    Column("file_size", "FileSize", "d", "fileSize", "metrics", "Lines", "d"),
]
FILE_PARTS = {"commit": "C", "churn": "Ch", "recency": "R", "burst": "B", "ownership": "O", "bugfix": "Bf", "complexity": "Cx"}
COMMITS = [
    Column("sha", "SHA", "s", "sha", None, "SHA", "sha"),
    Column("when", "When", "t", "when"),
    Column("author_name", "Author", "s", "author"),
    Column("message", "Message", "s", "message"),
    Column("risk_score", "RiskScore", ".6f", "riskScore", None, "Score", ".4f"),
    Column("risk_level", "RiskLevel", "s", "riskLevel", None, "Level", "level"),
    Column("file_count", "FileCount", "d", "fileCount", "metrics", "Files", "d"),
    Column("directory_count", "DirectoryCount", "d", "directoryCount", "metrics"),
    Column("subsystem_count", "SubsystemCount", "d", "subsystemCount", "metrics"),
    Column("lines_added", "LinesAdded", "d", "linesAdded", "metrics"),
    Column("lines_deleted", "LinesDeleted", "d", "linesDeleted", "metrics"),
    Column("total_churn", "TotalChurn", "d", "totalChurn", "metrics", "Churn", "d"),
    Column("change_entropy", "ChangeEntropy", ".6f", "changeEntropy", "metrics", "Entropy", ".2f"),
]
COMMIT_PARTS = {"diffusion": "D", "size": "S", "entropy": "E"}
PAIRS = [
    Column("file_a", "FileA", "s", "fileA", None, "File A", "s"),
    Column("file_b", "FileB", "s", "fileB", None, "File B", "s"),
    Column("co_commit_count", "CoCommitCount", "d", "coCommitCount", None, "Co-Commits", "d"),
    Column("file_a_commit_count", "FileACommitCount", "d", "fileACommitCount"),
    Column("file_b_commit_count", "FileBCommitCount", "d", "fileBCommitCount"),
    Column("jaccard", "JaccardCoefficient", ".6f", "jaccardCoefficient", None, "Jaccard", ".3f"),
    Column("confidence", "Confidence", ".6f", "confidence", None, "Confidence", ".3f"),
    Column("lift", "Lift", ".6f", "lift", None, "Lift", ".2f"),
]
KINDS = {
    "files": ("File Hotspot Analysis Results", "files", "Top Hotspots", FILES, FILE_PARTS),
    "commits": ("Commit Risk Analysis Results", "commits", "High-Risk Commits", COMMITS, COMMIT_PARTS),
    "coupling": ("Change Coupling Analysis Results", "", "Coupled File Pairs", PAIRS, {}),
}
NOTHING = "No significant file couplings found."


def _cut(s: str, most: int) -> str:
    """To ``most`` bytes."""
    raw = s.encode()
    return s if len(raw) <= most else raw[: most - len(ELLIPSIS)].decode("utf-8", "replace") + ELLIPSIS


def escape_markdown(s: str) -> str:
    return "".join("\\" + c if c in "|*_`" else c for c in s)


def emoji(level: str) -> str:
    return LEVEL.get(level, ("", "\U0001f7e2"))[1]


def colour(level: str) -> str:
    return LEVEL.get(level, (GREEN, ""))[0]


def period(report: Report) -> tuple[str, str]:
    until = report.until.strftime("%Y-%m-%d")
    return ("Period", f"{report.since:%Y-%m-%d} to {until}") if report.since else ("Until", until)


def _iso(row: dict[str, Any], name: str) -> str:
    return (row.get(f"{name}_iso") or row[name].strftime("%Y-%m-%dT%H:%M:%SZ")).replace("+00:00", "Z")


def _value(row: dict[str, Any], c: Column, how: str) -> str:
    v = row[c.get]
    if how == "t":
        return _iso(row, c.get)[:19]
    if how == "sha":
        return v[:8]
    return format(v, "" if how in ("s", "level") else how)


def rows_of(report: Report, options: Options) -> tuple[int, list[dict[str, Any]]]:
    """(rows before the limit, rows to show)."""
    items = report.items
    if report.kind == "files":
        items = items.withColumn("churn_total", F.col("added_lines") + F.col("deleted_lines"))
    elif report.kind == "commits":
        items = items.withColumn("total_churn", F.col("lines_added") + F.col("lines_deleted"))
    if options.top > 0:
        return report.items.count(), [r.asDict(True) for r in items.limit(options.top).collect()]
    rows = [r.asDict(True) for r in items.collect()]
    return len(rows), rows


def _parts(report: Report, options: Options, rows: list[dict[str, Any]]) -> dict[str, str]:
    """The parts of the score to show, with their letters."""
    return KINDS[report.kind][4] if options.explain and "breakdown" in report.items.columns else {}


def _table(report: Report, options: Options, rows: list[dict[str, Any]], markdown: bool) -> tuple[list[str], list[list[str]]]:
    columns = [c for c in KINDS[report.kind][3] if c.table]
    parts = _parts(report, options, rows)
    head = ["#", *[c.table for c in columns], *(["Message"] if report.kind == "commits" else []), *parts.values()]
    body = []
    for i, row in enumerate(rows, 1):
        cells = [str(i)]
        for c in columns:
            cell = _value(row, c, c.as_table)
            if markdown and c.as_table in ("s", "sha"):
                cell = f"`{cell}`"
            elif c.as_table == "level":
                cell = f"{emoji(cell)} {cell}" if markdown else f"{colour(cell)}{cell}{PLAIN}"
            cells.append(cell)
        if report.kind == "commits":
            cells.append(_cut(escape_markdown(row["message"]) if markdown else row["message"], 40))
        cells += [format(row["breakdown"][p], ".3f") for p in parts]
        body.append(cells)
    return head, body


def _legend(parts: dict[str, str]) -> str:
    return ", ".join(f"{letter}={name.title()}" for name, letter in parts.items())


def console(report: Report, options: Options) -> str:
    n, rows = rows_of(report, options)
    title, noun, _, _, _ = KINDS[report.kind]
    label, value = period(report)
    out = [f"{GREEN}{title}{PLAIN}", f"Repository: {report.repo}", f"{label}: {value}"]
    if noun:
        out += [f"Total {noun} analyzed: {n}", ""]
    else:
        out += [", ".join(f"Total {k}: {report.totals[k]}" for k in ("commits", "files", "pairs")), ""]
        if not n:
            return "\n".join([*out, NOTHING, ""])
    head, body = _table(report, options, rows, False)
    lines = [head, *body]
    widths = [max(len(line[i]) for line in lines) + 2 for i in range(len(head) - 1)]
    out += ["".join(cell.ljust(w) for cell, w in zip(line, widths)) + line[-1] for line in lines]
    if parts := _parts(report, options, rows):
        out += ["", f"Score breakdown: {_legend(parts)}"]
    return "\n".join(out) + "\n"


def markdown(report: Report, options: Options) -> str:
    n, rows = rows_of(report, options)
    title, noun, section, _, _ = KINDS[report.kind]
    label, value = period(report)
    out = [f"# {title}", "", f"**Repository:** {report.repo}", "", f"**{label}:** {value}", ""]
    if noun:
        out += [f"**Total {noun.title()} Analyzed:** {n}", ""]
    else:
        out += ["**Statistics:** " + ", ".join(f"{report.totals[k]} {k}" for k in ("commits", "files", "pairs")) + " analyzed", ""]
        if not n:
            return "\n".join([*out, NOTHING, ""])
    head, body = _table(report, options, rows, True)
    out += [f"## {section}", "", "| " + " | ".join(head) + " |", "|" + "|".join("-" * (len(h) + 2) for h in head) + "|"]
    out += ["| " + " | ".join(cells) + " |" for cells in body]
    if parts := _parts(report, options, rows):
        out += ["", f"**Score Breakdown:** {_legend(parts)}"]
    return "\n".join(out) + "\n"


def _dump(value: Any, indent: int | None = None) -> str:
    """JSON with <, > and & written as escapes."""
    raw = json.dumps(value, indent=indent, ensure_ascii=False, separators=None if indent else (",", ":"))
    for c in "<>&  ":
        raw = raw.replace(c, f"\\u{ord(c):04x}")
    return raw


def _number(v: Any) -> Any:
    """Whole doubles without a fraction."""
    return int(v) if isinstance(v, float) and v == int(v) and abs(v) < 1e15 else v


def as_json(report: Report, options: Options) -> str:
    n, rows = rows_of(report, options)
    _, noun, _, columns, _ = KINDS[report.kind]
    parts, items = _parts(report, options, rows), []
    for row in rows:
        item: dict[str, Any] = {}
        for c in columns:
            v = _iso(row, c.get) if c.as_csv == "t" else _number(row[c.get])
            (item.setdefault(c.group, {}) if c.group else item)[c.key] = v
        if parts:
            item["breakdown"] = {p: _number(row["breakdown"][p]) for p in parts}
        items.append(item)
    head: dict[str, Any] = {"repo": report.repo}
    if report.since:
        head["since"] = report.since.strftime("%Y-%m-%d")
    head |= {"until": report.until.strftime("%Y-%m-%d"), "generatedAt": report.generated.strftime("%Y-%m-%dT%H:%M:%SZ")}
    head |= {f"total{noun.title()}": n} if noun else {f"total{k.title()}": report.totals[k] for k in ("commits", "files", "pairs")}
    return _dump(head | {"items": items}, 2) + "\n"


def as_csv(report: Report, options: Options) -> str:
    _, rows = rows_of(report, options)
    columns, parts, out = KINDS[report.kind][3], _parts(report, options, rows), io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow([*[c.csv for c in columns], *[f"{p.title()}Component" for p in parts]])
    for row in rows:
        writer.writerow([*[_value(row, c, c.as_csv) for c in columns], *[format(row["breakdown"][p], ".6f") for p in parts]])
    return out.getvalue()


def ci(report: Report, options: Options) -> str:
    """A summary line and a line a file, by the default thresholds; of the limited rows only."""
    items = report.items.limit(options.top) if options.top > 0 else report.items
    total = ci_summary(items).first()
    level, out = Thresholds(), [_dump({"type": "summary", "totalFiles": total[0], "highRiskCount": total[1], "mediumRiskCount": total[2], "maxRiskScore": _number(total[3])})]
    for row in rows_of(report, options)[1]:
        out.append(_dump({"type": "file", "path": row["path"], "riskScore": _number(row["risk_score"]), "riskLevel": level.classify(row["risk_score"])}))
    return "\n".join(out) + "\n"


FORMATS = {"json": as_json, "csv": as_csv, "markdown": markdown, "md": markdown, "ci": ci, "ndjson": ci}


def writer(kind: str, name: str):
    """The writer of a format; unknown formats, and ci for anything but files, give the console's."""
    found = FORMATS.get(name, console)
    return console if found is ci and kind != "files" else found


def write(report: Report, options: Options) -> None:
    """To the output path or to standard output; the console format has no output path."""
    make = writer(report.kind, options.format)
    made = make(report, options)
    if options.output and make is not console:
        with open(options.output, "w", encoding="utf-8", newline="") as f:
            f.write(made)
    else:
        sys.stdout.write(made)


def calibration(result, top_percent: int) -> str:
    """What a calibration found, with marks at weights that change by more than 0.01."""
    out = [f"{GREEN}Calibration Results (based on {result.bugfix_files} bugfix files out of {result.total_files} total files):{PLAIN}", ""]
    out += [f"Current weights detection rate (top {top_percent}%): {result.current_rate * 100:.1f}%", "", "Recommended weights:"]
    for name, new, old in zip(FILE_PARTS, result.recommended_weights.as_list(), result.current_weights.as_list()):
        mark = f"{CYAN}  ^{PLAIN}" if new > old + 0.01 else f"{YELLOW}  v{PLAIN}" if new < old - 0.01 else ""
        out.append(f"  {name + ':':<12} {new:.2f} (current: {old:.2f}){mark}")
    out += ["", f"Expected detection rate with recommended weights (top {top_percent}%): {result.recommended_rate * 100:.1f}%"]
    gain = (result.recommended_rate - result.current_rate) * 100
    out += ["", f"{GREEN}Improvement: +{gain:.1f} percentage points{PLAIN}" if gain > 0 else f"{GREEN}Current weights are already optimal for this dataset.{PLAIN}"]
    return "\n".join(out) + "\n"
