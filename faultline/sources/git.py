"""Change history, diffs and file sizes from a git repository.

Commits are listed once; their changes are then read in partitions of commits, by a git process in each task, so the
repository has to be where executors can read it. Merges, root commits and commits without file changes have no rows.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = (
    "seq long, pos int, sha string, when timestamp, when_iso string, author_name string, author_email string, message string, "
    "path string, old_path string, kind string, lines_added long, lines_deleted long"
)
FORMAT = "%x1e%H%x00%P%x00%cI%x00%an%x00%ae%x00%s%n"
RENAMES = {"off": "--no-renames", "simple": "-M100%", "aggressive": "-M60%"}
FILE_MODES = frozenset((0o100644, 0o100755, 0o120000))
KINDS = {"A": "added", "D": "deleted", "R": "renamed"}
COMMITS_A_TASK = 2000


class GitError(RuntimeError):
    pass


def git(repo: str, *args: str, data: bytes | None = None) -> bytes:
    done = subprocess.run(["git", "-C", repo, *args], input=data, capture_output=True)
    if done.returncode:
        raise GitError(done.stderr.decode("utf-8", "replace").strip() or f"git {args[0]} failed")
    return done.stdout


def validate(repo: str) -> None:
    try:
        git(repo, "rev-parse", "--git-dir")
    except (GitError, OSError) as e:
        raise GitError(f"not a git repository: {repo}") from e


def revision(name: str | None) -> str:
    """A branch or commit; empty and any-case HEAD are the current one. A leading dash would be read as an option."""
    name = (name or "").strip()
    if not name or name.upper() == "HEAD":
        return "HEAD"
    if name.startswith("-"):
        raise ValueError(f"invalid revision: {name}")
    return name


def text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def is_file(mode: str) -> bool:
    return int(mode, 8) in FILE_MODES


@dataclass(frozen=True)
class Entry:
    source_mode: str
    mode: str
    status: str
    path: str
    old_path: str | None


def _until(body: bytes, at: int, stop: bytes, what: str) -> tuple[bytes, int]:
    end = body.find(stop, at)
    if end < 0:
        raise ValueError(f"unexpected end of git output: {what}")
    return body[at:end], end + 1


def raw_entries(body: bytes) -> tuple[list[Entry], int]:
    """The raw entries, and where they end."""
    at = len(body) - len(body.lstrip(b"\0\r\n"))
    out = []
    while body[at : at + 1] == b":":
        meta, at = _until(body, at, b"\0", "raw entry")
        fields = meta[1:].split()
        if len(fields) < 5:
            raise ValueError(f"unexpected raw entry: {meta!r}")
        path, at = _until(body, at, b"\0", "path")
        old, status = None, text(fields[-1])
        if status[:1] in ("R", "C"):
            old = text(path)
            path, at = _until(body, at, b"\0", "second path")
        out.append(Entry(text(fields[0]), text(fields[1]), status, text(path), old))
    return out, at


def numstat(body: bytes, n: int) -> list[tuple[int, int]]:
    """Added and deleted lines of n entries, by position; a dash, for binary files, is 0."""
    at = len(body) - len(body.lstrip(b"\0\r\n"))
    out = []
    for _ in range(n):
        counts = []
        for _ in range(2):
            number, at = _until(body, at, b"\t", "line count")
            counts.append(0 if number == b"-" else int(number))
        path, at = _until(body, at, b"\0", "numstat path")
        if not path:  # a rename has both names behind
            _, at = _until(body, at, b"\0", "old name")
            _, at = _until(body, at, b"\0", "new name")
        out.append((counts[0], counts[1]))
    return out


def kind_of(status: str, old_path: str | None) -> tuple[str, str | None]:
    """Copies and type changes count as modified; only renames keep the old path."""
    kind = KINDS.get(status[:1], "modified")
    return kind, old_path if kind == "renamed" else None


def parse_log(raw: bytes, order: dict[str, int], full: bool = True) -> Iterator[tuple]:
    """Rows of SCHEMA from the log's records."""
    for record in raw.split(b"\x1e"):
        header, _, body = record.partition(b"\n")
        fields = header.split(b"\0")
        if len(fields) < 6:
            continue
        sha, parents, iso, name, email, subject = (text(f) for f in fields[:6])
        if not parents:
            continue
        entries, at = raw_entries(body)
        stats = numstat(body[at:], len(entries)) if full else [(0, 0)] * len(entries)
        when = datetime.fromisoformat(iso).astimezone(timezone.utc)
        for pos, (e, (added, deleted)) in enumerate(zip(entries, stats)):
            if e.path and (is_file(e.source_mode) or is_file(e.mode)):
                kind, old = kind_of(e.status, e.old_path)
                yield (order.get(sha, 0), pos, sha, when, iso, name, email, subject, e.path, old, kind, added, deleted)


@dataclass
class Commits(InputPartition):
    first: int
    shas: list[str]


class HistoryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.repo = os.path.abspath(options.get("repo", "."))
        self.branch = revision(options.get("branch"))
        self.since, self.until = options.get("since"), options.get("until")
        self.full = options.get("detail", "full").lower() != "paths"
        mode = options.get("rename_detect", "aggressive")
        if mode not in RENAMES:
            raise ValueError(f"invalid rename detection: {mode} (off, simple or aggressive)")
        self.renames = RENAMES[mode]
        self.size = int(options.get("commits_a_task", COMMITS_A_TASK))
        validate(self.repo)

    def partitions(self) -> list[Commits]:
        """Newest first, as git lists them; times are unix seconds, both ends included."""
        times = [f"--{k}=@{v}" for k, v in (("since", self.since), ("until", self.until)) if v]
        shas = text(git(self.repo, "rev-list", "--min-parents=1", "--max-parents=1", *times, self.branch, "--")).split()
        return [Commits(i, shas[i : i + self.size]) for i in range(0, len(shas), self.size)] or [Commits(0, [])]

    def read(self, partition: Commits) -> Iterator[tuple]:
        if partition.shas:
            stats = ["--numstat"] if self.full else []
            raw = git(self.repo, "log", "--no-walk=unsorted", "--stdin", "--raw", "-z", *stats, self.renames, f"--format={FORMAT}", data="\n".join(partition.shas).encode() + b"\n")
            order = {sha: partition.first + i for i, sha in enumerate(partition.shas)}
            yield from parse_log(raw, order, self.full)


class HistorySource(DataSource):
    """``spark.read.format("git_history").option("repo", path).load()``."""

    @classmethod
    def name(cls) -> str:
        return "git_history"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HistoryReader:
        return HistoryReader(dict(self.options))


def history(spark: SparkSession, repo: str = ".", branch: str | None = None, since: datetime | None = None, until: datetime | None = None, rename_detect: str = "aggressive", detail: str = "full") -> DataFrame:
    """The rows of a repository's history. ``detail="paths"`` doesn't count lines, which is faster."""
    validate(repo)
    spark.dataSource.register(HistorySource)
    read = spark.read.format("git_history").option("repo", os.path.abspath(repo)).option("branch", revision(branch)).option("rename_detect", rename_detect).option("detail", detail)
    for key, t in (("since", since), ("until", until)):
        if t is not None:
            read = read.option(key, str(int(t.timestamp())))
    return read.load()


def diff_spec(spec: str) -> tuple[str, str]:
    """(base, head) of ``base...head`` or ``base..head``; a missing head is HEAD."""
    for dots in ("...", ".."):
        base, found, head = spec.partition(dots)
        if found:
            if not base:
                raise ValueError(f"invalid diff: {spec} (no base)")
            return revision(base), revision(head)
    raise ValueError(f"invalid diff: {spec} (base...head)")


def parse_diff(raw: bytes) -> list[tuple[str, str | None, str]]:
    """(path, old_path, kind) of name-status output; here a copy counts as added and keeps its source."""
    parts, at, out = raw.split(b"\0"), 0, []
    while at < len(parts):
        status = text(parts[at])
        if not status:
            at += 1
            continue
        if at + 1 >= len(parts):
            break
        letter = status[0]
        if letter in "RC":
            if at + 2 >= len(parts):
                raise ValueError("a rename in the diff has no second path")
            out.append((text(parts[at + 2]), text(parts[at + 1]), "renamed" if letter == "R" else "added"))
            at += 3
        else:
            if parts[at + 1]:
                out.append((text(parts[at + 1]), None, {"A": "added", "D": "deleted"}.get(letter, "modified")))
            at += 2
    return out


def diff(spark: SparkSession, repo: str, spec: str) -> DataFrame:
    """(path, old_path, kind) of what changed."""
    diff_spec(spec)
    rows = parse_diff(git(repo, "diff", "--name-status", "-z", spec, "--"))
    return spark.createDataFrame(rows, "path string, old_path string, kind string")


def count_lines(content: bytes) -> int:
    if not content:
        return 0
    return content.count(b"\n") + (not content.endswith(b"\n"))


def parse_batch(raw: bytes) -> Iterator[bytes | None]:
    """Contents in the order asked for; None for what is missing. Ends at a malformed header."""
    at = 0
    while at < len(raw):
        end = raw.find(b"\n", at)
        if end < 0:
            return
        fields = raw[at:end].split()
        at = end + 1
        if len(fields) == 2 and fields[1] == b"missing":
            yield None
            continue
        if len(fields) != 3 or not fields[2].isdigit():
            return
        size = int(fields[2])
        yield raw[at : at + size]
        at += size + 1


def file_sizes(spark: SparkSession, repo: str, ref: str | None, paths: DataFrame) -> DataFrame:
    """(path, line_count) of the wanted files of a tree; binary files (with a NUL) are absent. Blobs are read where
    the rows are, by one git process a task."""
    repo, rows = os.path.abspath(repo), []
    for line in git(repo, "ls-tree", "-r", revision(ref)).split(b"\n"):
        meta, tab, path = line.partition(b"\t")
        fields = meta.split()
        if tab and len(fields) == 3 and fields[1] == b"blob":
            rows.append((text(path), text(fields[2])))
    tree = spark.createDataFrame(rows, "path string, blob string").join(paths.select("path").distinct(), "path", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            raw = git(repo, "cat-file", "--batch", data="\n".join(b.column(1).to_pylist()).encode() + b"\n")
            found = [(p, count_lines(c)) for p, c in zip(b.column(0).to_pylist(), parse_batch(raw)) if c is not None and b"\0" not in c]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["path", "line_count"])

    return tree.select("path", "blob").mapInArrow(run, "path string, line_count long")
