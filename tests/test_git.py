import json
import os
import subprocess
from datetime import datetime, timezone

import pytest

from faultline import cli
from faultline.sources import git


def run(repo, *args, when="2025-01-01T00:00:00+02:00", email="T@X.com"):
    env = os.environ | {"GIT_AUTHOR_DATE": when, "GIT_COMMITTER_DATE": when, "GIT_AUTHOR_NAME": "T", "GIT_COMMITTER_NAME": "T", "GIT_AUTHOR_EMAIL": email, "GIT_COMMITTER_EMAIL": email, "HOME": str(repo)}
    return subprocess.run(["git", "-C", str(repo), *args], check=True, capture_output=True, env=env).stdout.decode().strip()


def commit(repo, message, when, **contents):
    for path, text in contents.items():
        p = repo / path.replace("__", "/").replace("_", ".")
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text) if text is not None else p.unlink()
    run(repo, "add", "-A")
    run(repo, "commit", "-m", message, when=when)


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    r = tmp_path_factory.mktemp("repo")
    run(r, "init", "-b", "main")
    commit(r, "root", "2025-01-01T00:00:00+02:00", a_go="1\n2\n3\n")
    commit(r, "add b\n\nbody", "2025-01-02T00:00:00+02:00", src__b_go="x\ny\n", bin_dat="a\0b")
    commit(r, "fix: a", "2025-01-03T00:00:00+02:00", a_go="1\n2\nthree\nfour\n")
    run(r, "mv", "src/b.go", "src/c.go")
    run(r, "commit", "-m", "move", when="2025-01-04T00:00:00+02:00")
    run(r, "checkout", "-b", "feature")
    commit(r, "only here", "2025-01-05T00:00:00+02:00", f_go="f")
    run(r, "checkout", "main")
    commit(r, "drop", "2025-01-06T00:00:00+02:00", bin_dat=None)
    run(r, "merge", "--no-ff", "-m", "merge", "feature", when="2025-01-07T00:00:00+02:00")
    return r


def test_history(spark, repo):
    rows = sorted(git.history(spark, str(repo), rename_detect="simple").collect())
    got = [(r.message, r.path, r.old_path, r.kind, r.lines_added, r.lines_deleted) for r in rows]
    assert got == [
        ("drop", "bin.dat", None, "deleted", 0, 0),
        ("only here", "f.go", None, "added", 1, 0),
        ("move", "src/c.go", "src/b.go", "renamed", 0, 0),
        ("fix: a", "a.go", None, "modified", 2, 1),
        ("add b", "bin.dat", None, "added", 0, 0),
        ("add b", "src/b.go", None, "added", 2, 0),
    ]
    assert rows[0].when_iso == "2025-01-06T00:00:00+02:00" and rows[0].when == datetime(2025, 1, 5, 22) and rows[0].author_email == "T@X.com"
    assert {r.kind for r in git.history(spark, str(repo), rename_detect="off").filter("message = 'move'").collect()} == {"added", "deleted"}
    assert git.history(spark, str(repo), detail="paths").agg({"lines_added": "sum"}).first()[0] == 0


def test_branch_and_time(spark, repo):
    assert git.history(spark, str(repo), branch="feature").filter("message = 'drop'").count() == 0
    day = lambda d: datetime(2025, 1, d, tzinfo=timezone.utc)
    assert {r.message for r in git.history(spark, str(repo), since=day(2), until=day(4)).collect()} == {"fix: a", "move"}
    small = spark.read.format("git_history").option("repo", str(repo)).option("commits_a_task", "2").load()
    assert sorted(map(tuple, small.collect()), key=str) == sorted(map(tuple, git.history(spark, str(repo)).collect()), key=str)
    with pytest.raises(git.GitError):
        git.history(spark, "/")
    with pytest.raises(ValueError):
        git.revision("--output=x")
    assert git.revision(" head ") == git.revision(None) == "HEAD"


def test_diff(spark, repo):
    base = run(repo, "rev-list", "--max-parents=0", "HEAD")
    got = {(r.path, r.kind) for r in git.diff(spark, str(repo), f"{base}..main").collect()}
    assert got == {("a.go", "modified"), ("src/c.go", "added"), ("f.go", "added")}
    assert git.diff_spec("a...b") == ("a", "b") and git.diff_spec("a..") == ("a", "HEAD")
    for bad in ("a", "..b", "...b", "-x..b"):
        with pytest.raises(ValueError):
            git.diff_spec(bad)
    assert git.parse_diff(b"M\0file1.go\0A\0file2.go\0D\0file3.go\0") == [("file1.go", None, "modified"), ("file2.go", None, "added"), ("file3.go", None, "deleted")]
    assert git.parse_diff(b"R100\0old.go\0new.go\0C75\0x\0y\0M") == [("new.go", "old.go", "renamed"), ("y", "x", "added")]
    with pytest.raises(ValueError):
        git.parse_diff(b"R100\0old.go")


def test_sizes(spark, repo):
    wanted = spark.createDataFrame([("a.go",), ("src/c.go",), ("absent",)], "path string")
    assert {r.path: r.line_count for r in git.file_sizes(spark, str(repo), "", wanted).collect()} == {"a.go": 4, "src/c.go": 2}
    assert [git.count_lines(x) for x in (b"", b"hello", b"hello\n", b"a\nb", b"\n\n\n")] == [0, 1, 1, 2, 3]
    assert list(git.parse_batch(b"ab blob 3\nx\ny\ncd missing\nzz")) == [b"x\ny", None]


def test_bytes():
    raw = b"\n:100644 100644 a b M\0a.txt\0:100644 100644 c d R100\0old.go\0new.go\0" + b"1\t2\ta.txt\0" + b"3\t4\t\0old.go\0new.go\0\0"
    entries, at = git.raw_entries(raw)
    assert [(e.status, e.path, e.old_path) for e in entries] == [("M", "a.txt", None), ("R100", "new.go", "old.go")]
    assert git.numstat(raw[at:], 2) == [(1, 2), (3, 4)] and git.numstat(b"-\t-\tx\0", 1) == [(0, 0)]
    assert git.kind_of("C90", "x") == ("modified", None) and git.kind_of("R90", "x") == ("renamed", "x") and git.is_file("120000") and not git.is_file("160000")
    for bad in (b":100644", b":1 2\0a\0"):
        with pytest.raises(ValueError):
            git.raw_entries(bad)


def test_commands(spark, repo, capsys, tmp_path):
    out = tmp_path / "o.json"
    assert cli.main(["analyze", "-r", str(repo), "-f", "json", "-o", str(out), "--explain", "--include-complexity", "--until", "2025-02-01"], spark) == 0
    found = json.loads(out.read_text())
    assert found["totalFiles"] == 4 and found["until"] == "2025-02-01" and {i["path"] for i in found["items"]} == {"a.go", "src/c.go", "f.go", "bin.dat"}
    a = next(i for i in found["items"] if i["path"] == "a.go")
    assert a["metrics"]["fileSize"] == 4 and a["metrics"]["bugfixCount"] == 1 and a["metrics"]["lastModified"] == "2025-01-03T00:00:00+02:00" and set(a["breakdown"]) == {"commit", "churn", "recency", "burst", "ownership", "bugfix", "complexity"}
    assert cli.main(["a", "-r", str(repo), "--diff", "main~1..main", "-f", "ci", "--ci-threshold", "0.01"], spark) == 1
    said = capsys.readouterr()
    assert "risk threshold exceeded" in said.err and json.loads(said.out.split("\n")[0])["totalFiles"] == 1
    assert cli.main(["c", "-r", str(repo), "-f", "md", "--risk-level", "high"], spark) == 0
    assert "# Commit Risk Analysis Results" in capsys.readouterr().out
    assert cli.main(["cp", "-r", str(repo), "--min-co-commits", "1", "-f", "csv"], spark) == 0
    assert "bin.dat,src/b.go,1,1,1,1.000000,1.000000,1.000000" in capsys.readouterr().out
    assert cli.main(["calibrate", "-r", str(repo), "--until", "2025-02-01"], spark) == 0
    assert "Recommended weights:" in capsys.readouterr().out
    assert cli.main(["commits", "-r", str(repo), "--since", "2030-01-01", "-f", "json"], spark) == 0
    assert capsys.readouterr().out == "No commits found in the specified range.\n"
    assert cli.main(["analyze", "-r", "/"], spark) == 1
    assert cli.main(["analyze", "-r", str(repo), "--include", "["], spark) == 1
    assert cli.main([], spark) == 0
