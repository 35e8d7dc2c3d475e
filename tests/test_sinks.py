import json
from datetime import datetime

import pytest

from faultline.sinks import reports as sinks

UNTIL = datetime(2025, 2, 1)


@pytest.fixture(scope="module")
def files(spark):
    rows = [("a<b>.go", 0.85, 3, 10, 5, datetime(2025, 1, 3), 2, 0.5, 1.0, 1, 7), ("b.go", 0.5, 2, 1, 1, datetime(2025, 1, 2), 1, 0.125, 1.0, 0, 0), ("c.go", 0.2, 1, 0, 0, datetime(2025, 1, 1), 1, 5e-7, 1.0, 0, 0)]
    return spark.createDataFrame(rows, "path string, risk_score double, commit_count long, added_lines long, deleted_lines long, last_modified timestamp, contributor_count long, burst_score double, ownership_ratio double, bugfix_count long, file_size long")


def report(items, **more):
    return sinks.Report("files", "repo", UNTIL, items, **more)


def test_ci(files):
    lines = [json.loads(x) for x in sinks.ci(report(files), sinks.Options(top=0)).splitlines()]
    assert len(lines) == 4 and lines[0] == {"type": "summary", "totalFiles": 3, "highRiskCount": 1, "mediumRiskCount": 1, "maxRiskScore": 0.85}
    assert [x["riskLevel"] for x in lines[1:]] == ["high", "medium", "low"]


def test_limit(files):
    assert [len(sinks.rows_of(report(files), sinks.Options(top=n))[1]) for n in (0, -1, 2, 5)] == [3, 3, 2, 3]
    assert json.loads(sinks.as_json(report(files), sinks.Options(top=1)))["totalFiles"] == 3


def test_json(files):
    made = sinks.as_json(report(files, since=datetime(2025, 1, 1)), sinks.Options())
    assert "a\\u003cb\\u003e.go" in made and made.startswith('{\n  "repo": "repo",\n  "since": "2025-01-01",')
    assert json.loads(made)["items"][2]["metrics"]["burstScore"] == 5e-7
    assert json.loads(sinks.as_json(report(files.limit(0)), sinks.Options()))["items"] == []


def test_csv(files):
    lines = sinks.as_csv(report(files), sinks.Options()).split("\n")
    assert lines[0].startswith("Path,RiskScore,CommitCount") and lines[1] == "a<b>.go,0.850000,3,10,5,15,2025-01-03T00:00:00,2,0.500000,1.000000,1,7"
    assert lines[3].split(",")[8] == "0.000000"


def test_tables(files):
    text = sinks.console(report(files), sinks.Options(top=2))
    assert "Total files analyzed: 3" in text and "Until: 2025-02-01" in text and "c.go" not in text
    text = sinks.markdown(report(files, since=datetime(2025, 1, 1)), sinks.Options())
    assert "**Period:** 2025-01-01 to 2025-02-01" in text and "| 1 | `a<b>.go` | 0.8500 | 3 | 15 | 2 | 0.50 | 1 | 7 |" in text


def test_helpers(tmp_path, files, capsys):
    assert [sinks.escape_markdown(x) for x in ("a|b", "a*b", "a_b", "a`b")] == ["a\\|b", "a\\*b", "a\\_b", "a\\`b"]
    assert sinks._cut("x" * 50, 40) == "x" * 37 + "..." and sinks._cut("x" * 40, 40) == "x" * 40
    assert sinks.writer("commits", "ci") is sinks.console and sinks.writer("files", "ndjson") is sinks.ci and sinks.writer("files", "?") is sinks.console
    sinks.write(report(files), sinks.Options("csv", output=str(tmp_path / "x.csv")))
    assert (tmp_path / "x.csv").read_text().count("\n") == 4
    sinks.write(report(files), sinks.Options("console", output=str(tmp_path / "y")))
    assert not (tmp_path / "y").exists() and "Hotspot" in capsys.readouterr().out


def test_no_pairs(spark):
    empty = spark.createDataFrame([], "file_a string, file_b string, co_commit_count long, file_a_commit_count long, file_b_commit_count long, jaccard double, confidence double, lift double")
    r = sinks.Report("coupling", "repo", UNTIL, empty, totals={"commits": 1, "files": 2, "pairs": 3})
    assert sinks.NOTHING in sinks.console(r, sinks.Options()) and sinks.NOTHING in sinks.markdown(r, sinks.Options())
