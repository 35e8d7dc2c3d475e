"""Small histories with known results."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from faultline.config import CommitScoring, Config, Coupling, Scoring, Weights
from faultline.operators import calibration, commits, coupling, files, filters, graph, scoring
from faultline.plans import reports

SCHEMA = "seq long, pos int, sha string, when timestamp, when_iso string, author_name string, author_email string, message string, path string, old_path string, kind string, lines_added long, lines_deleted long"
T0 = datetime(2025, 1, 1)


def row(seq, sha, path, when=T0, added=1, deleted=0, kind="modified", old=None, email="a@x.com", message="m", pos=0):
    return (seq, pos, sha, when, when.strftime("%Y-%m-%dT%H:%M:%S+00:00"), "N", email, message, path, old, kind, added, deleted)


def hist(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def by_path(df):
    return {r.path: r for r in df.collect()}


def test_file_aggregate_and_deletes(spark):
    h = hist(spark, [row(1, "abc123", "file1", T0, 10, 5, email="Al@x.com"), row(1, "abc123", "file2", T0, 3, 1, email="al@x.com"), row(0, "def456", "file1", T0 + timedelta(31), 5, 2, email="bob@x.com"), row(0, "def456", "gone", kind="deleted", deleted=50)])
    m = by_path(files.metrics(h))
    assert set(m) == {"file1", "file2"}
    f = m["file1"]
    assert (f.commit_count, f.added_lines, f.deleted_lines, f.contributor_count, f.ownership_ratio) == (2, 15, 7, 2, 0.5)
    assert f.last_modified == T0 + timedelta(31) and f.last_modified_iso == "2025-02-01T00:00:00+00:00"
    assert m["file2"].contributor_count == 1


def test_same_path_twice_counts_rows(spark):
    h = hist(spark, [row(0, "s", "p"), row(0, "s", "p", pos=1), row(0, "s", "q", pos=2)])
    assert by_path(files.metrics(h))["p"].commit_count == 2
    pairs, stats = coupling.analyze(h, Coupling(min_co_commits=1, min_jaccard_threshold=0.0))
    assert pairs.first().co_commit_count == 1 and stats.first()[:] == (1, 2, 1)


@pytest.mark.parametrize("newest_first", [True, False])
def test_rename(spark, newest_first):
    a, b = (1, 0) if newest_first else (0, 1)
    h = hist(spark, [row(a, "s1", "old.go", added=10, deleted=5, message="fix it"), row(b, "s2", "new.go", added=2, deleted=1, kind="renamed", old="old.go")])
    m = by_path(files.metrics(h, [r"\bfix\b"], aliases=graph.aliases(graph.edges_of(h))))
    assert set(m) == {"new.go"}
    assert (m["new.go"].commit_count, m["new.go"].added_lines, m["new.go"].deleted_lines, m["new.go"].bugfix_count) == (2, 12, 6, 1)


def test_rename_fold():
    assert graph.fold([("A", "C"), ("A", "B")])["C"] == "B"
    assert graph.fold([("A", "B"), ("B", "A")])["A"] == "B"
    chain = graph.fold([(f"p{i}", f"p{i + 1}") for i in range(40)])
    assert set(chain.values()) == {"p40"}
    assert graph.fold([("", "x"), ("y", "")]) == {}


def test_rename_components_equal_driver_fold(spark):
    random.seed(4)
    edges = [(i, 0, f"n{random.randrange(60)}", f"n{random.randrange(60)}") for i in range(40)]
    df = spark.createDataFrame(edges, "seq long, pos int, old_path string, path string")
    near = {r.path: r.canonical for r in graph.aliases(df).collect()}
    far = {r.path: r.canonical for r in graph.aliases(df, driver_edges=0).collect()}
    assert {k: v for k, v in near.items() if k != v} == {k: v for k, v in far.items() if k != v}


def slow_burst(times, days):
    times, best, left = sorted(times), 0, 0
    for right, t in enumerate(times):
        while t - times[left] > timedelta(days):
            left += 1
        best = max(best, right - left + 1)
    return best / len(times) if times else 0.0


def test_burst(spark):
    random.seed(1)
    cases = {
        "one": [0], "daily": range(5), "monthly": range(0, 300, 30), "two": [*range(5), *range(180, 185)], "edge": [0, 7], "past": [0, 7 + 1 / 86400],
        **{f"r{i}": [random.choice([random.uniform(0, 365), random.randrange(30)]) for _ in range(random.randrange(1, 60))] for i in range(20)},
    }
    rows = [row(0, f"{p}{i}", p, T0 + timedelta(seconds=round(d * 86400))) for p, days in cases.items() for i, d in enumerate(days)]
    random.shuffle(rows)
    for window in (7, 0):
        got = {r.path: r.burst_score for r in files.burst(hist(spark, rows), window).collect()}
        for p, days in cases.items():
            assert got[p] == pytest.approx(slow_burst([T0 + timedelta(seconds=round(d * 86400)) for d in days], 7)), p
    assert (got["one"], got["daily"], got["monthly"], got["two"], got["edge"], got["past"]) == (1, 1, 0.1, 0.5, 1, 0.5)


def test_commit_metrics(spark):
    h = hist(spark, [
        row(0, "one", "main.go", added=5),
        *[row(1, "equal", f"a/f{i}", added=10, pos=i) for i in range(3)],
        row(2, "skew", "A/x", added=100), row(2, "skew", "a/y", added=1, pos=1),
        row(3, "zero", "a/x", added=0), row(3, "zero", "b/y", added=0, pos=1),
        row(4, "dead", "a/x", added=4), row(4, "dead", "b/y", added=0, deleted=4, kind="deleted", pos=1), row(4, "dead", "b/z", added=0, pos=2),
    ])
    m = {r.sha: r for r in commits.metrics(h).collect()}
    assert (m["one"].directory_count, m["one"].subsystem_count, m["one"].change_entropy) == (0, 1, 0)
    assert m["equal"].change_entropy == pytest.approx(1) and m["skew"].change_entropy < 0.2 and m["skew"].directory_count == 1
    assert m["zero"].change_entropy == 1 and m["dead"].file_count == 3 and m["dead"].change_entropy == pytest.approx(0.6309297)


def test_commit_scores_and_levels(spark):
    h = hist(spark, [row(0, "small", "a", added=1), *[row(1, "big", f"d{i}/f", added=50, pos=i) for i in range(10)], *[row(2, "mid", f"d{i}/f", added=10, pos=i) for i in range(3)]])
    items = scoring.score_commits(commits.metrics(h), CommitScoring(), explain=True)
    got = {r.sha: r for r in items.collect()}
    assert got["big"].risk_level == "high" and got["big"].risk_score > got["mid"].risk_score > got["small"].risk_score
    for r in got.values():
        assert r.risk_score == pytest.approx(sum(r.breakdown)) and 0 <= r.risk_score <= 1
    levels = spark.createDataFrame([("h", "high"), ("m", "medium"), ("l", "low")], "sha string, risk_level string")
    assert [filters.at_level(levels, x).count() for x in ("high", "medium", "low", "")] == [1, 2, 3, 3]


def test_hot_before_cold(spark):
    rows = [row(i, f"h{i}", "hot", T0 + timedelta(hours=i), 25, 10, email=f"{'abc'[i % 3]}@x") for i in range(20)] + [row(99, "c", "cold", T0 - timedelta(364), 5)]
    items = reports.hotspots(hist(spark, rows), Config(), "2025-01-02", explain=True)
    got = [r.path for r in scoring.ranked(items, "risk_score", "path").collect()]
    assert got == ["hot", "cold"] and [r.path for r in scoring.ranked(items, "risk_score", "path", top=1).collect()] == ["hot"]
    assert items.filter("risk_score > 0.9").count() == 0 and {r.breakdown.complexity for r in items.collect()} == {0.0}


def test_norm_contexts(spark):
    f = spark.createDataFrame([("a", 2, 10, 5, 1, 0), ("b", 10, 100, 50, 7, 0), ("c", 5, 30, 20, 3, 0)], "path string, commit_count long, added_lines long, deleted_lines long, bugfix_count long, file_size long")
    assert scoring.file_context(f).first()[:6] == (2, 10, 15, 150, 1, 7)
    assert scoring.file_context(f.limit(0)).first()[:] == (0,) * 8


def slow_coupling(history, c):
    per, n, co = {}, {}, {}
    for sha, path, kind in history:
        if kind != "deleted":
            per.setdefault(sha, set()).add(path.lower())
    fit = [sorted(x) for x in per.values() if 2 <= len(x) <= c.max_files_per_commit]
    for x in fit:
        for i, a in enumerate(x):
            n[a] = n.get(a, 0) + 1
            for b in x[i + 1 :]:
                co[a, b] = co.get((a, b), 0) + 1
    out = {k: (v, n[k[0]], n[k[1]], v / (n[k[0]] + n[k[1]] - v)) for k, v in co.items() if v >= c.min_co_commits}
    return {k: v for k, v in out.items() if v[3] >= c.min_jaccard_threshold}, (len(fit), len(n), len(co))


def test_coupling(spark):
    rows = [row(i, f"s{i}", p, pos=j) for i, ps in enumerate([["a", "b"]] * 4 + [["a", "o"]] * 6 + [["b", "q"]] * 2) for j, p in enumerate(ps)]
    pairs, _ = coupling.analyze(hist(spark, rows), Coupling(min_co_commits=1, min_jaccard_threshold=0.0))
    ab = pairs.filter("file_a = 'a' AND file_b = 'b'").first()
    assert ab.co_commit_count == 4 and ab.jaccard == pytest.approx(4 / 12)
    assert coupling.top(pairs, 2).count() == 2 and coupling.top(pairs, 0).count() == 0
    with pytest.raises(ValueError):
        coupling.top(pairs, -1)


def test_coupling_random(spark):
    random.seed(7)
    rows = [row(i, f"s{i}", random.choice("ABCDEFghijk") + ".go", kind=random.choice(["modified"] * 5 + ["deleted"]), pos=j) for i in range(60) for j in range(random.randrange(1, 9))]
    c = Coupling(min_co_commits=2, min_jaccard_threshold=0.05, max_files_per_commit=5)
    pairs, stats = coupling.analyze(hist(spark, rows), c)
    expected, totals = slow_coupling([(r[2], r[8], r[10]) for r in rows], c)
    got = {(r.file_a, r.file_b): (r.co_commit_count, r.file_a_commit_count, r.file_b_commit_count, r.jaccard) for r in pairs.collect()}
    assert got.keys() == expected.keys() and all(got[k] == pytest.approx(expected[k]) for k in got) and stats.first()[:] == totals


def test_coupling_sorts_commits_once(spark):
    """Without joins or sets over the history; a huge commit, repeated paths and null ones count as before."""
    rows = [row(0, "huge", f"p{i}", pos=i) for i in range(400)] + [row(1, "s", p, pos=i) for i, p in enumerate(["b", "A", "a", None, None])] + [row(2, "t", "a"), row(2, "t", "c", pos=1), row(2, "t", "x", pos=2), row(3, "alone", "a")]
    found = coupling.eligible(hist(spark, rows), 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    assert sorted((r.sha, r.file or "", r.later) for r in found.collect()) == [("s", "", ["a", "b"]), ("s", "a", ["b"]), ("s", "b", []), ("t", "a", ["c", "x"]), ("t", "c", ["x"]), ("t", "x", [])]
    pairs, stats = coupling.analyze(hist(spark, rows), Coupling(min_co_commits=1, min_jaccard_threshold=0.0, max_files_per_commit=3))
    assert {(r.file_a, r.file_b, r.file_a_commit_count) for r in pairs.collect()} == {("a", "b", 2), ("a", "c", 2), ("a", "x", 2), ("c", "x", 1)} and stats.first()[:] == (2, 4, 4)


def test_diff_is_union_of_new_and_old_paths(spark):
    items = spark.createDataFrame([("a", 0.1), ("b", 0.2), ("c", 0.3)], "path string, risk_score double")
    diff = spark.createDataFrame([("a", None), ("x", "c"), ("a", "")], "path string, old_path string")
    assert {r.path for r in filters.in_diff(items, diff).collect()} == {"a", "c"}
    assert scoring.gate(items, 0.3).first().exceeded and not scoring.gate(items, 0.0).first().exceeded and not scoring.gate(items, 0.31).first().exceeded


def test_time_range_is_inclusive(spark):
    h = hist(spark, [row(i, str(i), "p", T0 + timedelta(i)) for i in range(5)])
    assert filters.time_range(h, "2025-01-02", "2025-01-04").count() == 3


def test_recall(spark):
    rows = spark.createDataFrame([(f"p{i}", [v] + [0.0] * 6, fix) for i, (v, fix) in enumerate([(0.9, True), (0.8, True), (0.5, False), (0.3, False), (0.1, False)])], "path string, features array<double>, is_bugfix boolean")
    w = [1.0] + [0.0] * 6
    for rate in (calibration.detection_rate,):
        assert rate(rows, w, 40).first()[0] == 1.0 and rate(rows, w, 20).first()[0] == 0.5
    matrix = calibration._Matrix(rows)
    assert matrix.rate(w, 40) == 1.0 and matrix.rate(w, 20) == 0.5


def test_calibrate_prefers_bugfix_files(spark):
    rows = [(f"fixed{i}", 1, 1, 0, T0, 1, 1.0, 10, 0.1, 0) for i in range(5)] + [(f"busy{i}", 30, 500, 200, T0, 3, 0.4, 0, 0.9, 0) for i in range(20)]
    m = spark.createDataFrame(rows, "path string, commit_count long, added_lines long, deleted_lines long, last_modified timestamp, contributor_count long, ownership_ratio double, bugfix_count long, burst_score double, file_size long")
    r = calibration.calibrate(m, Weights(), 30, "2025-01-02")
    assert (r.total_files, r.bugfix_files) == (25, 5) and r.recommended_rate >= r.current_rate


def test_no_patterns_is_an_error(spark):
    from dataclasses import replace

    from faultline.config import Bugfix

    with pytest.raises(ValueError):
        reports.calibrated(hist(spark, [row(0, "s", "p")]), replace(Config(), bugfix=Bugfix(())), "2025-01-02")
    assert reports.calibrated(hist(spark, [row(0, "s", "p")]), Config(), "2025-01-02") is None


def test_empty_history(spark):
    h = hist(spark, [])
    assert reports.hotspots(h, Config(), "2025-01-02").count() == 0 and reports.risky_commits(h, Config()).count() == 0
    pairs, stats = reports.coupled(h, Config())
    assert pairs.count() == 0 and stats.first()[:] == (0, 0, 0)
    assert scoring.ci_summary(reports.hotspots(h, Config(), "2025-01-02")).first()[:] == (0, 0, 0, 0.0)
