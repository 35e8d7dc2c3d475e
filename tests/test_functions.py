import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faultline import config
from faultline.functions import patterns, scalars


def values(spark, rows, schema, *columns):
    return [r[:] if len(columns) > 1 else r[0] for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_norms(spark):
    rows = [(0.0, 0.0, 10.0), (10.0, 0.0, 10.0), (5.0, 5.0, 5.0), (0.0, 0.0, 0.0), (0.0, 3.0, 3.0), (20.0, 0.0, 10.0)]
    c = F.col
    assert values(spark, rows, "v double, a double, b double", scalars.norm_log(c("v"), c("a"), c("b"))) == pytest.approx([0, 1, 1, 0, 0, 1])
    rows = [(0.0, 0.0, 10.0), (5.0, 0.0, 10.0), (2.5, 0.0, 10.0), (10.0, 0.0, 10.0), (5.0, 5.0, 5.0), (0.0, 0.0, 0.0), (-5.0, -10.0, 0.0)]
    assert values(spark, rows, "v double, a double, b double", scalars.norm_minmax(c("v"), c("a"), c("b"))) == pytest.approx([0, 0.5, 0.25, 1, 1, 0, 0.5])


def test_norm_log_is_monotone_and_bounded(spark):
    got = values(spark, [(float(v),) for v in range(0, 120)], "v double", scalars.norm_log(F.col("v"), 3, 100))
    assert got == sorted(got) and min(got) == 0 and max(got) == 1


def test_recency(spark):
    for days, half, expected in ((0, 30, 1), (30, 30, 0.5), (60, 30, 0.25), (-10, 30, 1), (30, 0, 0.5), (30, -5, 0.5)):
        assert values(spark, [(float(days),)], "d double", scalars.recency_decay(F.col("d"), half)) == pytest.approx([expected])


def test_levels(spark):
    got = values(spark, [(x,) for x in (0.8, 0.7, 0.69, 0.5, 0.4, 0.39, 0.3, 0.0, 1.0)], "s double", scalars.risk_level(F.col("s")))
    assert got == ["high", "high", "medium", "medium", "medium", "low", "low", "low", "high"]
    assert [config.Thresholds().classify(x) for x in (0.8, 0.7, 0.69, 0.5, 0.4, 0.39, 0.3, 0.0, 1.0)] == got


def test_paths(spark):
    rows = [("src/pkg/main.go",), ("main.go",), ("cmd/app.go",), ("a/b/c/d/e.go",), ("src\\pkg\\main.go",), ("",), ("/x",), ("/x/y/z",)]
    expected = [("src/pkg", "src"), ("", ""), ("cmd", "cmd"), ("a/b/c/d", "a"), ("src/pkg", "src"), ("", ""), ("", ""), ("/x/y", "/x/y")]
    assert values(spark, rows, "p string", scalars.directory(F.col("p")), scalars.subsystem(F.col("p"))) == expected


def test_messages(spark):
    rows = [("a" * 100,), ("a" * 110,), ("first line\nsecond",), ("first line\r\nsecond",), ("\nx",), ("",)]
    assert values(spark, rows, "m string", scalars.first_line(F.col("m"))) == ["a" * 100, "a" * 97 + "...", "first line", "first line", "\nx", ""]


def test_line_counts(spark):
    rows = [("",), ("hello",), ("hello\n",), ("hello\nworld\n",), ("hello\nworld",), ("a\nb\nc\nd\n",), ("\n\n\n",)]
    assert values(spark, rows, "t string", scalars.line_count(F.col("t"))) == [0, 1, 1, 2, 2, 4, 3]


def test_bugfix_patterns(spark):
    yes = ["fix: resolve null pointer", "fixed login issue", "fixes #123", "bug in auth module", "hotfix for production crash", "FIX: resolve issue", "Fixed Login Issue", "éfix"]
    no = ["add new feature", "refactor: clean up code", "prefix fixation suffix", ""]
    found = patterns.matches_any(F.col("m"), (r"\bfix(ed|es)?\b", r"\bbug\b", r"\bhotfix\b", "  "))
    assert values(spark, [(m,) for m in yes + no], "m string", found) == [True] * len(yes) + [False] * len(no)
    assert values(spark, [("ÉTÉ",)], "m string", patterns.matches_any(F.col("m"), ("(?i)été",))) == [True]
    assert values(spark, [("fix",)], "m string", patterns.matches_any(F.col("m"), ())) == [False]
    for bad in ("(", "(?=x)", r"(a)\1"):
        with pytest.raises(ValueError):
            patterns.bugfix_regex(bad)


@pytest.mark.parametrize(
    ("glob", "yes", "no"),
    [
        ("**/*.go", ["a.go", "x/y/a.go"], ["a.py"]),
        ("*.go", ["a.go"], ["x/a.go"]),
        ("vendor/**", ["vendor/a", "vendor/a/b", "vendor"], ["x/vendor/a"]),
        ("src/**/test?.{js,ts}", ["src/test1.js", "src/a/b/test2.ts"], ["src/test.js", "src/test10.js"]),
        ("[a-c]x", ["ax", "cx"], ["dx"]),
        ("[^a-c]x", ["dx"], ["ax", "/x"]),
        ("a\\*b", ["a*b"], ["aab"]),
        ("a+(b).c", ["a+(b).c"], ["aab.c"]),
    ],
)
def test_globs(spark, glob, yes, no):
    got = values(spark, [(p,) for p in yes + no], "p string", patterns.glob_filter(F.col("p"), (glob,), ()))
    assert got == [True] * len(yes) + [False] * len(no)


def test_exclusion_wins(spark):
    assert values(spark, [("a/x.go",), ("b\\x.go",), ("c",)], "p string", patterns.glob_filter(F.col("p"), ("**/*.go",), ("b/**",))) == [True, False, False]
    for bad in ("[", "{a", "x\\"):
        with pytest.raises(ValueError):
            patterns.glob_regex(bad)


@settings(max_examples=50, deadline=None)
@given(st.floats(0, 1e6), st.integers(-10, 400))
def test_decay_formula(days, half):
    h = half if half > 0 else 30
    assert 0 <= math.exp(-math.log(2) / h * max(0.0, days)) <= 1


def test_config(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    monkeypatch.setenv("HOME", str(tmp_path / "home"))
    assert config.load() == config.Config() == config.load(str(tmp_path / "absent.json"))
    (tmp_path / "c.json").write_text('{"scoring": {"halfLifeDays": 10, "weights": {"churn": 0.5}}, "bugfix": {"patterns": ["x"]}, "filters": {"exclude": ["v/**"]}}')
    c = config.load(str(tmp_path / "c.json"))
    assert (c.scoring.half_life_days, c.scoring.weights.churn, c.scoring.weights.commit, c.bugfix.patterns, c.filters.exclude) == (10, 0.5, 0.2, ("x",), ("v/**",))
    config.save(c, config.FILE_NAME)
    assert config.load() == c


def test_directory_equals_the_pattern(spark):
    paths = ["", "/", "x", "/x", "//x", "a/", "a//", "a/b", "/a/b/c", "a\\b\\c", "é/ü/x", "a/b\n", "a\n/b", "\n/x", None]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    pattern = F.regexp_extract(F.replace("path", F.lit("\\"), F.lit("/")), r"(?s)^(.+)/[^/]*$", 1)
    assert all(r[0] == r[1] for r in df.select(scalars.directory(F.col("path")), pattern).collect())
    assert "regexp" not in df.select(scalars.directory(F.col("path")))._jdf.queryExecution().optimizedPlan().toString()
