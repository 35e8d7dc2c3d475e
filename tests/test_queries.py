import pytest
from pyspark.sql import functions as F

from faultline.plans.queries import ORACLES, QUERIES
from tests.oracle import SF, both


@pytest.mark.parametrize("name", ORACLES)
def test_matches_sql(spark, name):
    got, expected = both(spark, QUERIES[name], ORACLES[name])
    assert got == expected


def test_calibrate_is_at_least_as_good(spark):
    row = QUERIES["calibrate"](spark, SF).first()
    assert row.recommended_rate >= row.current_rate
    assert abs(sum(row[c] for c in row.asDict() if c.startswith("w_")) - 1) < 0.06


def test_calibrate_is_the_descent_by_brute_force(spark, monkeypatch):
    import math

    from faultline.config import Weights
    from faultline.operators import calibration, files
    from faultline.sources import bridge

    made = files.metrics(bridge.history(spark, SF), bridge.PATTERNS)
    rows = [(r.path, list(r.features), r.is_bugfix) for r in calibration.features(made, 30, bridge.UNTIL).collect()]

    def rate(weights):
        ranked = sorted(rows, key=lambda r: (-round(sum(w * f for w, f in zip(weights, r[1])), 9), r[0]))
        best = ranked[: min(len(rows), math.ceil(len(rows) * 20 / 100))]
        return sum(r[2] for r in best) / max(1, sum(r[2] for r in rows))

    weights, step = [1 / 7] * 7, 0.05
    best, sweeps = rate(weights), 0
    while sweeps < 100:
        sweeps, better = sweeps + 1, False
        for i in range(7):
            for j in range(7):
                if i != j and weights[j] >= step:
                    trial = [w + step * (k == i) - step * (k == j) for k, w in enumerate(weights)]
                    if rate(trial) > best + 1e-10:
                        weights, best, better = trial, rate(trial), True
        if not better:
            if step <= 0.01:
                break
            step /= 2
    current = Weights()
    now = rate(current.as_list())
    found = calibration.calibrate(made, current, 30, bridge.UNTIL)
    assert (found.current_rate, found.recommended_rate) == (now, max(best, now))
    expected = [math.floor(w * 100 + 0.5) / 100 for w in weights] if best > now else current.as_list()
    assert found.recommended_weights.as_list() == pytest.approx(expected)
    kept = calibration.features(made, 30, bridge.UNTIL)
    assert all(calibration.detection_rate(kept, w).first()[0] == pytest.approx(rate(w)) for w in (weights, current.as_list()))


@pytest.mark.parametrize("name", ["coupling_top", "coupling_pairs", "coupling_stats"])
def test_partitions_of_commits_grow_with_the_input(spark, monkeypatch, name):
    import os

    from faultline.sources import bridge

    part = os.path.getsize(f"{SF}/lineitem.parquet") // 37
    monkeypatch.setattr(bridge, "PART", part)
    n = -(-os.path.getsize(f"{SF}/lineitem.parquet") // part)
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [sha#" in plan and f", {n}" in plan


@pytest.mark.parametrize("name", ["file_hotspots", "calibration_features"])
def test_no_rows_are_sorted_to_be_aggregated(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "max_by" not in plan


def test_calibrate_counts_commits_only_without_fixed_files(spark, monkeypatch):
    from faultline.operators import files
    from faultline.plans import queries, reports
    from faultline.sources import bridge

    h = bridge.history(spark, SF)
    gone = h.withColumn("message", F.when(h.kind == "deleted", "urgent").otherwise("plain"))
    found = reports.calibrated(gone, queries.CONFIG, bridge.UNTIL)
    assert (found.bugfix_files, found.current_rate) == (0, 0.0) and found.total_files > 0
    assert reports.calibrated(h.withColumn("message", F.lit("plain")), queries.CONFIG, bridge.UNTIL) is None
    monkeypatch.setattr(files, "bugfix_totals", None)
    assert reports.calibrated(h, queries.CONFIG, bridge.UNTIL).bugfix_files > 0


def test_commits_are_scored_once(spark):
    plan = QUERIES["commit_risk_medium"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join Cross" in x and "CASE" in x]


def test_entry_has_every_query(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
