"""Curves, thresholds, metrics and reports on hand-made rows."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.compare import close
from txnspark.functions.scoring import Policy, risk_tier, threshold_pred
from txnspark.operators import curves, metrics, reports, sampling, thresholds

SIX = [(0.9, 1), (0.8, 0), (0.8, 1), (0.4, 0), (0.3, 1), (0.1, 0)]


def scored(spark, rows):
    data = [(i, p, y) for i, (p, y) in enumerate(rows)]
    return spark.createDataFrame(data, "trans_num long, fraud_probability double, is_fraud int")


def areas(df, limit=1000):
    return curves.curve_points(df, limit=limit).agg(
        curves.roc_auc().alias("roc"), curves.average_precision().alias("ap")
    ).first()


@pytest.mark.parametrize("limit", [1000, 2])
def test_areas(spark, limit):
    row = areas(scored(spark, SIX), limit)
    assert close(row["ap"], 0.755556) and close(row["roc"], 0.722222)


def test_areas_leave_out_missing_scores(spark):
    row = areas(scored(spark, [*SIX, (float("nan"), 1), (None, 1), (0.99, None)]))
    assert close(row["ap"], 0.755556) and close(row["roc"], 0.722222)


@pytest.mark.parametrize("label", [0, 1])
def test_one_class(spark, label):
    df = scored(spark, [(0.9, label), (0.1, label)])
    row = areas(df)
    assert math.isnan(row["roc"]) and math.isnan(row["ap"])


def test_policy_measures_without_positives(spark):
    df = reports.with_decision(scored(spark, [(0.9, 0), (0.1, 0)]))
    row = metrics.precision_recall_at_policy(df).first()
    assert (row["precision"], row["recall"], row["flag_rate"]) == (0.0, 0.0, 0.5)


def test_blocks_do_not_change_a_curve(spark):
    rng = random.Random(4)
    rows = [(rng.choice([0.5, rng.random()]), int(rng.random() < 0.3)) for _ in range(400)]
    df = scored(spark, rows)
    columns = ["threshold", "tp", "fp", "positives", "negatives"]
    a = sorted(curves.curve_points(df).select(*columns).collect())
    b = sorted(curves.curve_points(df, limit=20).select(*columns).collect())
    assert a == b


@pytest.mark.parametrize("fraction", [0.0, 0.1, 0.34, 0.5, 1.0])
def test_recall_at_k(spark, fraction):
    rows = [(0.9, 0), (0.5, 1), (0.5, 0), (0.5, 1), (0.5, 1), (0.2, 1), (0.1, 0), (0.1, 0)]
    k = max(1, int(fraction * len(rows)))
    best = sorted(range(len(rows)), key=lambda i: (-rows[i][0], i))[:k]
    row = curves.recall_at_k(scored(spark, rows), fraction).first()
    assert row["k"] == k
    assert close(row["recall"], sum(rows[i][1] for i in best) / 4)


def test_recall_at_k_without_positives(spark):
    assert curves.recall_at_k(scored(spark, [(0.5, 0)]), 0.5).first()["recall"] == 0.0


def test_suggestions(spark):
    points = curves.curve_points(scored(spark, SIX))
    row = thresholds.suggest_policy(points).first()
    assert (row["block"], row["review"]) == (0.9, 0.5)
    row = thresholds.suggest_policy(points, 0.98, 0.5).first()
    assert (row["block"], row["review"]) == (0.9, 0.8)
    row = thresholds.suggest_widest(points, 0.98, 0.5).first()
    # All six rows together still have precision 3/6.
    assert (row["block"], row["review"]) == (0.9, 0.1)
    row = thresholds.suggest_widest(points, 0.98, 0.55).first()
    assert (row["block"], row["review"]) == (0.9, 0.3)
    row = thresholds.suggest_policy(points, 2.0, 2.0).first()
    assert (row["block"], row["review"]) == (0.9, 0.5)


def test_no_threshold_meets_both_floors(spark):
    points = curves.curve_points(scored(spark, SIX))
    assert thresholds.recall_and_precision(points, 0.9, 0.9).count() == 0


def test_grid(spark):
    rng = random.Random(9)
    rows = [(round(rng.random(), 2), int(rng.random() < 0.4)) for _ in range(200)]
    grid = thresholds.f1_grid(0.05, 0.99, 191)
    best = (0.0, None)
    for t in grid:
        tp = sum(p >= t and y for p, y in rows)
        fp = sum(p >= t and not y for p, y in rows)
        fn = sum(p < t and y for p, y in rows)
        prec = tp / (tp + fp) if tp + fp else 0.0
        rec = tp / (tp + fn) if tp + fn else 0.0
        f1 = 2 * prec * rec / (prec + rec) if prec + rec else 0.0
        if f1 > best[0]:
            best = (f1, t)
    row = thresholds.grid_f1(scored(spark, rows), grid).first()
    assert close(row["f1"], best[0]) and row["threshold"] == best[1]


def test_missing_scores_are_allowed(spark):
    df = scored(spark, [(float("nan"), 0), (None, 0), (0.9, 0), (0.6, 0), (0.59, 0)])
    p = F.col("fraud_probability")
    out = df.select("trans_num", risk_tier(p).alias("d"), threshold_pred(p, 0.6).alias("y"))
    rows = {r["trans_num"]: (r["d"], r["y"]) for r in out.collect()}
    assert rows == {0: ("allow", 0), 1: ("allow", 0), 2: ("block", 1), 3: ("review", 1), 4: ("allow", 0)}


def queue_rows(spark):
    return spark.createDataFrame(
        [
            (1, "a", "m1", 0.9, "block", "2024-01-01 05:00:00"),
            (2, "a", "m1", float("nan"), "block", "2024-01-01 05:30:00"),
            (3, None, "m2", 0.7, "review", "bad"),
            (4, "b", "m2", None, None, "2024-01-01 06:00:00"),
            (5, "b", None, 0.1, "allow", "2024-01-01 06:00:00"),
            (6, "a", "m1", 0.95, "block", "2024-01-01 07:00:00"),
        ],
        "trans_num long, category string, merchant string, fraud_probability double, "
        "decision string, trans_date_trans_time string",
    )


def test_queues_put_missing_scores_last(spark):
    assert [r["trans_num"] for r in reports.queue(queue_rows(spark), "block").collect()] == [6, 1, 2]


def test_summaries(spark):
    df = queue_rows(spark)
    rows = {r["category"]: (r["count"], r["avg_prob"]) for r in reports.by_category(df).collect()}
    assert rows.keys() == {"a", "b"}
    assert rows["a"][0] == 3 and close(rows["a"][1], 0.925)
    assert rows["b"] == (1, None)
    hours = {r["hour"]: r["flagged"] for r in reports.by_hour(df).collect()}
    assert hours == {5: 1, 6: 1, 7: 1}
    hours = {r["hour"]: r["flagged"] for r in reports.by_hour(df, flagged_only=True).collect()}
    assert hours == {5: 1, 6: 0, 7: 1}
    row = reports.run_summary(df).first()
    assert (row["rows"], row["block"], row["review"]) == (6, 3, 1) and close(row["flag_rate"], 5 / 6)
    assert {r["decision"]: r["count"] for r in reports.tier_counts(df).collect()} == {
        "block": 3, "review": 1, "allow": 1
    }
    row = reports.monthly_header(df, Policy()).first()
    assert (row["rows"], row["flags_total"], row["month"]) == (6, 5, "2024-01")
    assert row["tier_counts"] == {"block": 3, "review": 1, "allow": 1}
    assert [r["count"] for r in reports.tier_counts_fixed(df).orderBy("place").collect()] == [2, 1, 3]


def test_deciles_with_repeated_edges(spark):
    data = [(1.0, 0.5)] * 8 + [(2.0, 0.25), (3.0, 0.75)]
    df = spark.createDataFrame(data, "amt double, fraud_probability double")
    rows = reports.decile_mean(df).collect()
    frame = df.toPandas()
    bins = pd.qcut(frame.amt, 10, duplicates="drop")
    expect = frame.groupby(bins, observed=False).fraud_probability.mean()
    assert [r["avg_prob"] for r in rows] == [None if math.isnan(x) else x for x in expect.tolist()]


@pytest.mark.parametrize("limit", [1000, 10])
def test_stratified_split(spark, limit):
    rng = random.Random(2)
    rows = [(0.5, int(rng.random() < 0.1)) for _ in range(500)]
    out = sampling.stratified_split(scored(spark, rows), limit=limit).collect()
    for cls in (0, 1):
        own = [r["is_test"] for r in out if r["is_fraud"] == cls]
        assert sum(own) == math.ceil(0.2 * len(own))
    again = sampling.stratified_split(scored(spark, rows)).collect()
    assert {r["trans_num"] for r in out if r["is_test"]} == {
        r["trans_num"] for r in again if r["is_test"]
    }


def test_holdout_keeps_unknown_times_for_training(spark):
    df = spark.createDataFrame([("2020-06-01 00:00:00",), ("2020-05-31 23:59:59",), (None,)], "t string")
    df = df.select(F.col("t").cast("timestamp_ntz").alias("t"))
    out = sampling.temporal_holdout(df, "2020-06-01", "t").collect()
    assert [r["is_test"] for r in out] == [True, False, False]


def test_calibration_bins_close_on_the_right(spark):
    df = scored(spark, [(0.0, 0), (0.1, 1), (0.11, 0), (1.0, 1)])
    rows = {r["bin"]: r["n"] for r in metrics.calibration_curve(df).collect()}
    assert rows == {0: 2, 1: 1, 9: 1}
