"""Columns, encoders, joins, files, models and composed jobs."""

import datetime
import json
import os
import random

import pytest
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from __spark_entry__ import queries
from tests.compare import close
from tests.conftest import SF
from txnspark.functions import geo, time
from txnspark.operators import columns, curves, encode, joins, model
from txnspark.plans import features, jobs
from txnspark.sources import sinks, tables
from txnspark.sources.testdata import txn


def test_sanitize_names():
    names = ["a b", "a__b", "a_b", "_x:", "", "??"]
    assert columns.sanitize_names(names) == ["a_b", "a_b_1", "a_b_2", "x", "col", "col_1"]


def test_distance_bins(spark):
    data = [(1.0,), (1.0001,), (10.0,), (100.0,), (101.0,), (None,)]
    df = spark.createDataFrame(data, "km double")
    out = [r[0] for r in df.select(geo.bucket5(F.col("km"))).collect()]
    assert out == [0, 1, 1, 3, 4, 0]
    labels = [r[0] for r in df.select(geo.category7(F.col("km"))).collect()]
    assert labels == ["<1km", "1-10km", "1-10km", "50-100km", "100-500km", None]


def test_antipodes_have_a_distance(spark):
    km = geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))
    assert close(spark.range(1).select(km).first()[0], 20015.086796, abs_tol=1e-4)


def test_unreadable_values(spark):
    df = spark.createDataFrame([("x", "2024-02-03 04:05:06"), ("3.5", "nope")], "a string, t string")
    rows = df.select(columns.numeric_or_zero(F.col("a")), time.parse_ts(F.col("t"))).collect()
    assert [r[0] for r in rows] == [0.0, 3.5]
    assert rows[0][1] == datetime.datetime(2024, 2, 3, 4, 5, 6) and rows[1][1] is None


def test_clock_does_not_depend_on_the_session_zone(spark):
    moment = datetime.datetime(2024, 3, 10, 2, 30, 0, 250000)
    df = spark.createDataFrame([(moment,)], "t timestamp_ntz")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = df.select(time.epoch_seconds(F.col("t")), time.epoch_micros(F.col("t"))).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert (row[0], row[1]) == (1710037800, 1710037800250000)


def test_times_before_1970(spark):
    df = spark.createDataFrame([(datetime.datetime(1969, 12, 31, 23, 59, 59, 500000),)], "t timestamp_ntz")
    row = df.select(time.epoch_seconds(F.col("t")), time.epoch_micros(F.col("t"))).first()
    assert (row[0], row[1]) == (-1, -500000)


def test_missing_time_has_no_flags(spark):
    df = spark.createDataFrame([(None,)], "t timestamp_ntz")
    parts = time.time_features(F.col("t"))
    row = df.select(*[parts[n] for n in ("is_weekend", "is_night", "is_business_hours")]).first()
    assert tuple(row) == (0, 0, 0)


def test_app_defaults_without_columns(spark):
    df = spark.createDataFrame([("7", 2.0)], "transaction_id string, amount double")
    row = features.build_app(df).first()
    assert row["trans_num"] == "7" and row["amt"] == 2.0 and row["cc_num"] == 0
    assert row["is_business_hours"] == 1.0 and row["dist_home_merch"] == 0.0
    assert row["transaction_count"] == 1.0 and row["txn_count_last_1h"] == 0.0


def test_label_encoding_and_one_hot(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("z",)], "merchant string")
    assert [r[0] for r in encode.label_encode(df, ["merchant"]).collect()] == [1, 2, 0, 3]
    out = encode.one_hot(df, ["merchant"])
    assert out.columns == ["merchant_b", "merchant_z"]
    assert [tuple(r) for r in out.collect()] == [(1, 0), (0, 0), (0, 0), (0, 1)]
    assert [r[0] for r in encode.one_hot_places(df, ["merchant"]).collect()] == [0, None, None, 1]


def test_one_hot_has_no_level_limit(spark):
    df = spark.range(1500).select(F.format_string("m%04d", "id").alias("merchant"))
    assert encode.one_hot_places(df, ["merchant"]).agg(F.max("merchant")).first()[0] == 1498
    assert len(encode.one_hot(df, ["merchant"]).columns) == 1499


@pytest.mark.parametrize("limits", [(1000, 1000), (1000, 1), (2, 1)])
def test_lookup_by_any_route(spark, limits):
    hot_rows, broadcast_rows = limits
    data = [*[(i, "a" if i % 3 else "b") for i in range(9)], (9, None), (10, "q")]
    df = spark.createDataFrame(data, "i long, k string")
    table = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "k string, v double")
    out = joins.lookup(df, table, "k", "v", F.lit(-1.0), hot_rows, broadcast_rows)
    rows = {r["i"]: r["v"] for r in out.collect()}
    assert rows == {**{i: 1.0 if i % 3 else 2.0 for i in range(9)}, 9: -1.0, 10: -1.0}


def test_rows_without_an_id_stay_unscored(spark):
    raw = spark.createDataFrame([(1, "a"), (None, "b"), (None, "b"), (3, "c")], "trans_num long, k string")
    pred = spark.createDataFrame(
        [(1, 0.5, "allow"), (None, 0.9, "block")],
        "trans_num long, fraud_probability double, decision string",
    )
    out = joins.join_predictions(raw, pred)
    assert out.columns == ["trans_num", "k", "fraud_probability", "decision"]
    assert sorted((r["k"], r["decision"]) for r in out.collect()) == [
        ("a", "allow"), ("b", None), ("b", None), ("c", None)
    ]


def test_positional_join_checks_lengths(spark):
    raw = spark.range(3).withColumnRenamed("id", "trans_num")
    pred = spark.createDataFrame([(0.1, "allow")], "fraud_probability double, decision string")
    with pytest.raises(ValueError):
        joins.attach_by_position(raw, pred, ["trans_num"], ["fraud_probability"])


def test_csv_keeps_bad_cells_apart(spark, tmp_path):
    path = str(tmp_path / "in.csv")
    with open(path, "w") as f:
        f.write("Unnamed: 0,amt,trans_num,trans_date_trans_time\n")
        f.write("0,1.5,t1,2020-01-01 00:00:01\n1,x,t2,never\n")
    out = tables.read_transactions(spark, path)
    assert out.columns == ["amt", "trans_num", "trans_date_trans_time"]
    rows = {r["trans_num"]: r for r in out.collect()}
    assert rows["t1"]["amt"] == 1.5
    assert rows["t2"]["amt"] is None and rows["t2"]["trans_date_trans_time"] is None


@pytest.mark.parametrize("fmt", ["csv", "parquet", "json", "orc"])
def test_formats_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame([("t1", 0.25, "allow"), ("t2", 0.95, "block")], tables.PREDICTIONS)
    path = str(tmp_path / fmt)
    sinks.write_predictions(df, path, fmt=fmt)
    assert sorted(tables.read_predictions(spark, path, fmt).collect()) == sorted(df.collect())


def test_trained_model_separates_and_is_calibrated(spark):
    got = queries()["ml_train_gbt"](spark, SF).first()
    assert got["better_than_chance"] and got["in_range"]


def test_calibrated_scores_are_probabilities_and_survive_saving(spark, tmp_path):
    table = txn(spark, SF).withColumnRenamed("fraud_probability", "hint")
    small = model.TreeSettings(trees=2, depth=2)
    fitted = model.calibrate_isotonic(table, ["hint", "amt"], settings=small)
    rows = fitted.transform(table)
    assert rows.columns == [*table.columns, "fraud_probability"]
    path = str(tmp_path / "calibrated")
    fitted.save(path)
    again = model.CalibratedModel.load(path).transform(table)
    assert sorted(rows.collect()) == sorted(again.collect())
    low, high = rows.agg(F.min("fraud_probability"), F.max("fraud_probability")).first()
    assert 0.0 <= low <= high <= 1.0


def test_one_month_reads_one_folder(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, "2024-01-31 23:59:59"), (2, "2024-02-01 00:00:00")], "trans_num long, t string"
    ).select("trans_num", time.parse_ts(F.col("t")).alias("trans_date_trans_time"))
    path = str(tmp_path / "months")
    sinks.write_by_month(df, path)
    assert {"month=2024-01", "month=2024-02"} <= set(os.listdir(path))
    one = spark.read.parquet(path).where(F.col("month") == "2024-02")
    assert [r["trans_num"] for r in one.collect()] == [2]


def test_isotonic_points_keep_the_fit(spark):
    rng = random.Random(11)
    data = [(round(p, 2), int(rng.random() < p)) for p in (rng.random() for _ in range(400))]
    data += [(2.0 + i / 100, 1) for i in range(30)]
    df = spark.createDataFrame(data, "p double, y int")
    few = model.isotonic_points(df, "p", "y")
    assert few.count() < df.select("p").distinct().count()
    all_points = df.groupBy(F.col("p").alias("_p")).agg(
        F.avg("y").alias("_y"), F.count("y").cast("double").alias("_w")
    )
    fits = []
    for points in (all_points, few):
        fit = IsotonicRegression(featuresCol="_p", labelCol="_y", weightCol="_w").fit(points)
        fits.append({r["_p"]: r["prediction"] for r in fit.transform(all_points).collect()})
    assert all(close(fits[0][p], fits[1][p]) for p in fits[0])


def test_scoring_keeps_rows_and_keys(spark, tmp_path):
    rows = txn(spark, SF).select("trans_num", "cc_num", "amt", "is_fraud")
    trained = model.train_gbt(rows, ["amt"], settings=model.TreeSettings(trees=2, depth=2))
    path = str(tmp_path / "model")
    trained.write().overwrite().save(path)
    loaded = model.PipelineModel.load(path)
    a, b = model.score(rows, trained), model.score(rows, loaded)
    assert a.columns == [*rows.columns, "fraud_probability"]
    assert sorted(a.collect()) == sorted(b.collect())
    assert a.count() == rows.count()


def test_monthly_run_writes_every_table(spark, tmp_path):
    rows = txn(spark, SF).drop("fraud_probability")

    def scorer(df):
        return df.withColumn("fraud_probability", (F.col("transaction_count") % 11) / 10)

    paths = jobs.monthly_run(rows, scorer, ["transaction_count"], str(tmp_path))
    scored = spark.read.parquet(paths["predictions"])
    assert scored.count() == rows.count()
    assert paths["metrics"].endswith("2024-01/metrics")
    part = next(f for f in os.listdir(paths["metrics"]) if f.endswith(".json"))
    with open(os.path.join(paths["metrics"], part)) as f:
        record = json.loads(f.readline())
    assert record["rows"] == rows.count() and record["month"] == "2024-01"
    assert set(record["threshold_suggestion"]) == {"block", "review", "allow"}
    assert {"block", "top_merchants"} <= set(os.listdir(paths["analyst_pack"]))


def test_evaluation_without_labels(spark):
    rows = txn(spark, SF)
    pred = rows.select("trans_num", "fraud_probability", F.lit("allow").alias("decision"))
    out = jobs.monthly_eval(rows.drop("is_fraud", "fraud_probability"), pred)
    assert "roc_auc" not in out.columns and out.first()["flags_total"] == 0


def test_curve_end_points(spark):
    points = curves.curve_points(txn(spark, SF))
    end = curves.pr_curve(points).where(F.col("threshold").isNull()).first()
    assert (end["precision"], end["recall"]) == (1.0, 0.0)
