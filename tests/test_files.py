"""File order and encodings of files, and the hull-merged isotonic fit."""

import random

import pytest
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from tests.compare import close
from txnspark.operators import joins, model
from txnspark.plans import jobs
from txnspark.sources import tables


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_positions_follow_files_and_pieces(spark, tmp_path, fmt):
    path = str(tmp_path / "in order")
    rows = spark.range(0, 5000, numPartitions=3).select("id", F.sha2(F.col("id").cast("string"), 512).alias("pad"))
    writer = rows.write.option("maxRecordsPerFile", 700).option("parquet.block.size", 20_000)
    writer.option("header", True).format(fmt).save(path)
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("16k", "1m"):  # files in pieces, and several files in a task
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1k")
            df = spark.read.schema("id long, pad string").format(fmt).options(header=True).load(path)
            out = joins.with_file_position(df)
            assert out.columns == ["id", "pad", joins.POSITION]
            got = sorted((r[joins.POSITION], r["id"]) for r in out.select("id", joins.POSITION).collect())
            assert got == [(i + 1, i) for i in range(5000)]
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_queues_of_predictions_in_file_order(spark, tmp_path):
    raw = spark.range(300, numPartitions=2).select(
        F.col("id").alias("trans_num"), F.timestamp_seconds("id").alias("trans_date_trans_time"),
        F.lit("c").alias("category"), F.lit("m").alias("merchant"), F.lit(1.0).alias("amt"),
    )
    scores = spark.range(300, numPartitions=2).select(
        (F.col("id") / 300).alias("fraud_probability"), F.when(F.col("id") >= 270, "block").otherwise("allow").alias("decision")
    )
    for df, name in ((raw, "raw"), (scores, "scores")):
        df.write.parquet(str(tmp_path / name))
    placed = [joins.with_file_position(spark.read.parquet(str(tmp_path / n))) for n in ("raw", "scores")]
    tables_ = jobs.review_queues(*placed)
    assert sorted(r["trans_num"] for r in tables_["block"].collect()) == list(range(270, 300))
    short = placed[1].where(f"{joins.POSITION} <= 200")
    assert joins.attach_by_position(placed[0], short, [], [], strict=False).count() == 200
    with pytest.raises(ValueError, match="300 transactions but 200"):
        joins.attach_by_position(placed[0], short, [], [])
    with pytest.raises(ValueError, match="file positions"):
        joins.scored_rows(raw, scores)


def test_mixed_encodings(spark, tmp_path):
    folder = tmp_path / "mixed %41 files"
    folder.mkdir()
    for name, text, encoding in (("a.csv", "id,city\n1,Köln\n", "utf-8"), ("b.csv", "id,city\n2,Köln\n3,Orléans\n", "latin-1"), ("c.csv", "id,city\n4,plain\n", "ascii")):
        (folder / name).write_bytes(text.encode(encoding))
    found = {r["file"].rsplit("/", 1)[1]: r["utf8"] for r in tables.encodings(spark, str(folder)).collect()}
    assert found == {"a.csv": True, "b.csv": False, "c.csv": True}
    out = tables.read_table(spark, str(folder), encoding="auto")
    assert sorted(map(tuple, out.collect())) == [(1, "Köln"), (2, "Köln"), (3, "Orléans"), (4, "plain")]
    one = tables.read_table(spark, str(folder / "b.csv"), encoding="auto")
    assert sorted(r["city"] for r in one.collect()) == ["Köln", "Orléans"]
    assert [r["city"] for r in tables.read_table(spark, str(folder / "a.csv"), encoding="auto").collect()] == ["Köln"]


@pytest.mark.parametrize("kind", ["noise", "rising", "falling", "steps", "fractions"])
def test_hulls_merge_to_the_whole_fit(spark, kind):
    rng = random.Random(kind)
    value = {
        "noise": lambda i: float(rng.random() < i / 900), "rising": lambda i: i / 7, "falling": lambda i: -i / 7,
        "steps": lambda i: float(i // 100 % 3), "fractions": lambda i: rng.random() * i,
    }[kind]
    df = spark.createDataFrame([(float(i % 900) / 10, value(i % 900)) for i in range(1300)] + [(None, 1.0), (float("nan"), 1.0), (3.0, None)], "p double, y double")
    held = df.dropna().where(~F.isnan("p"))
    points = held.groupBy(F.col("p").alias("_p")).agg(F.avg("y").alias("_y"), F.count("y").cast("double").alias("_w"))
    whole = IsotonicRegression(featuresCol="_p", labelCol="_y", weightCol="_w").fit(points)
    want = {r["_p"]: r["prediction"] for r in whole.transform(points).collect()}
    for limit in (1_000_000, 20):  # one block, and blocks that merge in two rounds
        part = model.fit_isotonic(df, "p", "y", limit).setPredictionCol("prediction")
        got = {r["_p"]: r["prediction"] for r in part.transform(points).collect()}
        assert all(close(got[p], want[p]) for p in want), kind
        assert model.isotonic_segments(df, "p", "y", limit).count() <= len(want)


def test_corners_keep_the_area_and_its_ends(spark):
    from txnspark.operators import curves

    rng = random.Random(4)
    rows = [(round(rng.random(), 2), int(rng.random() < 0.3)) for _ in range(260)]
    df = spark.createDataFrame(rows, "fraud_probability double, is_fraud int")

    def area(points):
        at = sorted((r["fpr"], r["tpr"]) for r in curves.roc_curve(points).collect())
        return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(at[:-1], at[1:]))

    for limit in (1_000_000, 10):
        points = curves.curve_points(df, limit=limit)
        few = curves.roc_corners(points, limit)
        assert few.count() < points.count()
        assert close(area(few), area(points)) and close(area(few), points.agg(curves.roc_auc()).first()[0])
        per = {r["threshold"]: (r["pos"], r["neg"]) for r in points.collect()}
        order = sorted(per, reverse=True)
        kept = [t for i, t in enumerate(order) if i in (0, len(order) - 1) or per[order[i + 1]] != per[t]]
        assert sorted((r["threshold"] for r in few.collect()), reverse=True) == kept
