"""Categories inside the fitted pipeline: unseen and missing levels, many levels, save and load."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tests.compare import close
from tests.conftest import SF
from txnspark.operators import model
from txnspark.plans import fitted
from txnspark.sources.testdata import txn

TINY = model.TreeSettings(trees=1, depth=2)


def test_unseen_and_missing_levels(spark, tmp_path):
    rows = txn(spark, SF).drop("fraud_probability").withColumn("category", F.when(F.col("trans_num") % 7 != 0, F.col("category")))
    trained = fitted.fit(rows, features=["amt"], settings=TINY, one_hot=["category"], target_mean=["category", "gender"], smoothing=5.0)
    fitted.save(trained, str(tmp_path / "m"))
    new = rows.withColumn("category", F.when(F.col("trans_num") % 3 == 0, "never seen").otherwise(F.col("category")))
    one, two = (m.transform(new) for m in (trained, fitted.load(str(tmp_path / "m"))))
    levels = rows.select("category").distinct().count()
    prior = rows.agg(F.avg("is_fraud")).first()[0]
    seen = {r["category"] or "": (r["n"], r["m"]) for r in rows.groupBy("category").agg(F.count("*").alias("n"), F.avg("is_fraud").alias("m")).collect()}
    for out in (one, two):
        for r in out.select("category", "_t_category", vector_to_array("_h_category").alias("hot")).collect():
            assert len(r["hot"]) == levels + 1 and sum(r["hot"]) == 1.0
            n, mean = seen.get(r["category"] or "", (0, 0.0))
            assert close(r["_t_category"], (n * mean + 5.0 * prior) / (n + 5.0))
            assert (r["hot"][-1] == 1.0) == (r["category"] == "never seen")
    a, b = (sorted(fitted.score(new, m).select("trans_num", "fraud_probability").collect()) for m in (trained, fitted.load(str(tmp_path / "m"))))
    assert a == b


def test_many_levels_stay_one_column(spark):
    rows = spark.range(120_000).select(
        F.col("id").alias("trans_num"), (F.col("id") % 50_000).alias("cc_num"), F.timestamp_seconds("id").alias("trans_date_trans_time"),
        F.lit(1.0).alias("amt"), F.concat(F.lit("m"), F.col("id") % 100_000).alias("merchant"), (F.col("id") % 3 == 0).cast("int").alias("is_fraud"),
    )
    trained = fitted.fit(rows, features=["amt"], settings=model.TreeSettings(trees=1, depth=1), target_mean=["merchant"], smoothing=1.0)
    out = trained.transform(rows)
    assert len(out.columns) < 20
    assert out.where("_t_merchant is null").count() == 0
    assert out.select(F.count_distinct("_i_merchant")).first()[0] == 100_000
