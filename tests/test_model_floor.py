"""The facts about the trained model tell a mediocre model from a good one."""

from pyspark.sql import functions as F

from tests.conftest import SF
from txnspark.catalog import evaluation


def test_a_mediocre_model_does_not_pass(spark, monkeypatch):
    # Scores of frauds are even on [0.4, 1], those of others on [0, 1]: an area of about 0.7.
    draw = F.pmod(F.xxhash64("trans_num"), F.lit(1000)) / 1000
    score = F.when(F.col("is_fraud") == 1, 0.4 + 0.6 * draw).otherwise(draw)
    monkeypatch.setattr(evaluation.model, "train_gbt", lambda *a, **b: None)
    monkeypatch.setattr(evaluation.model, "score", lambda rows, trained: rows.withColumn("fraud_probability", score))
    got = evaluation.ml_train_gbt(spark, SF).first()
    assert got["in_range"] and not got["better_than_chance"]
