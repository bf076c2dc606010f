"""Compiled tree ensembles against Spark ML's own scores, and the order in which scorers are tried."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.compare import close
from tests.conftest import SF
from txnspark.operators import model, trees
from txnspark.plans import fitted, resolve
from txnspark.plans.features import build
from txnspark.sources.scratch import written
from txnspark.sources.testdata import txn

NAMES = ["amt", "hour", "transaction_count", "gender_bin"]
SMALL = model.TreeSettings(trees=7, depth=4, learning_rate=0.3)


@pytest.fixture(scope="module")
def table(spark):
    built = build(txn(spark, SF), NAMES, "eval").select("trans_num", "is_fraud", *NAMES)
    return written(built, "tree-table")


@pytest.fixture(scope="module")
def trained(table):
    return model.train_gbt(table, NAMES, settings=SMALL)


def test_compiled_scores_are_the_models(spark, table, trained):
    odd = spark.createDataFrame([(-1, None, None, 5, None), (-2, float("nan"), 3, 5, 1), (-3, float("inf"), 3, 5, 1)], "trans_num long, amt double, hour int, transaction_count int, gender_bin int")
    rows = table.drop("is_fraud").select("trans_num", *[F.col(n).cast(t) for n, t in zip(NAMES, ("double", "int", "int", "int"))]).unionByName(odd)
    ensemble = trees.compiled(trained)
    want = {r[0]: r[1] for r in model.score(rows, trained).select("trans_num", "fraud_probability").collect()}
    got = {r[0]: r[1] for r in trees.score_compiled(rows, ensemble).select("trans_num", "fraud_probability").collect()}
    assert len(got) == rows.count() and all(close(got[i], want[i], 1e-12) for i in want)
    frame = rows.where("trans_num >= 0").toPandas()  # noqa: F841
    for i, p in duckdb.sql(f"SELECT trans_num, {ensemble.sql()} FROM frame").fetchall():
        assert close(p, want[i], 1e-12)


def test_splits_name_every_node(spark, trained):
    ensemble = trees.compiled(trained)
    nodes = {(r["tree"], r["node"]): r for r in ensemble.splits(spark).collect()}
    assert {t for t, _ in nodes} == set(range(7))
    for (tree, node), r in nodes.items():
        children = {(tree, 2 * node), (tree, 2 * node + 1)} & nodes.keys()
        assert len(children) == (2 if r["prediction"] is None else 0)
        assert (r["feature"] is None) == (r["prediction"] is not None)


def way(df, **scorers):
    return resolve.resolve(df, resolve.Scorers(**scorers))


def test_three_ways(spark, table, trained):
    raw = txn(spark, SF).drop("fraud_probability")
    of_raw = fitted.fit(raw, features=["amt", "hour"], settings=model.TreeSettings(trees=2, depth=2))
    calibrated = model.calibrate_isotonic(table, NAMES, settings=model.TreeSettings(trees=2, depth=2))
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("resolving", "schemas alone")
    assert resolve.accepts(of_raw, raw.schema) and not resolve.accepts(trained, raw.schema) and resolve.accepts(trained, table.schema)
    assert not list(jobs.getJobIdsForGroup("resolving"))
    cases = {
        "pipeline": way(raw, pipeline=of_raw, base=trained),
        "pipeline(features)": way(raw, pipeline=trained),
        "calibrated": way(raw, calibrated=calibrated, base=trained),
        "base": way(raw, base=trained),
    }
    for name, (taken, scored) in cases.items():
        assert taken == name
        assert scored.columns == ["trans_num", "fraud_probability"] and scored.count() == raw.count()
        assert scored.where("fraud_probability between 0 and 1").count() == raw.count()
    assert way(table.withColumn("amt", F.lit("text")), pipeline=trained)[0] == "pipeline(features)"
    with pytest.raises(ValueError, match="features"):
        way(raw)
    # A pipeline that fits neither way leaves the model.
    other = model.train_gbt(table.withColumnRenamed("amt", "unheard_of"), ["unheard_of"], settings=model.TreeSettings(trees=1, depth=1))
    assert way(raw, pipeline=other, base=trained)[0] == "base"
