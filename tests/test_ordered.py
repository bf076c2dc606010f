"""Running measures, numbering and quantiles in one task and in blocks."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.compare import close
from txnspark.operators import ordered


def rows(spark, n=300, seed=1):
    rng = random.Random(seed)
    data = [(i, rng.choice([None, 1, 1, 1, 2]), rng.randrange(0, 20) / 2) for i in range(n)]
    return spark.createDataFrame(data, "id long, g int, v double")


@pytest.mark.parametrize("limit", [1000, 10])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_running_against_pandas(spark, limit, by):
    df = rows(spark)
    measures = {
        "s": (F.col("v"), "sum", True),
        "n": (F.lit(1).cast("long"), "sum", False),
        "m": (F.col("v"), "max", False),
    }
    out = ordered.running(df, by, [F.col("v"), F.col("id")], measures, totals=True, limit=limit)
    assert set(out.columns) == {"id", "g", "v", "s", "n", "m", "total_s", "total_n", "total_m"}
    got = out.toPandas().sort_values(["v", "id"]).reset_index(drop=True)
    assert len(got) == 300
    group = got.g.fillna(-1) if by else pd.Series(0, index=got.index)
    v = got.v.groupby(group)
    assert (got.s == v.cumsum()).all()
    assert (got.n == v.cumcount()).all()
    assert (got.m.fillna(-1) == v.cummax().groupby(group).shift(1).fillna(-1)).all()
    assert (got.total_s == v.transform("sum")).all()


@pytest.mark.parametrize("limit", [1000, 10])
def test_numbered(spark, limit):
    out = ordered.numbered(rows(spark), [F.col("id").desc()], "n", limit=limit).collect()
    assert {r["id"]: r["n"] for r in out} == {i: 300 - i for i in range(300)}


def test_small_limit_does_not_cut_a_large_table_into_tiny_blocks(spark, monkeypatch):
    asked, cut = [], ordered.range_blocks
    monkeypatch.setattr(ordered, "range_blocks", lambda df, by, order, n: asked.append(n) or cut(df, by, order, n))
    df = spark.range(20_000).withColumn("g", F.col("id") % 3)
    out = ordered.numbered(df, [F.col("id").desc()], "n", by=["g"], limit=10)
    assert asked == [65]
    assert out.count() == 20_000
    assert out.where("n != (19999 - id) div 3 + 1").count() == 0
    # A limit that no small block follows from, and a table that makes few blocks, stay as they are.
    assert ordered.block_rows(10**9, 1_000_000) == 1_000_000 and ordered.block_rows(300, 10) == 10
    assert ordered.block_rows(10**9, 150) == ordered.TASK_ROWS


@pytest.mark.parametrize("limit", [1000, 5])
def test_quantiles(spark, limit):
    df = rows(spark)
    wanted = [i / 10 for i in range(11)]
    expect = df.toPandas().v.quantile(wanted).tolist()
    got = ordered.exact_quantiles(df, "v", wanted, limit=limit)
    assert all(close(a, b) for a, b in zip(got, expect, strict=True))
    few = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double")
    assert close(ordered.exact_quantiles(few, "v", [0.1], limit=limit)[0], 1.3)


@pytest.mark.parametrize("limit", [1000, 5])
def test_median_per_group(spark, limit):
    df = rows(spark)
    got = ordered.exact_median(df, "v", ["g"], "m", limit).collect()
    frame = df.toPandas()
    expect = frame.v.groupby(frame.g.fillna(-1)).median().to_dict()
    assert {(-1 if r["g"] is None else r["g"]): r["m"] for r in got} == expect


def test_split_hot(spark):
    df = rows(spark)
    usual, hot = ordered.split_hot(df, ["g"], limit=100)
    assert {r["g"] for r in hot.select("g").distinct().collect()} == {1}
    assert usual.count() + hot.count() == 300
    usual, hot = ordered.split_hot(df, ["g"], limit=30, nulls=True)
    assert usual.count() == 0 and hot.count() == 300
    assert ordered.split_hot(df, ["g"], limit=300)[1] is None
