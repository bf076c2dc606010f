"""Splits, samples and top-k."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnspark.functions.scoring import sortable_score
from txnspark.operators import ordered
from txnspark.operators.ordered import BLOCK

SEED = 42


def id_hash(id_column: str = "trans_num", seed: int = SEED) -> Column:
    return F.xxhash64(F.col(id_column), F.lit(seed))


def stratified_split(
    df: DataFrame,
    label: str = "is_fraud",
    id_column: str = "trans_num",
    fraction: float = 0.2,
    key: Column | None = None,
    limit: int = ordered.HOT_ROWS,
) -> DataFrame:
    """Adds ``is_test``: the first ceil(fraction * n) rows of each class by key.

    ``key`` is any numeric pseudo-random value of the row, a hash of the id by
    default; ties go by id. Only one cut point per class is computed, so the
    rows themselves are never moved.
    """
    key = id_hash(id_column) if key is None else key
    rows = df.select(F.col(label).alias("_class"), F.col(id_column).alias("_id"), key.alias("_key"))
    rows = rows.where(F.col("_class").isNotNull()).withColumn("_value", F.col("_key").cast("double"))
    bounds = ordered.value_bounds(rows, "_value", limit)
    blocks = ordered.value_blocks(rows, "_value", bounds)
    # Classes times blocks: a small table.
    sizes = blocks.groupBy("_class", BLOCK).count().orderBy("_class", BLOCK).collect()
    cuts = {}
    for cls in {r["_class"] for r in sizes}:
        own = [(r[BLOCK], r["count"]) for r in sizes if r["_class"] == cls]
        left = math.ceil(fraction * sum(n for _, n in own))
        for block, n in own:
            if left <= n:
                cuts[cls] = (block, left)
                break
            left -= n
    # One block per class holds the cut; the row at the cut ends the test part.
    inside = reduce(
        lambda a, b: a | b,
        [(F.col("_class") == c) & (F.col(BLOCK) == b) for c, (b, _) in cuts.items()],
        F.lit(False),
    )
    place = F.row_number().over(Window.partitionBy("_class").orderBy("_key", "_id"))
    at_cut = reduce(
        lambda a, b: a | b,
        [(F.col("_class") == c) & (F.col("_place") == n) for c, (_, n) in cuts.items()],
        F.lit(False),
    )
    last = blocks.where(inside).withColumn("_place", place).where(at_cut).collect()
    is_test = F.lit(False)
    for row in last:
        upto = (key < row["_key"]) | ((key == row["_key"]) & (F.col(id_column) <= row["_id"]))
        is_test = is_test | ((F.col(label) == row["_class"]) & upto)
    return df.withColumn("is_test", F.coalesce(is_test, F.lit(False)))


def temporal_holdout(
    df: DataFrame, start: str, time: str = "trans_date_trans_time"
) -> DataFrame:
    """Adds ``is_test``: time from ``start`` on. Rows without a time are training rows."""
    late = F.col(time).cast("timestamp_ntz") >= F.lit(start).cast("timestamp_ntz")
    return df.withColumn("is_test", F.coalesce(late, F.lit(False)))


def sample_n(
    df: DataFrame, n: int = 5000, id_column: str = "trans_num", key: Column | None = None
) -> DataFrame:
    """``n`` rows picked by a hash of the id; the same rows every time."""
    key = id_hash(id_column) if key is None else key
    return df.orderBy(key, id_column).limit(n)


def top_scores(
    df: DataFrame, n: int = 200, id_column: str = "trans_num", score: str = "fraud_probability"
) -> DataFrame:
    """The ``n`` highest scores; each task keeps only its own best ``n``."""
    return df.orderBy(sortable_score(F.col(score)).desc_nulls_last(), id_column).limit(n)


def sort_queue(
    df: DataFrame, id_column: str = "trans_num", score: str = "fraud_probability"
) -> DataFrame:
    return df.orderBy(sortable_score(F.col(score)).desc_nulls_last(), id_column)


def sort_card_time(
    df: DataFrame,
    card: str = "cc_num",
    time: str = "trans_date_trans_time",
    id_column: str = "trans_num",
) -> DataFrame:
    """Rows by card and time. The id in the key lets a hot card span tasks."""
    return df.orderBy(
        F.col(card).asc_nulls_last(), F.col(time).asc_nulls_last(), F.col(id_column)
    )
