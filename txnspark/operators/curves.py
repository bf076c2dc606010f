"""Precision-recall and ROC curves, and the measures read off them.

Every function takes a table with a 0/1 label and a score. Rows without either
(NULL or NaN) are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnspark.operators import ordered
from txnspark.sources.scratch import written


def curve_points(
    df: DataFrame,
    label: str = "is_fraud",
    score: str = "fraud_probability",
    limit: int = ordered.HOT_ROWS,
) -> DataFrame:
    """One row per distinct score, with counts at and above it.

    Columns: threshold, pos, neg (at the score), tp, fp (at or above it) and the
    class totals positives, negatives. Rows with the same score are counted
    before they move, and the running counts are taken in blocks of the score
    range, so neither a popular score nor the whole table lands in one task.
    """
    p = F.col(score).cast("double")
    y = F.col(label).cast("int")
    rows = df.select(p.alias("threshold"), y.alias("_y")).where(
        F.col("threshold").isNotNull() & ~F.isnan("threshold") & F.col("_y").isNotNull()
    )
    counts = rows.groupBy("threshold").agg(
        F.sum("_y").alias("pos"), (F.count(F.lit(1)) - F.sum("_y")).alias("neg")
    )
    out = ordered.running_by_value(
        counts,
        "threshold",
        ordered.value_bounds(rows, "threshold", limit),
        {"tp": (F.col("pos"), "sum", True), "fp": (F.col("neg"), "sum", True)},
        descending=True,
        totals=True,
    )
    return out.withColumnsRenamed({"total_tp": "positives", "total_fp": "negatives"})


def frozen_points(points: DataFrame) -> DataFrame:
    """Curve written once, for jobs that read several measures off it."""
    return written(points, "curve")


def precision() -> Column:
    return F.col("tp") / (F.col("tp") + F.col("fp"))


def recall() -> Column:
    """1 where there are no positives, as the usual curve definition has it."""
    return F.when(F.col("positives") > 0, F.col("tp") / F.col("positives")).otherwise(1.0)


def f1(eps: float = 1e-12) -> Column:
    return 2 * precision() * recall() / (precision() + recall() + eps)


def pr_curve(points: DataFrame) -> DataFrame:
    """Precision and recall per threshold, and the end point (1, 0) without one."""
    curve = points.select(
        "threshold", precision().alias("precision"), recall().alias("recall")
    )
    end = points.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )
    return curve.unionByName(end)


def roc_curve(points: DataFrame) -> DataFrame:
    """False and true positive rate per threshold, from the point (0, 0) on."""
    curve = points.select(
        "threshold",
        (F.col("fp") / F.nullif(F.col("negatives"), F.lit(0))).alias("fpr"),
        (F.col("tp") / F.nullif(F.col("positives"), F.lit(0))).alias("tpr"),
    )
    start = points.sparkSession.range(1).select(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return curve.unionByName(start)


def roc_corners(points: DataFrame, limit: int = ordered.HOT_ROWS) -> DataFrame:
    """The curve's points without those that its neighbours make needless.

    A point goes if the threshold below it adds the same positives and negatives as it
    does itself: the curve runs straight on there. The first and the last point stay. Each
    point meets the one below it as a running maximum in blocks of the score range.
    """
    own = F.struct("threshold", "pos", "neg")
    below = ordered.running_by_value(
        points, "threshold", ordered.value_bounds(points, "threshold", limit), {"_below": (own, "max", False)}
    )
    first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
    turns = (F.col("_below.pos") != F.col("pos")) | (F.col("_below.neg") != F.col("neg"))
    return below.where(first | F.col("_below").isNull() | turns).drop("_below")


def roc_auc() -> Column:
    """Aggregate over points: area under ROC, ties worth half. NaN for one class."""
    pairs = F.max("positives").cast("double") * F.max("negatives")
    wins = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    return F.when(pairs > 0, wins / pairs).otherwise(float("nan"))


def average_precision() -> Column:
    """Aggregate over points: step-wise area under precision-recall. NaN for one class."""
    both = (F.max("positives") > 0) & (F.max("negatives") > 0)
    steps = F.sum(F.col("pos") / F.nullif(F.col("positives"), F.lit(0)) * precision())
    return F.when(both, steps).otherwise(float("nan"))


def recall_at_k(
    df: DataFrame,
    fraction: float,
    label: str = "is_fraud",
    score: str = "fraud_probability",
    id_column: str = "trans_num",
    points: DataFrame | None = None,
) -> DataFrame:
    """Share of positives in the top ``max(1, int(fraction * n))`` rows.

    The curve answers for whole scores. Rows that share the score at the cut are
    taken by id.
    """
    points = curve_points(df, label, score) if points is None else points
    size = F.greatest(
        F.lit(1),
        F.floor((F.col("positives") + F.col("negatives")) * F.lit(float(fraction))),
    )
    cut = (
        points.where(F.col("tp") + F.col("fp") >= size)
        .orderBy(F.col("threshold").desc())
        .select("*", size.cast("long").alias("k"))
        .first()
    )
    spark = df.sparkSession
    if cut is None or cut["positives"] == 0:
        k = cut["k"] if cut else 0
        return spark.range(1).select(F.lit(k).cast("long").alias("k"), F.lit(0.0).alias("recall"))
    above = cut["tp"] - cut["pos"]
    rest = cut["k"] - above - (cut["fp"] - cut["neg"])
    tied = cut["pos"] + cut["neg"]
    if rest == tied or cut["pos"] == 0:
        found = cut["tp"]
        hits = spark.range(1).select(F.lit(found).cast("long").alias("hits"))
    else:
        same = df.where(F.col(score).cast("double") == cut["threshold"]).select(
            id_column, F.col(label).cast("int").alias("_y")
        )
        ranked = ordered.numbered(same.dropna(), [F.col(id_column)], "_place")
        taken = ranked.where(F.col("_place") <= rest)
        hits = taken.agg((F.coalesce(F.sum("_y"), F.lit(0)) + above).alias("hits"))
    return hits.select(
        F.lit(cut["k"]).cast("long").alias("k"),
        (F.col("hits") / F.lit(cut["positives"])).alias("recall"),
    )
