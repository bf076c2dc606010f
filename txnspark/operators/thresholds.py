"""Choosing score thresholds from a curve. Each function returns one row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnspark.operators.curves import f1, precision, recall


# Fixed value: the block threshold suggested where no score is left to choose from.
NO_CURVE_BLOCK = 0.90


def _described(points: DataFrame, eps: float = 1e-12) -> DataFrame:
    return points.select(
        "threshold",
        precision().alias("precision"),
        recall().alias("recall"),
        f1(eps).alias("f1"),
    )


def _best(points: DataFrame, by: Sequence[Column]) -> DataFrame:
    return points.orderBy(*by, F.col("threshold")).limit(1)


def best_f1(points: DataFrame) -> DataFrame:
    """Highest F1, the lowest threshold on ties."""
    return _best(_described(points), [F.col("f1").desc()])


def target_precision(points: DataFrame, target: float = 0.20, default: float = 0.5) -> DataFrame:
    """Highest recall among points of at least the target precision, else the default."""
    best = F.min(
        F.when(
            F.col("precision") >= target,
            F.struct((-F.col("recall")).alias("r"), F.col("threshold").alias("t")),
        )
    )
    return _described(points).agg(F.coalesce(best["t"], F.lit(default)).alias("threshold"))


def recall_and_precision(
    points: DataFrame, min_recall: float = 0.85, min_precision: float = 0.50
) -> DataFrame:
    """Highest precision among points that meet both floors; no row if none does."""
    meets = (F.col("recall") >= min_recall) & (F.col("precision") >= min_precision)
    return _best(_described(points).where(meets), [F.col("precision").desc()]).drop("f1")


def suggest_policy(
    points: DataFrame, block_precision: float = 0.98, review_precision: float = 0.75
) -> DataFrame:
    """Highest threshold of at least the block precision, else the highest score;
    for review the highest one below it, else ``min(block, 0.5)``. Without any score
    the block threshold is NO_CURVE_BLOCK."""
    return _suggest(points, block_precision, review_precision, F.max)


def suggest_widest(
    points: DataFrame, block_precision: float = 0.98, review_precision: float = 0.75
) -> DataFrame:
    """Same targets, but the lowest threshold that meets each of them."""
    return _suggest(points, block_precision, review_precision, F.min)


def _suggest(points: DataFrame, block_precision: float, review_precision: float, pick) -> DataFrame:
    curve = points.select("threshold", precision().alias("precision"))
    block = curve.agg(
        F.coalesce(
            pick(F.when(F.col("precision") >= block_precision, F.col("threshold"))),
            F.max("threshold"),
            F.lit(NO_CURVE_BLOCK),
        ).alias("block")
    )
    found = block.scalar()
    below = (F.col("precision") >= review_precision) & (F.col("threshold") < found)
    review = pick(F.when(below, F.col("threshold")))
    return curve.agg(review.alias("review")).select(
        found.alias("block"),
        F.coalesce(F.col("review"), F.least(found, F.lit(0.5))).alias("review"),
        F.lit(0.0).alias("allow"),
    )


def f1_grid(start: float, stop: float, count: int) -> list[float]:
    """Evenly spaced thresholds, both ends included."""
    step = (stop - start) / (count - 1)
    return [start + i * step for i in range(count - 1)] + [stop]


def grid_f1(
    df: DataFrame,
    grid: Sequence[float],
    label: str = "is_fraud",
    score: str = "fraud_probability",
    eps: float = 0.0,
) -> DataFrame:
    """Best F1 over a grid of thresholds, the lowest one on ties.

    One scan counts rows between neighbouring grid points; the grid itself is
    then summed from the top.
    """
    p = F.col(score).cast("double")
    y = F.col(label).cast("int")
    rows = df.select(p.alias("_p"), y.alias("_y")).where(
        F.col("_p").isNotNull() & ~F.isnan("_p") & F.col("_y").isNotNull()
    )
    # Step i holds the scores from grid point i-1 (inclusive) to grid point i.
    splits = [float("-inf"), *grid, float("inf")]
    steps = Bucketizer(splits=splits, inputCol="_p", outputCol="_step").transform(rows)
    counts = steps.groupBy(F.col("_step").cast("int").alias("_step")).agg(
        F.sum("_y").alias("pos"), F.count(F.lit(1)).alias("n")
    )
    points = df.sparkSession.createDataFrame(
        [(i, t) for i, t in enumerate([None, *grid])], "_step int, threshold double"
    )
    table = points.join(counts, "_step", "left").fillna(0, subset=["pos", "n"])
    above = Window.orderBy(F.col("_step").desc())
    total = Window.partitionBy()
    scored = table.select(
        "threshold",
        F.sum("pos").over(above).alias("tp"),
        F.sum("n").over(above).alias("flagged"),
        F.sum("pos").over(total).alias("positives"),
    ).where(F.col("threshold").isNotNull())

    def ratio(a: Column, b: Column) -> Column:
        if eps:
            return a / (b + eps)
        return F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))

    prec = ratio(F.col("tp"), F.col("flagged"))
    rec = ratio(F.col("tp"), F.col("positives"))
    described = scored.select("threshold", prec.alias("precision"), rec.alias("recall"))
    p2, r2 = F.col("precision"), F.col("recall")
    return described.withColumn("f1", ratio(2 * p2 * r2, p2 + r2)).orderBy(
        F.col("f1").desc(), "threshold"
    ).limit(1)
