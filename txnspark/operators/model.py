"""Training, calibration and scoring with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txnspark.operators import ordered
from txnspark.operators.columns import numeric_or_zero
from txnspark.operators.sampling import SEED, id_hash
from txnspark.sources.scratch import written


@dataclass(frozen=True)
class TreeSettings:
    trees: int = 100
    depth: int = 6
    learning_rate: float = 0.05
    subsample: float = 0.8
    rows_per_leaf: int = 1
    columns_per_tree: str = "all"  # or "sqrt", "0.8", ...
    seed: int = SEED


def class_weights(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    """Balanced weight per class, and neg/pos as the weight of positives."""
    n, pos = F.count(label), F.sum(label)
    return df.agg(
        (n / (2 * (n - pos))).alias("weight_0"),
        (n / (2 * pos)).alias("weight_1"),
        ((n - pos) / pos).alias("scale_pos_weight"),
    )


def _weight(df: DataFrame, label: str, scheme: str | None) -> Column:
    if scheme is None:
        return F.lit(1.0)
    row = class_weights(df, label).first()
    low, high = (
        (row["weight_0"], row["weight_1"])
        if scheme == "balanced"
        else (1.0, row["scale_pos_weight"])
    )
    return F.when(F.col(label) == 1, F.lit(high)).otherwise(F.lit(low))


def feature_matrix(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features as doubles; missing values and text that is no number are 0."""
    return df.withColumns({f: numeric_or_zero(F.col(f)) for f in features})


def train_gbt(
    train: DataFrame,
    features: Sequence[str],
    label: str = "is_fraud",
    weight: str | None = "balanced",
    settings: TreeSettings = TreeSettings(),
) -> PipelineModel:
    """Gradient-boosted trees on a feature table.

    ``weight`` is "balanced", "scale_pos" or None. The table is scanned once per
    boosting round, so pass a written one, not a chain of windows.
    """
    rows = feature_matrix(train, features).select(
        *features,
        F.col(label).cast("double").alias("_label"),
        _weight(train, label, weight).alias("_weight"),
    )
    trees = GBTClassifier(
        featuresCol="_features",
        labelCol="_label",
        weightCol="_weight",
        predictionCol="_prediction",
        maxIter=settings.trees,
        maxDepth=settings.depth,
        stepSize=settings.learning_rate,
        subsamplingRate=settings.subsample,
        minInstancesPerNode=settings.rows_per_leaf,
        featureSubsetStrategy=settings.columns_per_tree,
        seed=settings.seed,
    )
    trees.setProbabilityCol("_probability").setRawPredictionCol("_margin")
    assembler = VectorAssembler(inputCols=list(features), outputCol="_features")
    return Pipeline(stages=[assembler, trees]).fit(rows)


def features_of(model: PipelineModel) -> list[str]:
    return list(model.stages[0].getInputCols())


def _with_probability(df: DataFrame, model: PipelineModel, name: str) -> DataFrame:
    features = features_of(model)
    # Scores are computed on copies, so the input columns stay as they came.
    packed = df.withColumn("_input", F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    ready = packed.select("_input", *[numeric_or_zero(F.col(f)).alias(f) for f in features])
    scored = model.transform(ready)
    return scored.select("_input.*", vector_to_array("_probability")[1].alias(name))


def score(df: DataFrame, model: PipelineModel, name: str = "fraud_probability") -> DataFrame:
    """Rows with the probability of class 1; features must be present."""
    return _with_probability(df, model, name)


def importance(model: PipelineModel, n: int = 20) -> DataFrame:
    gains = model.stages[-1].featureImportances.toArray().tolist()
    table = SparkSession.active().createDataFrame(
        list(zip(features_of(model), gains, strict=True)), "feature string, importance double"
    )
    return table.orderBy(F.col("importance").desc(), "feature").limit(n)


@dataclass(frozen=True)
class CalibratedModel:
    """Mean of several (classifier, isotonic map) pairs."""

    pairs: list[tuple[PipelineModel, IsotonicRegressionModel]]

    def transform(self, df: DataFrame, name: str = "fraud_probability") -> DataFrame:
        out = df
        for i, (trees, isotonic) in enumerate(self.pairs):
            out = _with_probability(out, trees, f"_raw_{i}")
            out = (
                isotonic.copy()
                .setFeaturesCol(f"_raw_{i}")
                .setPredictionCol(f"_p_{i}")
                .transform(out)
            )
        parts = [F.col(f"_p_{i}") for i in range(len(self.pairs))]
        mean = sum(parts[1:], parts[0]) / len(parts)
        helpers = [f"_{kind}_{i}" for kind in ("raw", "p") for i in range(len(parts))]
        return out.withColumn(name, mean).drop(*helpers)

    def save(self, path: str) -> None:
        for i, (trees, isotonic) in enumerate(self.pairs):
            trees.write().overwrite().save(f"{path}/fold_{i}/trees")
            isotonic.write().overwrite().save(f"{path}/fold_{i}/isotonic")

    @staticmethod
    def load(path: str, folds: int = 3) -> CalibratedModel:
        return CalibratedModel(
            [
                (
                    PipelineModel.load(f"{path}/fold_{i}/trees"),
                    IsotonicRegressionModel.load(f"{path}/fold_{i}/isotonic"),
                )
                for i in range(folds)
            ]
        )


#: Blocks whose hulls one task merges.
MERGED_BLOCKS = 64
_HULL = "_block long, _low double, _p double, _w double, _s double"


def _lower_hull():
    """A function of a block's points; a closure, so that executors need no copy of this package.

    Points stay if they are on the lower convex hull of (weight so far, label sum so far).
    ``_low`` is the least score since the point before; a point that stays takes over that
    of the points left out before it.
    """

    def hull(points):
        points = points.sort_values("_w", kind="stable")
        w, s, low = (points[c].to_numpy() for c in ("_w", "_s", "_low"))
        kept: list[int] = []
        for i in range(len(points)):
            while len(kept) > 1:
                a, b = kept[-2], kept[-1]
                # Leave out b unless the mean label rises behind it.
                if (s[b] - s[a]) * (w[i] - w[b]) < (s[i] - s[b]) * (w[b] - w[a]):
                    break
                kept.pop()
            kept.append(i)
        out = points.iloc[kept].copy()
        out["_low"] = low[[0, *(i + 1 for i in kept[:-1])]]
        return out[["_block", "_low", "_p", "_w", "_s"]]

    return hull


def isotonic_segments(df: DataFrame, score: str, label: str, limit: int = ordered.HOT_ROWS) -> DataFrame:
    """The isotonic fit: scores from ``_low`` to ``_high`` have the value ``_fit``, of weight ``_w``.

    The fit is the slope of the lower convex hull of the running label sum over the
    running weight. Every block of scores keeps the hull of its own points, and hulls of
    neighbouring blocks merge in a tree; what is left is the fit's own size. The first
    segment starts at the origin, which every block's hull may need to be seen from.
    """
    rows = df.select(F.col(score).cast("double").alias("_p"), F.col(label).cast("double").alias("_y"))
    rows = rows.where(ordered.is_number(F.col("_p")) & ordered.is_number(F.col("_y")))
    points = rows.groupBy("_p").agg(F.sum("_y").alias("_y"), F.count(F.lit(1)).cast("double").alias("_n"))
    bounds = ordered.value_bounds(rows, "_p", limit)
    totals = {"_w": (F.col("_n"), "sum", True), "_s": (F.col("_y"), "sum", True)}
    placed = ordered.value_blocks(ordered.running_by_value(points, "_p", bounds, totals), "_p", bounds)
    block = placed.select(F.col(ordered.BLOCK).cast("long").alias("_block"), F.col("_p").alias("_low"), "_p", "_w", "_s")
    # The origin comes before all points, in the first block.
    origin = df.sparkSession.createDataFrame([(0, float("-inf"), float("-inf"), 0.0, 0.0)], _HULL)
    block, blocks = block.unionByName(origin), len(bounds) + 1
    while True:
        hull = block.groupBy("_block").applyInPandas(_lower_hull(), _HULL)
        hull = written(hull, "hulls")
        if blocks == 1:
            break
        blocks = -(-blocks // MERGED_BLOCKS)
        block = hull.withColumn("_block", F.expr(f"_block div {MERGED_BLOCKS}"))
    before = Window.partitionBy("_block").orderBy("_w")
    w, s = F.col("_w") - F.lag("_w").over(before), F.col("_s") - F.lag("_s").over(before)
    out = hull.select("_low", F.col("_p").alias("_high"), (s / w).alias("_fit"), w.alias("_w"))
    return out.where("_w is not null")


def isotonic_points(df: DataFrame, score: str, label: str, limit: int = ordered.HOT_ROWS) -> DataFrame:
    """The fit as few weighted points (_p, _y, _w): the ends of its segments."""
    segments = isotonic_segments(df, score, label, limit)
    one = F.array(F.struct(F.col("_low").alias("_p"), "_w"))
    two = F.array(*[F.struct(F.col(c).alias("_p"), (F.col("_w") / 2).alias("_w")) for c in ("_low", "_high")])
    ends = F.when(F.col("_low") == F.col("_high"), one).otherwise(two)
    return segments.select(F.col("_fit").alias("_y"), F.inline(ends))


def fit_isotonic(
    df: DataFrame, score: str, label: str, limit: int = ordered.HOT_ROWS
) -> IsotonicRegressionModel:
    """Isotonic map from ``score`` (as column ``_p``) to the label's mean.

    Spark's estimator sees the fit's own points, which it keeps as they are.
    """
    fit = IsotonicRegression(featuresCol="_p", labelCol="_y", weightCol="_w", predictionCol="_fit")
    return fit.fit(isotonic_points(df, score, label, limit))


def calibrate_isotonic(
    train: DataFrame,
    features: Sequence[str],
    label: str = "is_fraud",
    id_column: str = "trans_num",
    folds: int = 3,
    weight: str | None = "balanced",
    settings: TreeSettings = TreeSettings(),
) -> CalibratedModel:
    """Per fold: trees on the other folds, isotonic map on the fold itself."""
    fold = F.pmod(id_hash(id_column, settings.seed), F.lit(folds))
    rows = train.withColumn("_fold", fold)
    pairs = []
    for i in range(folds):
        trees = train_gbt(rows.where(F.col("_fold") != i), features, label, weight, settings)
        held = _with_probability(rows.where(F.col("_fold") == i), trees, "_p")
        isotonic = fit_isotonic(held, "_p", label)
        pairs.append((trees, isotonic))
    return CalibratedModel(pairs)
