"""A tree ensemble as column expressions and as SQL.

``compiled`` reads the splits of a fitted Spark ML model once. Its score is then an
ordinary expression: no vector, no assembler, and it runs inside generated code or in
any engine that knows CASE WHEN.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnspark.operators.columns import numeric_or_zero


@dataclass(frozen=True)
class Leaf:
    prediction: float


@dataclass(frozen=True)
class Split:
    """Rows at or below ``threshold``, or with one of ``values``, go left; a NaN goes right."""

    feature: int
    threshold: float | None
    values: tuple[float, ...]
    left: Split | Leaf
    right: Split | Leaf


def _number(x: float) -> str:
    text = repr(float(x))
    return text if "e" in text else f"{text}e0"


@dataclass(frozen=True)
class Ensemble:
    features: tuple[str, ...]
    trees: tuple[Split | Leaf, ...]
    weights: tuple[float, ...]

    def _column(self, node: Split | Leaf) -> Column:
        if isinstance(node, Leaf):
            return F.lit(node.prediction)
        x = numeric_or_zero(F.col(self.features[node.feature]))
        goes = x <= F.lit(node.threshold) if node.threshold is not None else x.isin(*node.values)
        return F.when(goes, self._column(node.left)).otherwise(self._column(node.right))

    def _sql(self, node: Split | Leaf) -> str:
        if isinstance(node, Leaf):
            return _number(node.prediction)
        x = self.features[node.feature]
        goes = f"{x} <= {_number(node.threshold)}" if node.threshold is not None else f"{x} IN ({', '.join(map(_number, node.values))})"
        return f"CASE WHEN {goes} THEN {self._sql(node.left)} ELSE {self._sql(node.right)} END"

    def probability(self) -> Column:
        """Probability of class 1; missing features and text that is no number are 0."""
        margin = F.lit(0.0)
        for tree, weight in zip(self.trees, self.weights, strict=True):
            margin = margin + self._column(tree) * F.lit(weight)
        return 1 / (1 + F.exp(-2 * margin))

    def sql(self) -> str:
        """The same over columns that are numbers and not missing."""
        parts = [f"{_number(w)} * {self._sql(t)}" for t, w in zip(self.trees, self.weights, strict=True)]
        return f"1e0 / (1e0 + exp(-2e0 * ({' + '.join(parts)})))"

    def _nodes(self, node: Split | Leaf, at: int) -> Iterator[tuple]:
        if isinstance(node, Leaf):
            yield at, None, None, node.prediction
            return
        yield at, self.features[node.feature], node.threshold, None
        yield from self._nodes(node.left, 2 * at)
        yield from self._nodes(node.right, 2 * at + 1)

    def splits(self, spark: SparkSession) -> DataFrame:
        """One row per node: tree, node (children of n are 2n and 2n + 1), feature, threshold, prediction of a leaf."""
        rows = [(i, *node) for i, tree in enumerate(self.trees) for node in self._nodes(tree, 1)]
        return spark.createDataFrame(rows, "tree long, node long, feature string, threshold double, prediction double")


def _node(java) -> Split | Leaf:
    if java.getClass().getSimpleName() == "LeafNode":
        return Leaf(java.prediction())
    split = java.split()
    left, right = _node(java.leftChild()), _node(java.rightChild())
    if split.getClass().getSimpleName() == "ContinuousSplit":
        return Split(split.featureIndex(), split.threshold(), (), left, right)
    return Split(split.featureIndex(), None, tuple(split.leftCategories()), left, right)


def compiled(model: PipelineModel) -> Ensemble:
    """Splits of a pipeline of assembler and gradient-boosted trees; as many as the model has."""
    assembler, trees = model.stages[0], model.stages[-1]
    roots = [_node(t._call_java("rootNode")) for t in trees.trees]
    return Ensemble(tuple(assembler.getInputCols()), tuple(roots), tuple(trees.treeWeights))


def score_compiled(df: DataFrame, ensemble: Ensemble, name: str = "fraud_probability") -> DataFrame:
    return df.withColumn(name, ensemble.probability())
