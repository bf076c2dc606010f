"""One fitted object from raw transactions to a score, with save and load.

Stages: history features of the ``transformer`` profile, aligned to a fixed list of
columns; categories as sparse indicator vectors or as smoothed means of the label, both
learnt from the training rows; scaling by the deviation; boosted trees. A category of any
number of levels stays one column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, TargetEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from txnspark.operators.columns import numeric_or_zero
from txnspark.operators.model import TreeSettings
from txnspark.plans.features import build
from txnspark.sources.scratch import written

# The columns the fitted pipeline looks at.
FITTED_FEATURES = [
    "amt", "time_since_last_txn", "txn_count_last_1h", "total_amt_last_1h", "txn_count_last_24h",
    "total_amt_last_24h", "transaction_count", "mean_amt", "std_amt", "median_amt", "max_amt",
]


class FeatureBuilder(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Input columns plus ``_f_<name>`` for every wanted feature, as a number; missing ones are 0."""

    profile = Param(Params._dummy(), "profile", "feature rules", TypeConverters.toString)
    features = Param(Params._dummy(), "features", "feature names", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, profile: str = "transformer", features: Sequence[str] = tuple(FITTED_FEATURES)):
        super().__init__()
        self._set(**{k: list(v) if k == "features" else v for k, v in self._input_kwargs.items()})
        self._setDefault(profile="transformer", features=list(FITTED_FEATURES))

    def transform_schema(self, schema: StructType) -> StructType:
        """Raw rows of any columns are accepted; what they lack is 0."""
        made = [StructField(f"_f_{n}", DoubleType()) for n in self.getOrDefault(self.features)]
        return StructType([*schema.fields, *made])

    def _transform(self, df: DataFrame) -> DataFrame:
        built = build(df, None, self.getOrDefault(self.profile))
        wanted = self.getOrDefault(self.features)
        numbers = {n: numeric_or_zero(F.col(n)) if n in built.columns else F.lit(0.0) for n in wanted}
        kept = [F.col(f"`{c}`") for c in df.columns if c in built.columns]
        return built.select(*kept, *[c.alias(f"_f_{n}") for n, c in numbers.items()])


def fit(
    train: DataFrame,
    label: str = "is_fraud",
    features: Sequence[str] = tuple(FITTED_FEATURES),
    profile: str = "transformer",
    settings: TreeSettings = TreeSettings(),
    one_hot: Sequence[str] = (),
    target_mean: Sequence[str] = (),
    smoothing: float = 200.0,
) -> PipelineModel:
    """Fit all stages on raw transactions with a 0/1 label.

    ``one_hot`` and ``target_mean`` name categories. A level that training did not see,
    and a missing one, has an indicator of its own, or the mean of all rows. Features are
    written once, since the trees read their input every round.
    """
    trees = GBTClassifier(
        featuresCol="_scaled", labelCol="_label", predictionCol="_prediction",
        maxIter=settings.trees, maxDepth=settings.depth, stepSize=settings.learning_rate,
        subsamplingRate=settings.subsample, minInstancesPerNode=settings.rows_per_leaf,
        featureSubsetStrategy=settings.columns_per_tree, seed=settings.seed,
    )
    trees.setProbabilityCol("_probability").setRawPredictionCol("_margin")
    builder = FeatureBuilder(profile=profile, features=list(features))
    categories = list(dict.fromkeys([*one_hot, *target_mean]))
    names = _names_of(categories)
    labelled = builder.transform(train.withColumn("_label", F.col(label).cast("double")))
    labelled = names.transform(labelled) if names else labelled
    columns = [f"_f_{n}" for n in features]
    ready = written(labelled.select("_label", *columns, *[f"_c_{c}" for c in categories]), "fitted-features")
    stages: list = []
    if categories:
        index = [f"_i_{c}" for c in categories]
        stages.append(StringIndexer(inputCols=[f"_c_{c}" for c in categories], outputCols=index, handleInvalid="keep"))
    if one_hot:
        made = [f"_h_{c}" for c in one_hot]
        # Unseen levels are the indexer's last index already.
        stages.append(OneHotEncoder(inputCols=[f"_i_{c}" for c in one_hot], outputCols=made, dropLast=False))
        columns += made
    if target_mean:
        made = [f"_t_{c}" for c in target_mean]
        stages.append(TargetEncoder(
            inputCols=[f"_i_{c}" for c in target_mean], outputCols=made, labelCol="_label",
            handleInvalid="keep", targetType="binary", smoothing=smoothing,
        ))
        columns += made
    stages += [
        VectorAssembler(inputCols=columns, outputCol="_vector"),
        StandardScaler(inputCol="_vector", outputCol="_scaled", withMean=False, withStd=True),
        trees,
    ]
    before = [builder, names] if names else [builder]
    return PipelineModel([*before, *Pipeline(stages=stages).fit(ready).stages])


def _names_of(categories: Sequence[str]) -> SQLTransformer | None:
    """A stage that adds every category as a text that is never missing."""
    if not categories:
        return None
    texts = ", ".join(f"coalesce(CAST(`{c}` AS STRING), '(missing)') AS `_c_{c}`" for c in categories)
    return SQLTransformer(statement=f"SELECT *, {texts} FROM __THIS__")


def score(raw: DataFrame, fitted: PipelineModel, name: str = "fraud_probability") -> DataFrame:
    """``raw`` with the probability of class 1."""
    out = fitted.transform(raw)
    kept = [F.col(f"`{c}`") for c in raw.columns if c != name and c in out.columns]
    return out.select(*kept, vector_to_array("_probability")[1].alias(name))


def save(fitted: PipelineModel, path: str) -> None:
    fitted.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
