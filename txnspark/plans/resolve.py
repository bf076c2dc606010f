"""Which scorer fits an input: decided on schemas, before any job runs.

The order is that of the batch scorer: the pipeline on raw rows, the pipeline on built
features, then the calibrated or else the plain model on exactly its features. A way is
taken if every stage accepts the schema it would be given.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from txnspark.functions.scoring import Policy
from txnspark.operators import columns, reports
from txnspark.operators.model import CalibratedModel, features_of, score
from txnspark.plans.features import build

# Labels that a scorer must not see, and features that any fitted pipeline may ask for.
LABELS = ["is_fraud", "label", "target", "Class"]
BROAD_FEATURES = [
    "amt", "city_pop", "dayofweek", "dayofyear", "dist_category_bucket_idx", "dist_home_merch",
    "dow_cos", "dow_sin", "hour", "hour_cos", "hour_sin", "is_business_hours", "is_night", "is_weekend",
    "max_amt", "mean_amt", "median_amt", "month", "std_amt", "time_since_last_txn",
    "total_amt_last_1h", "total_amt_last_24h", "transaction_count", "txn_count_last_1h", "txn_count_last_24h",
    "mean_distance", "gender_bin",
]


@dataclass(frozen=True)
class Scorers:
    """What is at hand; ``features`` names the model's inputs if the model itself does not."""

    pipeline: PipelineModel | None = None
    calibrated: CalibratedModel | None = None
    base: PipelineModel | None = None
    features: Sequence[str] = ()


def accepts(pipeline: PipelineModel, schema: StructType) -> bool:
    """Whether all stages can work on rows of ``schema``; runs no job."""
    to_java = SparkSession.active().sparkContext._jvm.org.apache.spark.sql.types.DataType.fromJson
    try:
        for stage in pipeline.stages:
            if hasattr(stage, "transform_schema"):
                schema = stage.transform_schema(schema)
            else:
                out = stage._to_java().transformSchema(to_java(schema.json()))
                schema = StructType.fromJson(json.loads(out.json()))
    except (PySparkException, Py4JJavaError, KeyError, ValueError):
        return False
    return "_probability" in schema.fieldNames()


def expected_features(scorers: Scorers) -> list[str]:
    """Inputs of the model that would be used."""
    model = scorers.calibrated.pairs[0][0] if scorers.calibrated else scorers.base
    names = features_of(model) if model is not None else []
    names = names or list(scorers.features)
    if not names:
        raise ValueError("no pipeline fits the input, and no model names its features")
    return names


def _through(df: DataFrame, pipeline: PipelineModel, id_column: str) -> DataFrame:
    # A score that the input brought along gives way.
    out = pipeline.transform(df.drop("fraud_probability"))
    return out.select(id_column, vector_to_array("_probability")[1].alias("fraud_probability"))


def resolve(df: DataFrame, scorers: Scorers, id_column: str = "trans_num") -> tuple[str, DataFrame]:
    """(way taken, id and score of every row)."""
    raw = df.drop(*[c for c in LABELS if c in df.columns])
    if scorers.pipeline is not None:
        if accepts(scorers.pipeline, raw.schema):
            return "pipeline", _through(raw, scorers.pipeline, id_column)
        built = build(raw, BROAD_FEATURES, "batch")
        # An upload may hold numbers as text.
        built = built.withColumns({c: columns.numeric_or_zero(F.col(c)) for c in BROAD_FEATURES if c in built.columns})
        if accepts(scorers.pipeline, built.schema):
            return "pipeline(features)", _through(built, scorers.pipeline, id_column)
    names = expected_features(scorers)
    ready = columns.align(build(raw, names, "batch"), names, keep=[id_column])
    if scorers.calibrated is not None:
        return "calibrated", scorers.calibrated.transform(ready).select(id_column, "fraud_probability")
    return "base", score(ready, scorers.base).select(id_column, "fraud_probability")


def batch_score(
    df: DataFrame, scorers: Scorers, policy: Policy = Policy(), id_column: str = "trans_num"
) -> tuple[str, DataFrame]:
    """(way taken, id, score and tier of every transaction)."""
    way, scored = resolve(df, scorers, id_column)
    return way, reports.with_decision(scored, policy)
