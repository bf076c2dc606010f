"""Composed jobs: scoring, review queues, evaluation and the monthly run."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnspark.functions.scoring import Policy, threshold_pred
from txnspark.operators import columns, curves, joins, metrics, model, reports, sampling, thresholds
from txnspark.plans.features import build, build_app
from txnspark.sources import sinks
from txnspark.sources.scratch import written

Scorer = PipelineModel | model.CalibratedModel | Callable[[DataFrame], DataFrame]


def apply_scorer(df: DataFrame, scorer: Scorer) -> DataFrame:
    """Add ``fraud_probability`` with a fitted model or any row-wise function."""
    if isinstance(scorer, PipelineModel):
        return model.score(df, scorer)
    if isinstance(scorer, model.CalibratedModel):
        return scorer.transform(df)
    return scorer(df)


@dataclass(frozen=True)
class Targets:
    """Precisions a suggested policy should reach."""

    block: float = 0.98
    review: float = 0.75


# ------------------------------------------------------------------- scoring


def batch_score(
    df: DataFrame,
    scorer: Scorer,
    features: Sequence[str],
    policy: Policy = Policy(),
    id_column: str = "trans_num",
    profile: str = "batch",
) -> DataFrame:
    """Id, score and tier of every transaction."""
    built = build(df, features, profile)
    ready = columns.align(built, features, keep=[id_column])
    scored = apply_scorer(ready, scorer).select(id_column, "fraud_probability")
    return reports.with_decision(scored, policy)


def app_score(
    raw: DataFrame,
    scorer: Scorer,
    features: Sequence[str],
    threshold: float = 0.5,
    id_column: str = "trans_num",
) -> dict[str, DataFrame]:
    """Scored upload and the tables behind its panels.

    The scored rows are written once; each table is a query on them.
    """
    built = build_app(raw)
    keep = [c for c in dict.fromkeys([*raw.columns, id_column, "amt"]) if c in built.columns]
    held = built.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_raw"),
        *[F.col(c) for c in columns.align(built, features).columns if c in built.columns],
    )
    ready = columns.align(held, features, keep=["_raw"])
    scored = apply_scorer(ready, scorer).select("_raw.*", "fraud_probability")
    return app_panels(scored, threshold, id_column)


def app_panels(
    scored: DataFrame, threshold: float = 0.5, id_column: str = "trans_num"
) -> dict[str, DataFrame]:
    pred = threshold_pred(F.col("fraud_probability"), threshold)
    table = written(scored.withColumn("fraud_prediction", pred), "scored")
    out = {
        "scored": table,
        "kpis": reports.kpis(table),
        "top": columns.safe_display(sampling.top_scores(table, 200, id_column)),
        "histogram": reports.score_histogram(table),
        "sample": reports.labelled_predictions(sampling.sample_n(table, 5000, id_column)),
    }
    if "amt" in table.columns:
        out["deciles"] = reports.decile_mean(table)
    return out


# -------------------------------------------------------------------- queues


def flagged_rows(
    raw: DataFrame,
    predictions: DataFrame,
    id_column: str = "trans_num",
    raw_order: Sequence[str] = (),
    prediction_order: Sequence[str] = (),
) -> DataFrame:
    """Flagged rows with all their columns, written once: a small part of the table."""
    joined = joins.scored_rows(raw, predictions, id_column, raw_order, prediction_order)
    return written(reports.flagged(joined), "flagged")


def review_queues(
    raw: DataFrame,
    predictions: DataFrame,
    id_column: str = "trans_num",
    raw_order: Sequence[str] = (),
    prediction_order: Sequence[str] = (),
    time: str = "trans_date_trans_time",
    held: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Block and review queue and the three summaries.

    Only flagged rows are written; the summary by hour, which counts all scored rows,
    reads id (or order), time and score. Predictions without an id are paired by
    position, along the declared orders or in file order (``joins.with_file_position``).
    """
    orders = (raw_order, prediction_order)
    if held is None:
        held = flagged_rows(raw, predictions, id_column, *orders)
    narrow = [c for c in dict.fromkeys([id_column, time, joins.POSITION, *raw_order]) if c in raw.columns]
    by_time = joins.scored_rows(raw.select(*narrow), predictions, id_column, *orders)
    return {
        "block": reports.queue(held, "block", id_column),
        "review": reports.queue(held, "review", id_column),
        "summary_by_category": reports.by_category(held),
        "top_merchants": reports.top_merchants(held),
        "summary_by_hour": reports.by_hour(by_time),
    }


def run_report(predictions: DataFrame) -> DataFrame:
    return reports.run_summary(predictions)


# ---------------------------------------------------------------- evaluation


def _one(df: DataFrame) -> Column:
    """One-row table as a struct value."""
    return df.select(F.struct(*[F.col(c) for c in df.columns])).scalar()


def quality(
    scored: DataFrame, label: str = "is_fraud", targets: Targets = Targets()
) -> DataFrame:
    """One row: curve measures, measures at the policy, suggested policy."""
    points = curves.frozen_points(curves.curve_points(scored, label))
    areas = points.agg(
        curves.roc_auc().alias("roc_auc"), curves.average_precision().alias("pr_auc")
    )
    at_policy = metrics.precision_recall_at_policy(scored, label)
    suggestion = thresholds.suggest_policy(points, targets.block, targets.review)
    return areas.select(
        "roc_auc",
        "pr_auc",
        _one(at_policy).alias("_policy"),
        _one(suggestion).alias("threshold_suggestion"),
    ).select(
        "roc_auc",
        "pr_auc",
        F.col("_policy.precision").alias("precision_at_policy"),
        F.col("_policy.recall").alias("recall_at_policy"),
        F.col("_policy.flag_rate").alias("flag_rate"),
        "threshold_suggestion",
    )


def holdout_eval(
    df: DataFrame,
    scorer: Scorer,
    features: Sequence[str],
    test_start: str,
    policy: Policy = Policy(),
    label: str = "is_fraud",
    id_column: str = "trans_num",
    targets: Targets = Targets(),
) -> DataFrame:
    """Measures on the rows from ``test_start`` on.

    Features are built on all rows, so that history reaches into the test part.
    """
    built = sampling.temporal_holdout(build(df, features, "eval"), test_start)
    test = built.where("is_test").withColumn("_y", F.col(label).cast("int"))
    ready = columns.align(test, features, keep=[id_column, "_y"])
    scored = apply_scorer(ready, scorer).select(id_column, "_y", "fraud_probability")
    table = written(reports.with_decision(scored, policy), "holdout")
    return quality(table, "_y", targets)


def monthly_eval(
    df: DataFrame,
    predictions: DataFrame,
    policy: Policy = Policy(),
    id_column: str = "trans_num",
    label: str = "is_fraud",
    time: str = "trans_date_trans_time",
    targets: Targets = Targets(),
    raw_order: Sequence[str] = (),
    prediction_order: Sequence[str] = (),
) -> DataFrame:
    """Flag counts of all joined rows and, with labels, quality and a suggestion.

    The month is that of the latest transaction, scored or not.
    """
    if id_column in predictions.columns:
        joined = joins.join_for_evaluation(df, predictions, id_column, label, time)
    else:
        names = [c for c in dict.fromkeys([id_column, label, time, joins.POSITION, *raw_order]) if c in df.columns]
        joined = joins.scored_rows(df.select(*names), predictions, id_column, raw_order, prediction_order)
    table = written(joined, "evaluation")
    header = reports.monthly_header(table, policy, time)
    header = header.withColumn("month", reports.latest_month(df, time))
    if label not in table.columns:
        return header
    measured = quality(table, label, targets).drop("flag_rate")
    return header.select("*", _one(measured).alias("_q")).select(
        *header.columns, *[F.col(f"_q.{c}").alias(c) for c in measured.columns]
    )


def monthly_run(
    df: DataFrame,
    scorer: Scorer,
    features: Sequence[str],
    out: str,
    policy: Policy = Policy(),
    id_column: str = "trans_num",
    fmt: str = "parquet",
) -> dict[str, str]:
    """Score, queue and evaluate; every result is a table under ``out``."""
    spark = df.sparkSession
    paths = {n: f"{out}/{n}" for n in ("predictions", "queues", "analyst_pack")}
    scored = batch_score(df, scorer, features, policy, id_column)
    sinks.write_predictions(scored, paths["predictions"], id_column, fmt)
    predictions = spark.read.schema(scored.schema).load(paths["predictions"], format=fmt)
    held = flagged_rows(df, predictions, id_column)
    tables = review_queues(df, predictions, id_column, held=held)
    sinks.write_queues(held, paths["queues"], id_column, fmt)
    sinks.write_analyst_pack(tables, paths["analyst_pack"], fmt)
    record = written(monthly_eval(df, predictions, policy, id_column), "metrics")
    month = record.first()["month"]
    paths["metrics"] = sinks.write_metrics(record, f"{out}/monthly", month)
    if "threshold_suggestion" in record.columns:
        paths["threshold_suggestion"] = sinks.write_threshold_suggestion(record, f"{out}/monthly", month)
    return paths
