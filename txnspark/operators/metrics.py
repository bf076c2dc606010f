"""Measures of decisions and probabilities. All are one map-side combined pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnspark.functions.scoring import flag_positive, threshold_pred


def _share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is empty."""
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def confusion(
    df: DataFrame,
    threshold: float,
    label: str = "is_fraud",
    score: str = "fraud_probability",
) -> DataFrame:
    """tn, fp, fn, tp of ``score >= threshold``."""
    return confusion_of(df, F.col(label), threshold_pred(F.col(score), threshold))


def confusion_of(df: DataFrame, y: Column, pred: Column) -> DataFrame:
    return df.agg(
        F.count_if((y == 0) & (pred == 0)).alias("tn"),
        F.count_if((y == 0) & (pred == 1)).alias("fp"),
        F.count_if((y == 1) & (pred == 0)).alias("fn"),
        F.count_if((y == 1) & (pred == 1)).alias("tp"),
    )


def precision_recall_at_policy(
    df: DataFrame, label: str = "is_fraud", decision: str = "decision"
) -> DataFrame:
    """Precision and recall with every tier but ``allow`` as positive, and the flag rate."""
    return df.agg(*policy_measures(F.col(label), F.col(decision)))


def policy_measures(y: Column, decision: Column) -> list[Column]:
    flagged = flag_positive(decision)
    hits = F.count_if((flagged == 1) & (y == 1))
    return [
        _share(hits, F.sum(flagged)).alias("precision"),
        _share(hits, F.count_if(y == 1)).alias("recall"),
        F.avg(flagged).alias("flag_rate"),
    ]


def flag_rate(df: DataFrame, decision: str = "decision") -> DataFrame:
    return df.agg(F.avg(flag_positive(F.col(decision))).alias("flag_rate"))


def class_report(
    df: DataFrame,
    threshold: float,
    label: str = "is_fraud",
    score: str = "fraud_probability",
) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, macro and weighted means."""
    c = confusion(df, threshold, label, score)
    tn, fp, fn, tp = (F.col(n) for n in ("tn", "fp", "fn", "tp"))

    def row(name: str, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            precision.cast("double").alias("precision"),
            recall.cast("double").alias("recall"),
            f1.cast("double").alias("f1"),
            support.alias("support"),
        )

    def of_class(hits: Column, predicted: Column, actual: Column) -> tuple[Column, ...]:
        return (
            _share(hits, predicted),
            _share(hits, actual),
            _share(2 * hits, predicted + actual),
            actual,
        )

    zero, one = of_class(tn, tn + fn, tn + fp), of_class(tp, tp + fp, tp + fn)
    total = tn + fp + fn + tp
    accuracy = _share(tn + tp, total)
    macro = [(a + b) / 2 for a, b in zip(zero[:3], one[:3], strict=True)]
    weighted = [
        _share(a * zero[3] + b * one[3], total) for a, b in zip(zero[:3], one[:3], strict=True)
    ]
    rows = F.array(
        row("0", *zero),
        row("1", *one),
        row("accuracy", accuracy, accuracy, accuracy, total),
        row("macro avg", *macro, total),
        row("weighted avg", *weighted, total),
    )
    return c.select(F.inline(rows))


def brier(df: DataFrame, label: str = "is_fraud", score: str = "fraud_probability") -> DataFrame:
    gap = F.col(score) - F.col(label)
    return df.agg(F.avg(gap * gap).alias("brier"))


def calibration_curve(
    df: DataFrame,
    label: str = "is_fraud",
    score: str = "fraud_probability",
    bins: int = 10,
) -> DataFrame:
    """Mean score and positive share per score bin; bins are right-closed, empty ones absent."""
    p = F.col(score)
    number = sum(((p > i / bins).cast("int") for i in range(1, bins)), F.lit(0))
    return (
        df.where(p.isNotNull() & ~F.isnan(p))
        .groupBy(number.alias("bin"))
        .agg(
            F.avg(p).alias("mean_predicted"),
            F.avg(F.col(label)).alias("fraction_positive"),
            F.count(F.lit(1)).alias("n"),
        )
    )
