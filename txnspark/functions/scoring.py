"""Expressions on scores, decisions and small categorical fields."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """Lowest score for each tier."""

    block: float = 0.90
    review: float = 0.60
    allow: float = 0.0


def _at_least(score: Column, floor: float) -> Column:
    # NaN compares above every number in Spark; a missing score must not pass.
    return ~F.isnan(score) & (score >= floor)


def threshold_pred(score: Column, threshold: float) -> Column:
    return F.when(_at_least(score, threshold), 1).otherwise(0)


def risk_tier(score: Column, policy: Policy = Policy()) -> Column:
    return (
        F.when(_at_least(score, policy.block), "block")
        .when(_at_least(score, policy.review), "review")
        .otherwise("allow")
    )


def is_flagged(decision: Column) -> Column:
    """Anything but ``allow``; a missing decision is flagged."""
    return ~decision.eqNullSafe(F.lit("allow"))


def flag_positive(decision: Column) -> Column:
    return is_flagged(decision).cast("int")


def pred_label(prediction: Column) -> Column:
    return F.when(prediction == 0, "Legit").when(prediction == 1, "Fraud")


def gender_bin(gender: Column) -> Column:
    return F.when(gender == "M", 1).otherwise(0)


def strip_fraud_prefix(merchant: Column) -> Column:
    return F.regexp_replace(merchant, "^fraud_", "")


def sortable_score(score: Column) -> Column:
    """NaN as NULL, so that ``desc_nulls_last`` puts it last."""
    return F.nanvl(score, F.lit(None).cast("double"))
