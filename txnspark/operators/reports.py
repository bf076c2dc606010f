"""Queues, summaries and profiling tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnspark.functions.scoring import (
    Policy,
    is_flagged,
    pred_label,
    risk_tier,
    threshold_pred,
)
from txnspark.functions.time import hour, month_tag, parse_ts
from txnspark.operators import ordered
from txnspark.operators.sampling import sort_queue

TIERS = ("block", "review", "allow")


def with_decision(
    df: DataFrame, policy: Policy = Policy(), score: str = "fraud_probability"
) -> DataFrame:
    return df.withColumn("decision", risk_tier(F.col(score), policy))


def of_tier(df: DataFrame, tier: str) -> DataFrame:
    return df.where(F.col("decision") == tier)


def flagged(df: DataFrame) -> DataFrame:
    return df.where(is_flagged(F.col("decision")))


def latest_month(df: DataFrame, time: str = "trans_date_trans_time") -> Column:
    """Month of the latest row of a table, as a value."""
    if time not in df.columns:
        return F.lit("unknown-month")
    return df.agg(month_tag(parse_ts(F.col(time))).alias("month")).scalar()


def queue(df: DataFrame, tier: str, id_column: str = "trans_num") -> DataFrame:
    return sort_queue(of_tier(df, tier), id_column)


def _count_and_mean(df: DataFrame, key: str) -> DataFrame:
    # NaN scores are missing values here, as NULL ones are.
    score = F.nanvl(F.col("fraud_probability"), F.lit(None).cast("double"))
    return (
        flagged(df)
        .where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("count"), F.avg(score).alias("avg_prob"))
    )


def by_category(df: DataFrame, category: str = "category") -> DataFrame:
    """Flagged rows and mean score per category, highest mean first."""
    return _count_and_mean(df, category).orderBy(F.col("avg_prob").desc_nulls_last(), category)


def top_merchants(df: DataFrame, n: int = 50, merchant: str = "merchant") -> DataFrame:
    return (
        _count_and_mean(df, merchant)
        .orderBy(F.col("avg_prob").desc_nulls_last(), merchant)
        .limit(n)
    )


def by_hour(
    df: DataFrame, time: str = "trans_date_trans_time", flagged_only: bool = False
) -> DataFrame:
    """Scored rows and mean score per hour.

    The column is called ``flagged`` but counts all scored rows, unless
    ``flagged_only`` restricts it to what the name says.
    """
    rows = flagged(df) if flagged_only else df
    score = F.nanvl(F.col("fraud_probability"), F.lit(None).cast("double"))
    return (
        rows.select(hour(parse_ts(F.col(time))).alias("hour"), score.alias("_p"))
        .where(F.col("hour").isNotNull())
        .groupBy("hour")
        .agg(F.count("_p").alias("flagged"), F.avg("_p").alias("avg_prob"))
        .orderBy("hour")
    )


def run_summary(predictions: DataFrame) -> DataFrame:
    decision = F.col("decision")
    return predictions.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(is_flagged(decision).cast("int")).alias("flag_rate"),
        F.count_if(decision == "block").alias("block"),
        F.count_if(decision == "review").alias("review"),
    )


def tier_counts(df: DataFrame) -> DataFrame:
    return (
        df.where(F.col("decision").isNotNull())
        .groupBy("decision")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def tier_counts_fixed(
    df: DataFrame, policy: Policy = Policy(), score: str = "fraud_probability"
) -> DataFrame:
    """Rows per tier in fixed order, absent tiers as 0, with the share at or above review."""
    decision, p = risk_tier(F.col(score), policy), F.col(score)
    counts = df.agg(
        *[F.count_if(decision == t).alias(t) for t in TIERS],
        F.avg(threshold_pred(p, policy.review)).alias("pos_rate"),
    )
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("place"), F.lit(t).alias("decision"), F.col(t).alias("count"))
            for i, t in enumerate(TIERS)
        ]
    )
    return counts.select(F.inline(rows), "pos_rate")


def monthly_header(
    df: DataFrame, policy: Policy = Policy(), time: str = "trans_date_trans_time"
) -> DataFrame:
    """Record of flag counts over all rows, tagged with the month of the latest row."""
    has_time = time in df.columns
    ts = parse_ts(F.col(time)) if has_time else F.lit(None).cast("timestamp_ntz")
    # Few decisions are left after the first step; the record is built from those.
    per_tier = df.groupBy("decision").agg(
        F.count(F.lit(1)).alias("n"), F.max(ts).alias("latest")
    )
    return _header_of(per_tier, [], policy)


def monthly_headers(
    df: DataFrame, policy: Policy = Policy(), time: str = "trans_date_trans_time"
) -> DataFrame:
    """The same record for every month in the data."""
    ts = parse_ts(F.col(time))
    per_tier = df.groupBy(F.date_format(ts, "yyyy-MM").alias("_month"), "decision").agg(
        F.count(F.lit(1)).alias("n"), F.max(ts).alias("latest")
    )
    return _header_of(per_tier, ["_month"], policy).drop("_month")


def _header_of(per_tier: DataFrame, by: Sequence[str], policy: Policy) -> DataFrame:
    flags = F.sum(F.when(is_flagged(F.col("decision")), F.col("n")).otherwise(0))
    entry = F.when(
        F.col("decision").isNotNull(), F.struct(F.col("decision"), F.col("n"))
    )
    rows = F.sum("n")
    return per_tier.groupBy(*by).agg(
        F.coalesce(rows, F.lit(0)).alias("rows"),
        F.coalesce(flags, F.lit(0)).alias("flags_total"),
        (flags / rows).alias("flag_rate"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("tier_counts"),
        policy_record(policy).alias("policy"),
        month_tag(F.col("latest")).alias("month"),
    )


def policy_record(policy: Policy) -> Column:
    return F.struct(
        F.lit(policy.block).alias("block"),
        F.lit(policy.review).alias("review"),
        F.lit(policy.allow).alias("allow"),
    )


def kpis(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count(F.lit(1)).alias("rows_scored"),
        F.sum("fraud_prediction").alias("predicted_fraud"),
        F.avg("fraud_probability").alias("mean_probability"),
    )


def class_balance(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    counts = (
        df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    )
    # One row per class: the total comes from that small table.
    share = F.transform(
        F.col("classes"),
        lambda c: F.struct(
            c[label].alias(label), c["count"].alias("count"), (c["count"] / F.col("n")).alias("fraction")
        ),
    )
    return (
        counts.agg(F.collect_list(F.struct(label, "count")).alias("classes"), F.sum("count").alias("n"))
        .select(F.inline(share))
    )


def missing_pct(df: DataFrame, n: int = 15) -> DataFrame:
    """Share of missing values per column in percent, highest first."""

    def missing(name: str) -> Column:
        c = F.col(f"`{name}`")
        nan = F.isnan(c) if dict(df.dtypes)[name] in ("double", "float") else F.lit(False)
        return F.avg((c.isNull() | nan).cast("int")) * 100

    shares = df.agg(*[missing(c).alias(c) for c in df.columns])
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.round(F.col(f"`{c}`"), 2).alias("missing_pct"))
            for c in df.columns
        ]
    )
    return shares.select(F.inline(rows)).orderBy(F.col("missing_pct").desc(), "column").limit(n)


def shape(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).cast("long").alias("columns")
    )


def score_histogram(
    df: DataFrame, bins: int = 40, score: str = "fraud_probability"
) -> DataFrame:
    """Rows per equal-width score bin on [0, 1]; empty bins are absent."""
    p = F.col(score)
    return (
        df.where(p.isNotNull() & ~F.isnan(p))
        .groupBy(F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
        .withColumn("bin_start", F.col("bin") / bins)
    )


def decile_edges(
    df: DataFrame, amount: str = "amt", q: int = 10, limit: int = ordered.HOT_ROWS
) -> list[float]:
    """Quantile edges of the amounts, repeated edges once."""
    edges = ordered.exact_quantiles(df, amount, [i / q for i in range(q + 1)], limit)
    return sorted(set(edges))


def decile_of(amount: Column, edges: Sequence[float]) -> Column:
    """Index of the right-closed bin; the lowest edge belongs to the first bin."""
    if len(edges) < 2:
        return F.lit(None).cast("int")
    out = F.when(amount.isNull() | F.isnan(amount) | (amount < edges[0]), F.lit(None).cast("int"))
    for index, edge in enumerate(edges[1:]):
        out = out.when(amount <= edge, index)
    return out


def decile_mean(
    df: DataFrame,
    amount: str = "amt",
    score: str = "fraud_probability",
    q: int = 10,
    limit: int = ordered.HOT_ROWS,
) -> DataFrame:
    """Mean score per amount decile, with the edges of the bin."""
    edges = decile_edges(df, amount, q, limit)
    bins = df.sparkSession.createDataFrame(
        [(i, low, high) for i, (low, high) in enumerate(zip(edges, edges[1:]))],
        "decile int, low double, high double",
    )
    means = (
        df.groupBy(decile_of(F.col(amount).cast("double"), edges).alias("decile"))
        .agg(F.avg(score).alias("avg_prob"))
    )
    return bins.join(means, "decile", "left").orderBy("decile")


def error_view(
    df: DataFrame,
    threshold: float,
    show: Sequence[str],
    label: str = "is_fraud",
    score: str = "fraud_probability",
    id_column: str = "trans_num",
) -> DataFrame:
    """Columns worth reading next to label, prediction and score."""
    present = [c for c in show if c in df.columns]
    return df.select(
        id_column,
        *present,
        F.col(label).alias("true_label"),
        threshold_pred(F.col(score), threshold).alias("pred_label"),
        F.col(score).alias("pred_prob"),
    )


def false_positives(view: DataFrame, n: int = 10, id_column: str = "trans_num") -> DataFrame:
    """Most confident wrong alarms."""
    wrong = view.where((F.col("true_label") == 0) & (F.col("pred_label") == 1))
    return wrong.orderBy(F.col("pred_prob").desc_nulls_last(), id_column).limit(n)


def false_negatives(view: DataFrame, n: int = 10, id_column: str = "trans_num") -> DataFrame:
    """Misses with the lowest score."""
    missed = view.where((F.col("true_label") == 1) & (F.col("pred_label") == 0))
    score = F.nanvl(F.col("pred_prob"), F.lit(None).cast("double"))
    return missed.orderBy(score.asc_nulls_last(), id_column).limit(n)


def labelled_predictions(df: DataFrame) -> DataFrame:
    return df.withColumn("pred_label", pred_label(F.col("fraud_prediction")))
