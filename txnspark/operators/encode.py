"""Encoders for categorical columns and scaling of numeric ones.

Fitted encoders are small objects or written tables, so that applying one does
not repeat the fit.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnspark.functions.scoring import strip_fraud_prefix
from txnspark.operators import ordered
from txnspark.operators.joins import lookup
from txnspark.sources.scratch import written

# Columns the training variants encode.
LABEL_COLUMNS = ["merchant", "job", "street", "first", "last", "city"]
ONE_HOT_COLUMNS = ["gender", "category", "state"]
MISSING_TEXT = "nan"


def label_encode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text to 0..n-1 in sorted order; a missing value is the text ``nan``."""
    texts = {c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING_TEXT)) for c in columns}
    # All dictionaries come from the input, not from partly encoded rows.
    levels = {}
    for name, text in texts.items():
        found = ordered.numbered(df.select(text.alias(name)).distinct(), [F.col(name)], "_code")
        levels[name] = written(found.withColumn("_code", F.col("_code") - 1), "levels")
    out = df.withColumns(texts)
    for name, table in levels.items():
        coded = lookup(out, table, name, "_code", F.lit(None).cast("long"))
        out = coded.withColumn(name, F.col("_code")).drop("_code")
    return out


def one_hot(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One 0/1 column per value but the first; missing values are all 0.

    Every level becomes a column of the result, however many there are. For columns
    whose levels grow with the data use ``one_hot_places``.
    """
    add: dict[str, Column] = {}
    for name in columns:
        found = df.select(name).dropna().distinct().orderBy(name).collect()
        for (level,) in found[1:]:
            add[f"{name}_{level}"] = F.coalesce(F.col(name) == level, F.lit(False)).cast("int")
    return df.withColumns(add).drop(*columns)


def one_hot_places(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sparse form of ``one_hot``: per column the place of its 1, NULL if there is none.

    Places count the sorted levels from the second one on, as 0, 1, ...; no level
    reaches the driver or becomes a column.
    """
    out = df
    for name in columns:
        levels = df.select(name).dropna().distinct()
        numbers = ordered.numbered(levels, [F.col(name)], "_place").withColumn("_place", F.col("_place") - 2)
        table = written(numbers, "levels")
        coded = lookup(out, table, name, "_place", F.lit(None).cast("long"))
        out = coded.withColumn(name, F.when(F.col("_place") >= 0, F.col("_place"))).drop("_place")
    return out


def encode_categoricals(df: DataFrame) -> DataFrame:
    """Merchant prefix removed, long text label-encoded, short text one-hot."""
    out = df.withColumn("merchant", strip_fraud_prefix(F.col("merchant")))
    out = label_encode(out, [c for c in LABEL_COLUMNS if c in df.columns])
    return one_hot(out, [c for c in ONE_HOT_COLUMNS if c in df.columns])


@dataclass(frozen=True)
class TargetEncoding:
    """Smoothed label mean per value of ``column``; ``prior`` for unseen values."""

    column: str
    prior: float
    table: DataFrame  # column, te


def target_stats(train: DataFrame, column: str, label: str = "is_fraud") -> DataFrame:
    """Mean and count of the label per category."""
    return (
        train.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.avg(label).alias("mean"), F.count(label).alias("count"))
    )


def smoothed(prior: Column, m: float) -> Column:
    mean, count = F.col("mean"), F.col("count")
    return (mean * count + prior * m) / (count + m)


def fit_target_encoding(
    train: DataFrame, column: str, label: str = "is_fraud", m: float = 100
) -> TargetEncoding:
    prior = train.agg(F.avg(label)).first()[0]
    if prior is None:
        raise ValueError("no labelled training rows")
    table = target_stats(train, column, label).select(
        column, smoothed(F.lit(prior), m).alias("te")
    )
    return TargetEncoding(column, prior, written(table, "target"))


def apply_target_encoding(df: DataFrame, fitted: TargetEncoding) -> DataFrame:
    name = f"te_{fitted.column}"
    table = fitted.table.withColumnRenamed("te", name)
    return lookup(df, table, fitted.column, name, F.lit(fitted.prior))


def fit_scale(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Population standard deviation per column; constant columns get 1."""
    row = df.agg(*[F.stddev_pop(c).alias(c) for c in columns]).first()
    return {c: row[c] or 1.0 for c in columns}


def apply_scale(df: DataFrame, scale: Mapping[str, float]) -> DataFrame:
    """Divide by the fitted deviation; nothing is centred."""
    return df.withColumns({c: F.col(c) / F.lit(s) for c, s in scale.items()})
