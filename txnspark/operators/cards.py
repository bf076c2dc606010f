"""Whole-card statistics, as a table per card or attached to every row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnspark.operators import ordered
from txnspark.operators.history import ALONE, Columns, alone
from txnspark.operators.ordered import HOT_ROWS

STATS = (
    "mean_amt",
    "std_amt",
    "median_amt",
    "max_amt",
    "mean_distance",
    "transaction_count",
)


def _stat_columns(k: Columns, stats: Sequence[str]):
    columns = {
        "mean_amt": F.avg(k.amount),
        "std_amt": F.stddev_samp(k.amount),
        "median_amt": F.percentile(k.amount, F.lit(0.5)),
        "max_amt": F.max(k.amount),
        "mean_distance": F.avg(k.distance),
        "transaction_count": F.count(k.amount),
    }
    return {name: columns[name] for name in stats}


def card_stats(
    df: DataFrame,
    stats: Sequence[str] = STATS,
    k: Columns = Columns(),
    keep_null_card: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row per card. NULL cards are left out unless asked for.

    Everything but the median combines on the map side. The median of a card past
    ``hot_rows`` is taken from value positions instead of one task's buffer.
    """
    rows = df if keep_null_card else df.where(F.col(k.card).isNotNull())
    rows = rows.select(k.card, *_inputs(k, stats))
    if "median_amt" not in stats:
        return rows.groupBy(k.card).agg(
            *[c.alias(n) for n, c in _stat_columns(k, stats).items()]
        )
    usual, hot = ordered.split_hot(rows, [k.card], hot_rows, nulls=keep_null_card)
    out = usual.groupBy(k.card).agg(*[c.alias(n) for n, c in _stat_columns(k, stats).items()])
    if hot is None:
        return out
    return out.unionByName(_hot_stats(hot, stats, k, hot_rows).select(out.columns))


def _inputs(k: Columns, stats: Sequence[str]) -> list[str]:
    used = {k.distance if s == "mean_distance" else k.amount for s in stats}
    return sorted(used)


def _hot_stats(hot: DataFrame, stats: Sequence[str], k: Columns, limit: int) -> DataFrame:
    simple = [s for s in stats if s != "median_amt"]
    out = hot.groupBy(k.card).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[c.alias(n) for n, c in _stat_columns(k, simple).items()],
    )
    if "median_amt" in stats:
        medians = ordered.exact_median(hot, k.amount, [k.card], "median_amt", limit)
        medians = medians.withColumnRenamed(k.card, "_card")
        out = out.join(
            ordered.broadcast_small(medians), F.col(k.card).eqNullSafe(F.col("_card")), "left"
        ).drop("_card")
    return out.drop("_rows")


def join_card_stats(
    df: DataFrame,
    stats: Sequence[str] = STATS,
    k: Columns = Columns(),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Rows with the statistics of their card; unknown cards get NULL."""
    return _attach(df, stats, k, False, hot_rows)


def add_card_totals(
    df: DataFrame,
    stats: Sequence[str] = STATS,
    k: Columns = Columns(),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Like ``join_card_stats``, but NULL cards form a card and gaps become 0."""
    out = _attach(df, stats, k, True, hot_rows)
    return out.withColumns({s: F.coalesce(F.col(s), F.lit(0).cast("double")) for s in stats})


def _attach(
    df: DataFrame, stats: Sequence[str], k: Columns, null_card: bool, hot_rows: int
) -> DataFrame:
    """One exchange for ordinary cards; a broadcast of few rows for hot ones."""
    usual, hot = ordered.split_hot(df, [k.card], hot_rows, nulls=null_card)
    columns = _stat_columns(k, stats)
    if null_card:
        group = Window.partitionBy(k.card)
        out = usual.withColumns({n: c.over(group) for n, c in columns.items()})
    else:
        # Without a card each row stands alone, so NULL cards never pile up.
        group = Window.partitionBy(k.card, ALONE)
        known = F.col(k.card).isNotNull()
        shared = ALONE in usual.columns
        out = usual if shared else usual.withColumn(ALONE, alone(k))
        out = out.withColumns({n: F.when(known, c.over(group)) for n, c in columns.items()})
        out = out if shared else out.drop(ALONE)
    if hot is None:
        return out
    table = _hot_stats(hot.select(k.card, *_inputs(k, stats)), stats, k, hot_rows)
    table = ordered.broadcast_small(table.withColumnRenamed(k.card, "_card"))
    spread = hot.join(table, F.col(k.card).eqNullSafe(F.col("_card")), "left").drop("_card")
    return out.unionByName(spread.select(out.columns))
