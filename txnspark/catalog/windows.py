"""Per-card history features."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnspark.catalog.registry import B, R, put, query, tidy
from txnspark.catalog.scalars import DISTANCE_SQL
from txnspark.functions.geo import home_merchant_distance
from txnspark.operators import cards
from txnspark.operators.history import (
    DAY,
    HOT_ROWS,
    PrevTime,
    Prior,
    Rolling,
    SHORT_ROWS,
    SinceLast,
    TxnIndex,
    Velocity,
    add_history,
)
from txnspark.plans.features import velocity_features
from txnspark.sources.testdata import table, txn, txn_ties

T = "trans_date_trans_time"


def _history(want, source=txn, digits=6, hot_rows=HOT_ROWS, short_rows=SHORT_ROWS):
    def run(spark, sf):
        out = add_history(source(spark, sf), want, hot_rows=hot_rows, short_rows=short_rows)
        return tidy(out.select("trans_num", *want), digits)

    return run


def pairs_sql(measures, mode, by_category=False, source="txn"):
    """Brute force: every row against every other row of its card."""
    seconds = "(epoch_us({0}.trans_date_trans_time) // 1000000)"
    gap = f"({seconds.format('a')} - {seconds.format('b')})"
    earlier = (
        f"(b.{T} < a.{T} OR (b.{T} = a.{T} AND b.trans_num <= a.trans_num))"
    )
    inside = {
        "closed": lambda w: f"{earlier} AND {gap} <= {w}",
        "half_open": lambda w: f"{earlier} AND epoch_us(a.{T}) - epoch_us(b.{T}) < {w * 1_000_000}",
        "app": lambda w: f"{gap} <= {w}",
    }[mode]
    same = "a.cc_num = b.cc_num" + (" AND a.category = b.category" if by_category else "")
    out = []
    for name, f in measures.items():
        hit = inside(f.seconds)
        if f.what == "count":
            out.append(f"{B(f'count(*) FILTER ({hit})')} AS {name}")
        else:
            out.append(f"{R(f'coalesce(sum(b.amt) FILTER ({hit}), 0)', 4)} AS {name}")
    return f"""SELECT a.trans_num, {', '.join(out)} FROM {source} a JOIN {source} b ON {same}
    GROUP BY a.trans_num"""


for _name, _f in velocity_features("closed").items():
    put(
        "win_" + _name.replace("_last", ""),
        _history({_name: _f}, digits=4),
        pairs_sql({_name: _f}, "closed"),
    )

_category = velocity_features("closed", by_category=True)
put(
    "win_category_velocity",
    _history(_category, digits=4),
    pairs_sql(_category, "closed", by_category=True),
)
# The same windows where many rows share card and time.
_ties = velocity_features("closed")
put("win_velocity_ties", _history(_ties, txn_ties, 4), pairs_sql(_ties, "closed", source="ties"))
# Few cards with many rows each; all of them take the way of the largest ones.
SPREAD_ROWS = 150
_FEW_SQL = "few AS (SELECT * REPLACE (cc_num % 5 AS cc_num) FROM txn)"


def txn_few(spark, sf):
    return txn(spark, sf).withColumn("cc_num", F.col("cc_num") % 5)


put(
    "win_velocity_hot",
    _history(_ties, txn_few, 4, SPREAD_ROWS),
    f"WITH {_FEW_SQL} " + pairs_sql(_ties, "closed", source="few"),
)
_wide = {
    "txn_count_last_30d": Velocity(30 * DAY),
    "total_amt_last_30d": Velocity(30 * DAY, "sum"),
    "txn_count_last_30d_category": Velocity(30 * DAY, by_category=True),
}


@query(
    "win_velocity_wide",
    f"""WITH a AS ({pairs_sql({n: _wide[n] for n in list(_wide)[:2]}, 'closed', source='ties')}),
    b AS ({pairs_sql({n: _wide[n] for n in list(_wide)[2:]}, 'closed', True, 'ties')})
    SELECT * FROM a JOIN b USING (trans_num)""",
)
def win_velocity_wide(spark, sf):
    out = add_history(txn_ties(spark, sf), _wide)
    return tidy(out.select("trans_num", *_wide), 4)


for _mode in ("half_open", "app"):
    _want = velocity_features(_mode)
    put(f"win_velocity_{_mode}", _history(_want, digits=4), pairs_sql(_want, _mode))

_shipped = """SELECT l_orderkey * 10 + l_linenumber AS trans_num, l_suppkey AS cc_num,
  l_shipdate AS trans_date_trans_time, l_extendedprice AS amt, l_returnflag AS category
FROM lineitem"""



def _frame(expr, days):
    return f"""{expr} OVER (PARTITION BY cc_num ORDER BY {T}
      RANGE BETWEEN INTERVAL {days} DAY PRECEDING AND CURRENT ROW)"""


@query(
    "win_velocity_shipments",
    f"""SELECT cc_num, strftime({T}, '%Y-%m-%d') AS day, {B('max(c)')} AS most,
      {B('max(c0)')} AS in_month, {R('max(s)', 2)} AS amount
    FROM (SELECT *, {_frame('count(*)', 1)} AS c, {_frame('count(*)', 30)} AS c0,
      {_frame('sum(amt)', 1)} AS s FROM ({_shipped})) GROUP BY cc_num, {T}""",
)
def win_velocity_shipments(spark, sf):
    """Busiest state per supplier and day; whole groups share card and time."""
    rows = spark.sql(
        _shipped.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf, "lineitem")
    )
    want = {"c": Velocity(DAY), "c0": Velocity(30 * DAY), "s": Velocity(DAY, "sum")}
    out = add_history(rows, want).groupBy("cc_num", F.date_format(T, "yyyy-MM-dd").alias("day"))
    return tidy(
        out.agg(F.max("c").alias("most"), F.max("c0").alias("in_month"), F.max("s").alias("amount")),
        2,
    )


# ------------------------------------------------------------ order and recency

_ROWS = f"OVER (PARTITION BY cc_num ORDER BY {T}, trans_num)"
# The previous row found by joining on the row number, not by lag.
_PREV = f"""WITH n AS (SELECT *, row_number() {_ROWS} AS i FROM ties)
SELECT a.trans_num, {{0}} FROM n a LEFT JOIN n b ON a.cc_num = b.cc_num AND b.i = a.i - 1"""
_GAP = f"coalesce((epoch_us(a.{T}) - epoch_us(b.{T})) / 1e6, 0e0)"
_PREV_TXN = _PREV.replace("FROM ties", "FROM txn")

put(
    "win_time_since_last",
    _history({"time_since_last_txn": SinceLast()}),
    _PREV_TXN.format(f"{R(_GAP)} AS time_since_last_txn"),
)
put(
    "win_time_since_last_ties",
    _history({"gap": SinceLast(), "gap_whole": SinceLast(whole_seconds=True)}, txn_ties),
    _PREV.format(f"{R(_GAP)} AS gap, {R(_GAP)} AS gap_whole"),
)
put(
    "win_time_since_last_min",
    _history({"time_since_last_txn": SinceLast("minutes")}),
    _PREV_TXN.format(f"{R(f'{_GAP} / 60')} AS time_since_last_txn"),
)


@query(
    "win_prev_time",
    _PREV_TXN.format(
        f"strftime(b.{T}, '%Y-%m-%d %H:%M:%S.%f') AS prev_trans_time, "
        f"{R(_GAP)} AS time_since_last_trans"
    ),
)
def win_prev_time(spark, sf):
    want = {"prev_trans_time": PrevTime(), "time_since_last_trans": SinceLast()}
    out = add_history(txn(spark, sf), want).select("trans_num", *want)
    text = F.date_format("prev_trans_time", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return tidy(out.withColumn("prev_trans_time", text))


put(
    "win_txn_index",
    _history({"transaction_count": TxnIndex()}, txn_ties),
    f"""SELECT a.trans_num, {B('count(*)')} AS transaction_count FROM ties a JOIN ties b
    ON a.cc_num = b.cc_num AND (b.{T} < a.{T} OR (b.{T} = a.{T} AND b.trans_num <= a.trans_num))
    GROUP BY a.trans_num""",
)

# ----------------------------------------------------------- card statistics

_STAT_SQL = {
    "mean": "avg(amt)",
    "std": "coalesce(stddev_samp(amt), 0)",
    "median": "quantile_cont(amt, 0.5)",
    "max": "max(amt)",
}


def _over(expr, frame):
    window = f"OVER (PARTITION BY cc_num ORDER BY {T}, trans_num ROWS BETWEEN {frame})"
    if expr.startswith("coalesce("):
        return expr.replace("(amt)", f"(amt) {window}")
    return f"{expr} {window}"


# A mean of cents over 32 rows ends in a 5 at the seventh digit, where engines
# round either way; two more digits avoid that.
STAT_DIGITS = 9


def rolling_sql(stat):
    return R(_over(_STAT_SQL[stat], "49 PRECEDING AND CURRENT ROW"), STAT_DIGITS)


def prior_sql(stat):
    frame = "UNBOUNDED PRECEDING AND 1 PRECEDING"
    return R(f"coalesce({_over(_STAT_SQL[stat], frame)}, 0)", STAT_DIGITS)


def total_sql(stat):
    return R(_STAT_SQL[stat], STAT_DIGITS)


for _stat in _STAT_SQL:
    _n = f"{_stat}_amt"
    put(
        f"win_rolling50_{_stat}",
        _history({_n: Rolling(_stat)}, digits=STAT_DIGITS),
        f"SELECT trans_num, {rolling_sql(_stat)} AS {_n} FROM txn",
    )
    put(
        f"win_expanding_prior_{_stat}",
        _history({_n: Prior(_stat)}, digits=STAT_DIGITS),
        f"SELECT trans_num, {prior_sql(_stat)} AS {_n} FROM txn",
    )


# Cards of any length: ranks narrowed digit by digit, here over the few long cards.
put(
    "win_prior_median_ranks",
    _history({"median_amt": Prior("median")}, txn_few, STAT_DIGITS, short_rows=0),
    f"WITH {_FEW_SQL} SELECT trans_num, {prior_sql('median')} AS median_amt FROM few",
)
put(
    "win_prior_hot",
    _history({f"{s}_amt": Prior(s) for s in _STAT_SQL}, txn_few, STAT_DIGITS, SPREAD_ROWS),
    f"WITH {_FEW_SQL} SELECT trans_num, "
    + ", ".join(f"{prior_sql(s)} AS {s}_amt" for s in _STAT_SQL)
    + " FROM few",
)


@query(
    "win_rolling50_distance",
    f"""WITH d AS (SELECT trans_num, cc_num, {T}, {DISTANCE_SQL} AS km FROM txn)
    SELECT trans_num, {R(_over('avg(km)', '49 PRECEDING AND CURRENT ROW'), 5)} AS mean_distance
    FROM d""",
)
def win_rolling50_distance(spark, sf):
    rows = txn(spark, sf).withColumn("dist_home_merch", home_merchant_distance())
    out = add_history(rows, {"mean_distance": Rolling("mean", distance=True)})
    return tidy(out.select("trans_num", "mean_distance"), 5)


def _total(stat):
    def run(spark, sf):
        rows = txn(spark, sf)
        if stat == "mean_distance":
            rows = rows.withColumn("dist_home_merch", home_merchant_distance())
        # Cards divisible by 50 are unknown and form one card together.
        card = F.when(F.col("cc_num") % 50 != 0, F.col("cc_num"))
        out = cards.add_card_totals(rows.withColumn("cc_num", card), [stat])
        return tidy(out.select("trans_num", stat), 5 if stat == "mean_distance" else STAT_DIGITS)

    return run


_TOTALS = {
    "mean": ("mean_amt", total_sql("mean")),
    "std": ("std_amt", total_sql("std")),
    "median": ("median_amt", total_sql("median")),
    "max": ("max_amt", total_sql("max")),
    "distance": ("mean_distance", R(f"avg({DISTANCE_SQL})", 5)),
    "count": ("transaction_count", R("CAST(count(amt) AS DOUBLE)")),
}
for _key, (_column, _sql) in _TOTALS.items():
    put(
        f"win_card_total_{_key}",
        _total(_column),
        f"""WITH c AS (SELECT *, CASE WHEN cc_num % 50 <> 0 THEN cc_num END AS card FROM txn),
        s AS (SELECT card, {_sql} AS {_column} FROM c GROUP BY card)
        SELECT trans_num, s.{_column} FROM c JOIN s ON c.card IS NOT DISTINCT FROM s.card""",
    )
