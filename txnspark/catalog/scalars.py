"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from txnspark.catalog.registry import B, R, predictions, put, query, tidy
from txnspark.functions import geo, scoring, time
from txnspark.operators import reports
from txnspark.plans import features
from txnspark.sources.testdata import txn, txn_ties

T = "trans_date_trans_time"
_FORMAT = "'%Y-%m-%d %H:%M:%S.%f'"


def _stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def _columns(exprs, source=txn, digits=6):
    """Query that computes the expressions per transaction.

    ``exprs`` is a function: columns need a session, which import time has not.
    """

    def run(spark, sf):
        rows = source(spark, sf).select("trans_num", *[c.alias(n) for n, c in exprs().items()])
        return tidy(rows, digits)

    return run


@query(
    "fn_parse_ts",
    f"""SELECT trans_num, CASE WHEN trans_num % 13 <> 0 THEN strftime({T}, {_FORMAT}) END AS parsed
    FROM txn""",
)
def fn_parse_ts(spark, sf):
    bad = F.col("trans_num") % 13 == 0
    text = F.when(bad, "not a time").otherwise(F.col(T).cast("string"))
    rows = txn(spark, sf).select("trans_num", text.alias("text"))
    return rows.select("trans_num", _stamp(time.parse_ts(F.col("text"))).alias("parsed"))


@query(
    "fn_parse_ts_epoch",
    f"""SELECT trans_num, strftime(date_trunc('second', {T}), {_FORMAT}) AS from_number,
      strftime({T}, {_FORMAT}) AS from_text FROM txn""",
)
def fn_parse_ts_epoch(spark, sf):
    rows = txn(spark, sf).select(
        "trans_num", time.epoch_seconds(F.col(T)).alias("epoch"), F.col(T).cast("string").alias("text")
    )
    return rows.select(
        "trans_num",
        _stamp(time.parse_ts_or_epoch(F.col("epoch"), LongType())).alias("from_number"),
        _stamp(time.parse_ts_or_epoch(F.col("text"), rows.schema["text"].dataType)).alias("from_text"),
    )


_HOUR = f"hour({T})"
_DOW = f"(isodow({T}) - 1)"
_PARTS_SQL = {
    "hour": B(_HOUR),
    "dayofweek": B(_DOW),
    "month": B(f"month({T})"),
    "dayofyear": B(f"dayofyear({T})"),
}


def _select(columns, source="txn"):
    return f"SELECT trans_num, {', '.join(f'{c} AS {n}' for n, c in columns.items())} FROM {source}"


def _flag(condition):
    return B(f"CASE WHEN {condition} THEN 1 ELSE 0 END")


def ts():
    return F.col(T)


def _parts(names):
    every = time.time_features(ts())
    return {n: every[n] for n in names}


put("fn_time_parts", _columns(lambda: _parts(_PARTS_SQL)), _select(_PARTS_SQL))
put(
    "fn_unix_time",
    _columns(
        lambda: {"unix_time": time.epoch_seconds(ts()), "unix_micros": time.epoch_micros(ts())}
    ),
    _select({"unix_time": B(f"epoch_us({T}) // 1000000"), "unix_micros": B(f"epoch_us({T})")}),
)


@query(
    "fn_time_defaults",
    """SELECT trans_num, 0e0 AS hour, 0e0 AS dayofweek, 1e0 AS month, 0e0 AS is_weekend,
      0e0 AS is_night, 1e0 AS is_business_hours, 0e0 AS hour_sin, 1e0 AS hour_cos, 0e0 AS dow_sin,
      1e0 AS dow_cos, 1e0 AS dayofyear, 0e0 AS unix_time, 0e0 AS time_since_last_txn,
      0e0 AS txn_count_last_24h FROM txn""",
)
def fn_time_defaults(spark, sf):
    out = features.build_app(txn(spark, sf).drop(T))
    names = [*time.TIME_DEFAULTS, "time_since_last_txn", "txn_count_last_24h"]
    return tidy(out.select("trans_num", *names))


@query(
    "fn_month_tag",
    f"""SELECT (SELECT strftime(max({T}), '%Y-%m') FROM txn) AS month,
      (SELECT strftime(max({T}), '%Y-%m') FROM ties) AS month_ties""",
)
def fn_month_tag(spark, sf):
    other = txn_ties(spark, sf).agg(time.month_tag(ts()).alias("m"))
    return txn(spark, sf).agg(time.month_tag(ts()).alias("month")).select(
        "month", other.scalar().alias("month_ties")
    )


put(
    "fn_is_weekend",
    _columns(lambda: {"is_weekend": time.is_weekend(ts())}),
    _select({"is_weekend": _flag(f"dayofweek({T}) IN (0, 6)")}),
)
put(
    "fn_is_night",
    _columns(lambda: {"is_night": time.is_night(ts()), "is_night_late": time.is_night(ts(), 22)}),
    _select(
        {
            "is_night": _flag(f"{_HOUR} <= 5"),
            "is_night_late": _flag(f"{_HOUR} >= 22 OR {_HOUR} <= 5"),
        }
    ),
)
put(
    "fn_is_business_hours",
    _columns(
        lambda: {
            "is_business_hours": time.is_business_hours(ts()),
            "is_business_hours_open": time.is_business_hours(ts(), end_inclusive=False),
        }
    ),
    _select(
        {
            "is_business_hours": _flag(f"{_HOUR} >= 9 AND {_HOUR} <= 17"),
            "is_business_hours_open": _flag(f"{_HOUR} >= 9 AND {_HOUR} < 17"),
        }
    ),
)
CYCLIC_SQL = {
    "hour_sin": R(f"sin(2 * pi() * {_HOUR} / 24)"),
    "hour_cos": R(f"cos(2 * pi() * {_HOUR} / 24)"),
    "dow_sin": R(f"sin(2 * pi() * {_DOW} / 7)"),
    "dow_cos": R(f"cos(2 * pi() * {_DOW} / 7)"),
}
put("fn_cyclic", _columns(lambda: _parts(CYCLIC_SQL)), _select(CYCLIC_SQL))

# Chord form of the great-circle distance, unlike the expression under test.
DISTANCE_SQL = """(2 * 6371e0 * asin(least(1e0, 0.5e0 * sqrt(
    pow(cos(radians(lat)) * cos(radians(long)) - cos(radians(merch_lat)) * cos(radians(merch_long)), 2)
  + pow(cos(radians(lat)) * sin(radians(long)) - cos(radians(merch_lat)) * sin(radians(merch_long)), 2)
  + pow(sin(radians(lat)) - sin(radians(merch_lat)), 2)))))"""
_SHIFTED = DISTANCE_SQL.replace("radians(lat)", "radians(0e0)").replace("radians(long)", "radians(0e0)")

put(
    "fn_haversine",
    _columns(
        lambda: {
            "km_from_origin": geo.haversine(
                F.lit(0.0), F.lit(0.0), F.col("merch_lat"), F.col("merch_long")
            )
        },
        digits=5,
    ),
    _select({"km_from_origin": R(_SHIFTED, 5)}),
)
put(
    "fn_home_merch_distance",
    _columns(lambda: {"dist_home_merch": geo.home_merchant_distance()}, digits=5),
    _select({"dist_home_merch": R(DISTANCE_SQL, 5)}),
)

# Distances over the whole range of the bins: a stretched amount, with gaps.
_KM = "(CASE WHEN trans_num % 17 = 0 THEN NULL ELSE amt * amt / 40 END)"


def _km():
    return F.when(F.col("trans_num") % 17 != 0, F.col("amt") * F.col("amt") / 40)


def _label():
    return geo.category7(_km())


_LABEL_SQL = f"""CASE WHEN {_KM} <= 1 THEN '<1km' WHEN {_KM} <= 10 THEN '1-10km'
  WHEN {_KM} <= 50 THEN '10-50km' WHEN {_KM} <= 100 THEN '50-100km'
  WHEN {_KM} <= 500 THEN '100-500km' WHEN {_KM} <= 1000 THEN '500-1000km'
  WHEN {_KM} > 1000 THEN '>1000km' END"""


def _far_sql(literal, corrected, missing):
    near = f"""WHEN {_KM} <= 1 THEN 0 WHEN {_KM} <= 10 THEN 1 WHEN {_KM} <= 50 THEN 2
      WHEN {_KM} <= 100 THEN 3 WHEN {_KM} <= 500 THEN 4"""
    return {
        literal: B(f"CASE {near} ELSE {missing} END"),
        corrected: B(f"CASE {near} WHEN {_KM} > 500 THEN 5 ELSE {missing} END"),
    }


put(
    "fn_dist_bucket5",
    _columns(lambda: {"bucket": geo.bucket5(_km())}),
    _select(
        {
            "bucket": B(
                f"CASE WHEN {_KM} > 100 THEN 4 WHEN {_KM} > 50 THEN 3 "
                f"WHEN {_KM} > 10 THEN 2 WHEN {_KM} > 1 THEN 1 ELSE 0 END"
            )
        }
    ),
)
put("fn_dist_category7", _columns(lambda: {"label": _label()}), _select({"label": _LABEL_SQL}))
put(
    "fn_dist_category_num",
    _columns(
        lambda: {"num": geo.category_num(_label()), "num_full": geo.category_num(_label(), True)}
    ),
    _select(_far_sql("num", "num_full", 3)),
)
put(
    "fn_dist_category_idx",
    _columns(
        lambda: {"idx": geo.category_idx(_label()), "idx_full": geo.category_idx(_label(), True)}
    ),
    _select(_far_sql("idx", "idx_full", -1)),
)

EDGES_SQL = ", ".join(
    f"(SELECT quantile_cont(amt, {i / 10}) FROM txn) AS e{i}" for i in range(11)
)
DECILE_SQL = (
    "CASE " + " ".join(f"WHEN amt <= e{i} THEN {i - 1}" for i in range(1, 11)) + " END"
)


@query(
    "fn_qcut_decile",
    f"WITH e AS (SELECT {EDGES_SQL}) SELECT trans_num, {B(DECILE_SQL)} AS decile FROM txn, e",
)
def fn_qcut_decile(spark, sf):
    rows = txn(spark, sf)
    decile = reports.decile_of(F.col("amt"), reports.decile_edges(rows))
    return tidy(rows.select("trans_num", decile.alias("decile")))


put(
    "fn_strip_fraud_prefix",
    _columns(lambda: {"merchant": scoring.strip_fraud_prefix(F.col("merchant"))}),
    _select({"merchant": "substr(merchant, 7)"}),
)
put(
    "fn_gender_bin",
    _columns(lambda: {"gender_bin": scoring.gender_bin(F.col("gender"))}),
    _select({"gender_bin": _flag("gender = 'M'")}),
)
put(
    "fn_pred_label",
    _columns(
        lambda: {
            "pred_label": scoring.pred_label(
                scoring.threshold_pred(F.col("fraud_probability"), 0.5)
            )
        }
    ),
    _select({"pred_label": "CASE WHEN fraud_probability >= 0.5e0 THEN 'Fraud' ELSE 'Legit' END"}),
)


def _odd():
    """A score that is NaN or missing on some rows."""
    kind = F.col("trans_num") % 19
    return (
        F.when(kind == 0, float("nan"))
        .when(kind == 1, F.lit(None).cast("double"))
        .otherwise(F.col("fraud_probability"))
    )


_odd_known = "trans_num % 19 > 1 AND fraud_probability"
put(
    "fn_threshold_pred",
    _columns(lambda: {"pred": scoring.threshold_pred(_odd(), 0.20803789577882506)}),
    _select({"pred": _flag(f"{_odd_known} >= 0.20803789577882506e0")}),
)
put(
    "fn_risk_tier",
    _columns(lambda: {"decision": scoring.risk_tier(_odd())}),
    _select(
        {
            "decision": f"CASE WHEN {_odd_known} >= 0.9e0 THEN 'block' "
            f"WHEN {_odd_known} >= 0.6e0 THEN 'review' ELSE 'allow' END"
        }
    ),
)
put(
    "fn_flag_positive",
    _columns(lambda: {"flagged": scoring.flag_positive(F.col("decision"))}, predictions),
    _select({"flagged": _flag("decision IS DISTINCT FROM 'allow'")}, "pred"),
)
