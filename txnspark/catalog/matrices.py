"""Encoders and feature tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnspark.catalog.registry import B, R, put, query, tidy
from txnspark.catalog.scalars import CYCLIC_SQL, DISTANCE_SQL
from txnspark.catalog.summaries import KEY_SQL, sample_key
from txnspark.catalog.windows import STAT_DIGITS, pairs_sql, prior_sql, rolling_sql, total_sql
from txnspark.functions.time import epoch_seconds
from txnspark.operators import encode, sampling
from txnspark.plans import features
from txnspark.plans.features import velocity_features
from txnspark.sources.testdata import table, txn

T = "trans_date_trans_time"

# ------------------------------------------------------------------- encoders


@query(
    "enc_label",
    f"""WITH c AS (SELECT trans_num, CASE WHEN trans_num % 23 = 0 THEN 'nan' ELSE merchant END AS m,
      category FROM txn)
    SELECT trans_num, {B('dense_rank() OVER (ORDER BY m) - 1')} AS merchant,
      {B('dense_rank() OVER (ORDER BY category) - 1')} AS category FROM c""",
)
def enc_label(spark, sf):
    some = F.when(F.col("trans_num") % 23 != 0, F.col("merchant"))
    rows = txn(spark, sf).select("trans_num", some.alias("merchant"), "category")
    return tidy(encode.label_encode(rows, ["merchant", "category"]))


@query(
    "enc_one_hot",
    "SELECT trans_num, "
    + ", ".join(
        f"{B(f'CASE WHEN category = {chr(39)}{c}{chr(39)} THEN 1 ELSE 0 END')} AS category_{c}"
        for c in ("error", "purchase", "signup", "view")
    )
    + f", {B('CASE WHEN gender = {0}M{0} THEN 1 ELSE 0 END'.format(chr(39)))} AS gender_M FROM txn",
)
def enc_one_hot(spark, sf):
    rows = txn(spark, sf).select("trans_num", "category", "gender")
    return tidy(encode.one_hot(rows, ["gender", "category"]))


@query(
    "enc_one_hot_places",
    f"""SELECT trans_num, {B('m - 2')} AS merchant FROM
      (SELECT trans_num, dense_rank() OVER (ORDER BY merchant) AS m FROM txn)""",
)
def enc_one_hot_places(spark, sf):
    rows = txn(spark, sf).select("trans_num", "merchant")
    # The first level has no place; -1 stands for it here.
    place = F.coalesce("merchant", F.lit(-1)).alias("merchant")
    return tidy(encode.one_hot_places(rows, ["merchant"]).select("trans_num", place))


@query(
    "enc_target_smooth",
    f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY is_fraud ORDER BY {KEY_SQL}, trans_num)
        <= ceil(0.2e0 * count(*) OVER (PARTITION BY is_fraud)) AS is_test FROM txn),
    p AS (SELECT avg(is_fraud) AS prior FROM s WHERE NOT is_test),
    m AS (SELECT merchant, (sum(is_fraud) + max(prior) * 200) / (count(*) + 200) AS te
      FROM s, p WHERE NOT is_test GROUP BY merchant),
    c AS (SELECT category, (sum(is_fraud) + max(prior) * 100) / (count(*) + 100) AS te
      FROM s, p WHERE NOT is_test AND category <> 'view' GROUP BY category)
    SELECT trans_num, {R('coalesce(m.te, prior)')} AS te_merchant,
      {R('coalesce(c.te, prior)')} AS te_category
    FROM s CROSS JOIN p LEFT JOIN m USING (merchant) LEFT JOIN c USING (category)""",
)
def enc_target_smooth(spark, sf):
    rows = sampling.stratified_split(txn(spark, sf), key=sample_key())
    train = rows.where(~F.col("is_test"))
    merchant = encode.fit_target_encoding(train, "merchant", m=200)
    # One category has no name in training, so it is unseen and gets the prior.
    named = train.withColumn("category", F.when(F.col("category") != "view", F.col("category")))
    category = encode.fit_target_encoding(named, "category")
    out = encode.apply_target_encoding(encode.apply_target_encoding(rows, merchant), category)
    return tidy(out.select("trans_num", "te_merchant", "te_category"))


@query(
    "enc_scale",
    f"""SELECT trans_num, {R('amt / (SELECT stddev_pop(amt) FROM txn)')} AS amt,
      {R('lat / (SELECT stddev_pop(lat) FROM txn)')} AS lat, 1e0 AS same FROM txn""",
)
def enc_scale(spark, sf):
    rows = txn(spark, sf).select("trans_num", "amt", "lat", F.lit(1.0).alias("same"))
    scale = encode.fit_scale(rows, ["amt", "lat", "same"])
    return tidy(encode.apply_scale(rows, scale))


@query(
    "enc_customer_segments",
    f"""SELECT c_custkey, {B('dense_rank() OVER (ORDER BY c_name) - 1')} AS c_name,
      {B("CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END")} AS segment_building FROM customer""",
)
def enc_customer_segments(spark, sf):
    """Label encoding where every row has its own value."""
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    out = encode.one_hot(encode.label_encode(rows, ["c_name"]), ["c_mktsegment"])
    return tidy(
        out.select(
            "c_custkey", "c_name", F.col("c_mktsegment_BUILDING").alias("segment_building")
        )
    )


# ------------------------------------------------------------- feature tables

_HOUR = f"hour({T})"
_NUMBER = f"row_number() OVER (PARTITION BY cc_num ORDER BY {T}, trans_num)"
_SINCE = f"""coalesce((epoch_us({T}) - epoch_us(lag({T}) OVER (PARTITION BY cc_num
  ORDER BY {T}, trans_num))) / 1e6, 0e0)"""


def _flag(condition):
    return B(f"CASE WHEN {condition} THEN 1 ELSE 0 END")


_TIME_SQL = {
    "hour": B(_HOUR),
    "dayofweek": B(f"isodow({T}) - 1"),
    "dayofyear": B(f"dayofyear({T})"),
    "month": B(f"month({T})"),
    "is_weekend": _flag(f"isodow({T}) >= 6"),
    "is_night": _flag(f"{_HOUR} < 6"),
    "is_business_hours": _flag(f"{_HOUR} BETWEEN 9 AND 17"),
    **CYCLIC_SQL,
}
_LATE_NIGHT = _flag(f"{_HOUR} < 6 OR {_HOUR} >= 22")
_ROLLING_SQL = {f"{s}_amt": rolling_sql(s) for s in ("mean", "std", "median", "max")}
_BUCKET = B(
    "CASE WHEN km > 100 THEN 4 WHEN km > 50 THEN 3 WHEN km > 10 THEN 2 WHEN km > 1 THEN 1 ELSE 0 END"
)
_SCORER_SQL = {
    "amt": R("amt"),
    **_TIME_SQL,
    "dist_home_merch": R("km", 5),
    "dist_category_bucket_idx": _BUCKET,
    "gender_bin": _flag("gender = 'M'"),
    "time_since_last_txn": R(_SINCE),
    "transaction_count": B(_NUMBER),
    **_ROLLING_SQL,
    "mean_distance": R(
        f"""avg(km) OVER (PARTITION BY cc_num ORDER BY {T}, trans_num
        ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)""",
        5,
    ),
}


def _table_sql(columns, *joins):
    ctes = [f"d AS (SELECT *, {DISTANCE_SQL} AS km FROM txn)"]
    ctes += [f"v{i} AS ({sql})" for i, sql in enumerate(joins)]
    picked = ", ".join(f"{c} AS {n}" for n, c in columns.items())
    more = "".join(f" JOIN v{i} USING (trans_num)" for i in range(len(joins)))
    extra = "".join(f", v{i}.* EXCLUDE (trans_num)" for i in range(len(joins)))
    return f"""WITH {', '.join(ctes)}, f AS (SELECT trans_num, {picked} FROM d)
    SELECT f.*{extra} FROM f{more}"""


_closed = velocity_features("closed")
_closed_category = velocity_features("closed", by_category=True)
_MONEY = {"total_amt_last_1h": 4, "total_amt_last_24h": 4}
_MONEY |= {f"{n}_category": 4 for n in _MONEY}
_KM = {"dist_home_merch": 5, "mean_distance": 5}


def _tidy(df):
    stats = {f"{s}_amt": STAT_DIGITS for s in ("mean", "std", "median", "max")}
    return tidy(df, **_MONEY, **_KM, **stats)


@query(
    "feat_build_eval",
    _table_sql(
        _SCORER_SQL,
        pairs_sql(_closed, "closed"),
        pairs_sql(_closed_category, "closed", by_category=True),
    ),
)
def feat_build_eval(spark, sf):
    out = features.build(txn(spark, sf), profile="eval")
    names = [f for f in features.EVAL_FEATURES if f != "city_pop"]
    return _tidy(out.select("trans_num", *names))


@query("feat_build_batch", _table_sql(_SCORER_SQL, pairs_sql(_closed, "closed")))
def feat_build_batch(spark, sf):
    out = features.build(txn(spark, sf), profile="batch")
    names = [f for f in features.BATCH_FEATURES if f != "city_pop"]
    return _tidy(out.select("trans_num", *names))


def _stats_sql(zero):
    std = "coalesce(stddev_samp(amt), 0)" if zero else "stddev_samp(amt)"
    count = "CAST(count(amt) AS DOUBLE)" if zero else B("count(amt)")
    return f"""SELECT trans_num, s.* EXCLUDE (cc_num) FROM txn JOIN (SELECT cc_num,
      {total_sql('mean')} AS mean_amt, {R(std, STAT_DIGITS)} AS std_amt, {total_sql('median')} AS median_amt,
      {total_sql('max')} AS max_amt, {R(f'avg({DISTANCE_SQL})', 5)} AS mean_distance,
      {count} AS transaction_count FROM txn GROUP BY cc_num) s USING (cc_num)"""


_APP_SQL = {
    **{n: f"CAST({c} AS DOUBLE)" for n, c in _TIME_SQL.items()},
    "is_night": f"CAST({_LATE_NIGHT} AS DOUBLE)",
    "is_business_hours": f"CAST({_flag(f'{_HOUR} BETWEEN 9 AND 16')} AS DOUBLE)",
    "unix_time": f"CAST(epoch_us({T}) // 1000000 AS DOUBLE)",
    "dist_home_merch": R("km", 5),
    "merch_zipcode": "0e0",
    "time_since_last_txn": f"""CAST(coalesce(epoch_us({T}) // 1000000 - lag(epoch_us({T}) // 1000000)
      OVER (PARTITION BY cc_num ORDER BY {T}, trans_num), 0) AS DOUBLE)""",
}
_APP_NAMES = [
    *_APP_SQL,
    *["mean_amt", "std_amt", "median_amt", "max_amt", "mean_distance", "transaction_count"],
    *_closed,
]


def _as_doubles(sql, names):
    return f"SELECT trans_num, {', '.join(f'CAST({n} AS DOUBLE) AS {n}' for n in names)} FROM ({sql})"


def _app(velocity):
    def run(spark, sf):
        out = features.build_app(txn(spark, sf), velocity=velocity)
        return _tidy(out.select("trans_num", *_APP_NAMES))

    return run


for _name, _mode in (("feat_build_app", "app"), ("feat_build_app_closed", "closed")):
    _pairs = _as_doubles(pairs_sql(velocity_features(_mode), _mode), _closed)
    put(_name, _app(_mode), _table_sql(_APP_SQL, _stats_sql(True), _pairs))

_NOTEBOOK_SQL = {
    **_TIME_SQL,
    "is_night": _LATE_NIGHT,
    "dist_home_merch": R("km", 5),
    "dist_category": """CASE WHEN km <= 1 THEN '<1km' WHEN km <= 10 THEN '1-10km'
      WHEN km <= 50 THEN '10-50km' WHEN km <= 100 THEN '50-100km' WHEN km <= 500 THEN '100-500km'
      WHEN km <= 1000 THEN '500-1000km' ELSE '>1000km' END""",
    "time_since_last_trans": R(_SINCE),
    "time_since_last_txn": R(f"{_SINCE} / 60"),
}
_half = velocity_features("half_open")
_half_category = velocity_features("half_open", by_category=True)


@query(
    "feat_build_notebook",
    _table_sql(
        _NOTEBOOK_SQL,
        _stats_sql(False),
        pairs_sql(_half, "half_open"),
        pairs_sql(_half_category, "half_open", by_category=True),
    ),
)
def feat_build_notebook(spark, sf):
    out = features.build(txn(spark, sf), profile="notebook")
    names = [*_NOTEBOOK_SQL, *_half, *_half_category]
    stats = ["mean_amt", "std_amt", "median_amt", "max_amt", "mean_distance", "transaction_count"]
    return _tidy(out.select("trans_num", *names, *stats))


_PRIOR_SQL = {
    "time_since_last_txn": R(f"{_SINCE} / 60"),
    "transaction_count": B(_NUMBER),
    **{f"{s}_amt": prior_sql(s) for s in ("mean", "std", "median", "max")},
}


@query("feat_build_transformer", _table_sql(_PRIOR_SQL, pairs_sql(_half, "half_open")))
def feat_build_transformer(spark, sf):
    out = features.build(txn(spark, sf), profile="transformer")
    return _tidy(out.select("trans_num", *_PRIOR_SQL, *_half))


@query(
    "feat_build_app_no_time",
    f"""SELECT trans_num, {R('amt')} AS amt, 0e0 AS hour, 1e0 AS is_business_hours,
      0e0 AS txn_count_last_24h, {R('km', 5)} AS dist_home_merch
    FROM (SELECT *, {DISTANCE_SQL} AS km FROM txn)""",
)
def feat_build_app_no_time(spark, sf):
    """An upload without a time, its amounts as text."""
    rows = txn(spark, sf).drop(T).withColumn("amt", F.col("amt").cast("string"))
    out = features.build_app(rows)
    names = ["amt", "hour", "is_business_hours", "txn_count_last_24h", "dist_home_merch"]
    return tidy(out.select("trans_num", *names), dist_home_merch=5)


@query(
    "fn_parse_ts_epoch_text",
    f"SELECT trans_num, {B(_HOUR)} AS hour, CAST(epoch_us({T}) // 1000000 AS DOUBLE) AS unix_time FROM txn",
)
def fn_parse_ts_epoch_text(spark, sf):
    """An upload whose times are epoch seconds as text."""
    rows = txn(spark, sf).withColumn(T, epoch_seconds(F.col(T)).cast("string"))
    out = features.build_app(rows).select("trans_num", F.col("hour").cast("long").alias("hour"), "unix_time")
    return tidy(out)
