"""Feature tables under four sets of rules.

``eval`` and ``batch`` share most rules; ``app`` and ``notebook`` define night,
business hours, velocity and card statistics their own way. Features are added
to the input row, so the key travels with them.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from txnspark.functions import geo
from txnspark.functions.scoring import gender_bin
from txnspark.functions.time import (
    TIME_DEFAULTS,
    epoch_seconds,
    parse_ts,
    parse_ts_or_epoch,
    time_features,
)
from txnspark.operators import columns, ordered
from txnspark.operators.cards import add_card_totals, join_card_stats
from txnspark.operators.history import (
    ALONE,
    DAY,
    HOUR,
    Columns,
    Feature,
    PrevTime,
    Prior,
    Rolling,
    SinceLast,
    TxnIndex,
    Velocity,
    add_history,
    alone,
)

KEYS = Columns()

# The features a batch scorer asks for by default.
BATCH_FEATURES = [
    "amt", "city_pop", "dayofweek", "dayofyear", "dist_category_bucket_idx", "dist_home_merch",
    "dow_cos", "dow_sin", "hour", "hour_cos", "hour_sin", "is_business_hours", "is_night",
    "is_weekend", "max_amt", "mean_amt", "median_amt", "month", "std_amt", "time_since_last_txn",
    "total_amt_last_1h", "total_amt_last_24h", "transaction_count", "txn_count_last_1h",
    "txn_count_last_24h", "mean_distance", "gender_bin",
]

CATEGORY_VELOCITY = [
    "txn_count_last_1h_category",
    "total_amt_last_1h_category",
    "txn_count_last_24h_category",
    "total_amt_last_24h_category",
]
EVAL_FEATURES = [*BATCH_FEATURES, *CATEGORY_VELOCITY]


def velocity_features(mode: str, by_category: bool = False) -> dict[str, Feature]:
    tail = "_category" if by_category else ""
    return {
        f"{name}_last_{window}{tail}": Velocity(seconds, what, mode, by_category)
        for window, seconds in (("1h", HOUR), ("24h", DAY))
        for name, what in (("txn_count", "count"), ("total_amt", "sum"))
    }


def _has_positions(df: DataFrame) -> bool:
    return {"lat", "long", "merch_lat", "merch_long"} <= set(df.columns)


def build(
    df: DataFrame,
    want: Collection[str] | None = None,
    profile: str = "eval",
    hot_rows: int = ordered.HOT_ROWS,
) -> DataFrame:
    """Input rows with the wanted features (all of the profile's by default)."""
    if profile in ("eval", "batch"):
        default = EVAL_FEATURES if profile == "eval" else BATCH_FEATURES
        return _build_scorer(df, set(default if want is None else want), profile, hot_rows)
    if profile == "app":
        return build_app(df, hot_rows=hot_rows)
    if profile == "notebook":
        return build_notebook(df, hot_rows)
    if profile == "transformer":
        return build_transformer(df, hot_rows)
    raise ValueError(f"unknown profile {profile}")


def _build_scorer(df: DataFrame, want: set[str], profile: str, hot_rows: int) -> DataFrame:
    out, k = df, KEYS
    has_time = k.time in df.columns
    if has_time:
        out = out.withColumn(k.time, parse_ts(F.col(k.time)))
    add: dict[str, Column] = {}
    if has_time:
        parts = time_features(F.col(k.time))
        add |= {n: c for n, c in parts.items() if n in want}
    if "dist_home_merch" in want and _has_positions(df):
        add["dist_home_merch"] = geo.home_merchant_distance()
    if "gender_bin" in want and "gender" in df.columns:
        add["gender_bin"] = gender_bin(F.col("gender"))
    out = out.withColumns(add)
    has_distance = "dist_home_merch" in out.columns
    if "dist_category_bucket_idx" in want and has_distance:
        out = out.withColumn("dist_category_bucket_idx", geo.bucket5(F.col("dist_home_merch")))
    if has_time and k.card in df.columns:
        history = {n: f for n, f in _scorer_history(out, profile).items() if n in want}
        if history:
            out = add_history(out, history, k, hot_rows)
    labels = columns.LABELS_EVAL if profile == "eval" else columns.LABELS_BATCH
    return columns.drop_present(out, labels)


def _scorer_history(df: DataFrame, profile: str) -> dict[str, Feature]:
    out: dict[str, Feature] = {
        "time_since_last_txn": SinceLast(),
        "transaction_count": TxnIndex(),
    }
    if "dist_home_merch" in df.columns:
        out["mean_distance"] = Rolling("mean", distance=True)
    if KEYS.amount in df.columns:
        out |= {f"{s}_amt": Rolling(s) for s in ("mean", "std", "median", "max")}
        out |= velocity_features("closed")
        if profile == "eval" and KEYS.category in df.columns:
            out |= velocity_features("closed", by_category=True)
    return out


def upload_time(raw: DataFrame, time: str) -> Column:
    """Time of an uploaded row. A text column without any time holds epoch seconds."""
    dtype = raw.schema[time].dataType
    if isinstance(dtype, StringType):
        number = F.col(time).try_cast("double")
        times, numbers = raw.agg(F.count(parse_ts(F.col(time))), F.count(number)).first()
        if not times and numbers:
            return parse_ts_or_epoch(number, DoubleType())
    return parse_ts_or_epoch(F.col(time), dtype)


def build_app(
    raw: DataFrame,
    velocity: str = "app",
    id_order: list[str] | None = None,
    hot_rows: int = ordered.HOT_ROWS,
) -> DataFrame:
    """Upload rules: aliases, defaults for what is missing, whole-card statistics.

    ``velocity="app"`` counts from the window start on with no upper end, later
    rows included; ``"closed"`` stops at the row itself.
    """
    out = columns.resolve_aliases(raw, id_order)
    time = columns.first_present(raw, columns.TIME_NAMES)
    if time:
        out = out.withColumn("_ts", upload_time(raw, time))
        ts = F.col("_ts")
        parts = time_features(ts, night_from=22, end_inclusive=False)
        parts["unix_time"] = epoch_seconds(ts)
        out = out.withColumns({n: c.cast("double") for n, c in parts.items()})
    else:
        out = out.withColumns({n: F.lit(v) for n, v in TIME_DEFAULTS.items()})
    out = out.withColumn("dist_home_merch", geo.home_merchant_distance())
    out = add_card_totals(out, hot_rows=hot_rows)
    names = ["time_since_last_txn", *velocity_features(velocity)]
    if not time:
        out = out.withColumns({n: F.lit(0.0) for n in names})
        return columns.object_to_numeric(out, skip=("trans_num",))
    history = {"time_since_last_txn": SinceLast(whole_seconds=True), **velocity_features(velocity)}
    out = add_history(out, history, Columns(time="_ts"), hot_rows)
    counts = {n: F.col(n).cast("double") for n in names}
    return columns.object_to_numeric(out.withColumns(counts).drop("_ts"), skip=("trans_num",))


def build_notebook(df: DataFrame, hot_rows: int = ordered.HOT_ROWS) -> DataFrame:
    """Training rules: whole-card statistics, minutes, half-open velocity windows."""
    k = KEYS
    out = df.withColumn(k.time, parse_ts(F.col(k.time)))
    distance = geo.home_merchant_distance()
    out = out.withColumns(time_features(F.col(k.time), night_from=22))
    out = out.withColumn("dist_home_merch", distance)
    out = out.withColumn("dist_category", geo.category7(F.col("dist_home_merch")))
    # Statistics and history group by the same two columns: one exchange serves both.
    out = join_card_stats(out.withColumn(ALONE, alone(k)), hot_rows=hot_rows)
    history = {
        "prev_trans_time": PrevTime(),
        "time_since_last_trans": SinceLast(),
        "time_since_last_txn": SinceLast("minutes"),
        **velocity_features("half_open"),
    }
    if k.category in df.columns:
        history |= velocity_features("half_open", by_category=True)
    return add_history(out, history, k, hot_rows).drop(ALONE)


def build_transformer(df: DataFrame, hot_rows: int = ordered.HOT_ROWS) -> DataFrame:
    """The fitted pipeline's own rules: history only, statistics of earlier rows."""
    k = KEYS
    out = df.withColumn(k.time, parse_ts(F.col(k.time)))
    history = {
        "time_since_last_txn": SinceLast("minutes"),
        **velocity_features("half_open"),
        "transaction_count": TxnIndex(),
        **{f"{s}_amt": Prior(s) for s in ("mean", "std", "median", "max")},
    }
    return add_history(out, history, k, hot_rows)
