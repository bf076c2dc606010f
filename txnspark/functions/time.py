"""Calendar and clock expressions on a transaction time column.

Every expression reads wall-clock fields, so results do not depend on the
session time zone for ``timestamp_ntz`` columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NumericType


def parse_ts(text: Column) -> Column:
    """Timestamp without zone; unreadable text becomes NULL."""
    return text.try_cast("timestamp_ntz")


def parse_ts_or_epoch(value: Column, dtype: DataType) -> Column:
    """Like ``parse_ts``, but a numeric column holds epoch seconds."""
    if isinstance(dtype, NumericType):
        whole = F.floor(value).cast("long")
        micros = F.round((value - whole) * 1_000_000).cast("long")
        start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return start + F.make_dt_interval(secs=whole) + F.make_dt_interval(
            secs=(micros / 1_000_000).cast("decimal(18,6)")
        )
    return parse_ts(value)


def hour(ts: Column) -> Column:
    return F.hour(ts)


def day_of_week(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def month(ts: Column) -> Column:
    return F.month(ts)


def day_of_year(ts: Column) -> Column:
    return F.dayofyear(ts)


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970-01-01, floored."""
    days = F.unix_date(ts.cast("date")).cast("long")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def epoch_micros(ts: Column) -> Column:
    days = F.unix_date(ts.cast("date")).cast("long")
    minutes = days * 1440 + F.hour(ts) * 60 + F.minute(ts)
    # extract(SECOND) is a decimal with the microseconds as its fraction.
    within = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return minutes * 60_000_000 + within


def _flag(condition: Column) -> Column:
    """1 or 0; an unknown time is 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def is_weekend(ts: Column) -> Column:
    return _flag(F.weekday(ts) >= 5)


def is_night(ts: Column, night_from: int | None = None) -> Column:
    """Hours 0 to 5; with ``night_from`` (22) the late evening counts too."""
    late = F.lit(False) if night_from is None else F.hour(ts) >= night_from
    return _flag((F.hour(ts) < 6) | late)


def is_business_hours(ts: Column, end_inclusive: bool = True) -> Column:
    """9 to 17 o'clock, with or without the hour 17."""
    last = 17 if end_inclusive else 16
    return _flag(F.hour(ts).between(9, last))


def cyclic(part: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a part of the day or week."""
    angle = part * (2 * math.pi) / period
    return F.sin(angle), F.cos(angle)


def month_tag(ts: Column) -> Column:
    """Aggregate: month of the latest time as yyyy-MM."""
    return F.coalesce(F.date_format(F.max(ts), "yyyy-MM"), F.lit("unknown-month"))


# Fixed values used when a table has no time column.
TIME_DEFAULTS = {
    "hour": 0.0,
    "dayofweek": 0.0,
    "month": 1.0,
    "is_weekend": 0.0,
    "is_night": 0.0,
    "is_business_hours": 1.0,
    "hour_sin": 0.0,
    "hour_cos": 1.0,
    "dow_sin": 0.0,
    "dow_cos": 1.0,
    "dayofyear": 1.0,
    "unix_time": 0.0,
}


def time_features(
    ts: Column, night_from: int | None = None, end_inclusive: bool = True
) -> dict[str, Column]:
    """Every calendar feature by name; callers pick what they need."""
    hour_sin, hour_cos = cyclic(hour(ts), 24)
    dow_sin, dow_cos = cyclic(day_of_week(ts), 7)
    return {
        "hour": hour(ts),
        "dayofweek": day_of_week(ts),
        "dayofyear": day_of_year(ts),
        "month": month(ts),
        "is_weekend": is_weekend(ts),
        "is_night": is_night(ts, night_from),
        "is_business_hours": is_business_hours(ts, end_inclusive),
        "hour_sin": hour_sin,
        "hour_cos": hour_cos,
        "dow_sin": dow_sin,
        "dow_cos": dow_cos,
    }
