"""Distance between card holder and merchant, and its buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0

# Right-closed upper edges in km.
BUCKET5_EDGES = [1, 10, 50, 100]
CATEGORY7 = [
    (1, "<1km"),
    (10, "1-10km"),
    (50, "10-50km"),
    (100, "50-100km"),
    (500, "100-500km"),
    (1000, "500-1000km"),
]
CATEGORY7_LAST = ">1000km"

# Label to ordinal. The two literal maps name the far bins
# differently from CATEGORY7, so far distances miss them.
NEAR_ORDER = {"<1km": 0, "1-10km": 1, "10-50km": 2, "50-100km": 3, "100-500km": 4}
NUM_ORDER = {**NEAR_ORDER, "500km+": 5}
IDX_ORDER = {**NEAR_ORDER, ">=500km": 5}
FULL_ORDER = {**NEAR_ORDER, "500-1000km": 5, ">1000km": 5}


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half_lat = F.sin((p2 - p1) / 2)
    half_lon = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    a = half_lat * half_lat + F.cos(p1) * F.cos(p2) * half_lon * half_lon
    # Rounding can push ``a`` past 1, where asin has no value.
    inside = F.when(a > 1.0, F.lit(1.0)).otherwise(a)
    return F.asin(F.sqrt(inside)) * (2 * EARTH_RADIUS_KM)


def home_merchant_distance() -> Column:
    return haversine(F.col("lat"), F.col("long"), F.col("merch_lat"), F.col("merch_long"))


def bucket5(km: Column) -> Column:
    """0 to 4 by right-closed bins; a missing distance is bucket 0."""
    out = F.when(km.isNull() | F.isnan(km), 0)
    for index, edge in enumerate(BUCKET5_EDGES):
        out = out.when(km <= edge, index)
    return out.otherwise(len(BUCKET5_EDGES))


def category7(km: Column) -> Column:
    """Distance label; missing distances and values not above -1 have none."""
    out = F.when(km.isNull() | F.isnan(km) | (km <= -1), F.lit(None).cast("string"))
    for edge, label in CATEGORY7:
        out = out.when(km <= edge, label)
    return out.otherwise(CATEGORY7_LAST)


def _ordinal(label: Column, order: dict[str, int], missing: int) -> Column:
    out = F.when(F.lit(False), missing)
    for name, number in order.items():
        out = out.when(label == name, number)
    return out.otherwise(missing)


def category_num(label: Column, corrected: bool = False) -> Column:
    """Label to 0..5, unmatched 3. Literal mode never matches the two far bins."""
    return _ordinal(label, FULL_ORDER if corrected else NUM_ORDER, 3)


def category_idx(label: Column, corrected: bool = False) -> Column:
    """Label to 0..5, unmatched -1. Literal mode never matches the two far bins."""
    return _ordinal(label, FULL_ORDER if corrected else IDX_ORDER, -1)
