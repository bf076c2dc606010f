"""Comparison of result tables without regard to row order."""

import math

import pandas as pd


def plain(frame):
    """``frame`` with whole numbers that may be missing as pandas has them without an extension type."""
    extended = [c for c in frame.columns if isinstance(frame[c].dtype, pd.Int64Dtype)]
    return frame.astype({c: "float64" if frame[c].isna().any() else "int64" for c in extended})


def canon(frame):
    frame = frame[sorted(frame.columns)]
    rows = []
    for row in frame.itertuples(index=False, name=None):
        rows.append(
            tuple(
                None
                if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v))
                else v
                for v in row
            )
        )
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def close(a, b, rel=1e-9, abs_tol=1e-6):
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) or isinstance(b, float):
        if math.isnan(a) or math.isnan(b):
            return math.isnan(a) and math.isnan(b)
        return math.isclose(a, b, rel_tol=rel, abs_tol=abs_tol)
    return a == b
