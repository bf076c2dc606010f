"""Sharding along a Hilbert curve for multidimensional file pruning.

Every metadata dimension is quantised into 2**bits bins of about equal row mass; the
bins of a row are a point of a grid, and its index along the Hilbert curve through that
grid orders the rows. Runs of the order become shards whose row counts differ by at
most one, so each file covers a small box in all dimensions at once, which a manifest
of minima and maxima lets readers prune.

Bin edges are values of the data, found by counting equal values first and by running
totals over those counts; at most 2**bits edges per dimension reach the driver. Equal
rows of the curve are ordered by text hash and document number, so copies stay
together and the order is fixed. Only keys are exchanged, never texts.

Defined results: a null value is the lowest bin of its dimension; rows equal in every
ordering column are interchangeable; an empty table has no shards; more shards than
rows leave some shards empty; input columns named hilbert, shard or slot are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnspark.llm.common import Batches, column, map_batches, record
from txnspark.operators import ordered
from txnspark.sources.scratch import written


#: Rows of one block when rows or values are numbered in order.
BLOCK_ROWS = 1 << 16


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of integer points (rows, dimensions).

    Works from the highest bit down: each level's orthant is a Gray code rank under
    the reflections and rotations that the levels above left behind.
    """
    rows, dims = points.shape
    x = points.astype(np.int64).copy()
    top = 1 << (bits - 1)
    level = top
    while level > 1:
        low = level - 1
        for d in range(dims):
            high = (x[:, d] & level) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, d]) & low)
            x[:, 0] = np.where(high, x[:, 0] ^ low, x[:, 0] ^ swap)
            x[:, d] ^= swap
        level >>= 1
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    flip = np.zeros(rows, np.int64)
    level = top
    while level > 1:
        flip = np.where(x[:, dims - 1] & level, flip ^ (level - 1), flip)
        level >>= 1
    x ^= flip[:, None]
    out = np.zeros(rows, np.int64)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            out = out << 1 | (x[:, d] >> b & 1)
    return out


def edges(df: DataFrame, value: str, bits: int, limit: int = BLOCK_ROWS) -> list:
    """Ascending values that open the bins 1, 2, ...: about equal row mass in each bin."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    counts = written(counts, "values")
    upto = ordered.running(
        counts, [], [F.col(value)], {"_before": (F.col("_n"), "sum", False)}, totals=True, limit=limit
    )
    bins = 1 << bits
    first = F.floor(F.col("_before") * (bins - 1) / F.col("total__before"))
    opens = upto.groupBy(first.alias("_bin")).agg(F.min(value).alias("_edge"))
    return sorted(r["_edge"] for r in opens.collect())  # at most 2**bits


def bin_of(value: Column, opens: Sequence) -> Column:
    """0 for null, else the number of edges at or below the value: a binary search in the plan."""

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high + 1) // 2
        return F.when(value >= F.lit(opens[middle - 1]), between(middle, high)).otherwise(between(low, middle - 1))

    return F.when(value.isNull(), F.lit(0)).otherwise(between(0, len(opens))).cast("int")


def curve_index(df: DataFrame, dims: Sequence[str], bits: int = 6, name: str = "hilbert") -> DataFrame:
    """``df`` with the curve index of its bins; the bins alone go through Arrow."""
    # The input's columns travel as one, so that none can clash with those made here.
    bins = [bin_of(F.col(d), edges(df, d, bits)).alias(f"_b{i}") for i, d in enumerate(dims)]
    points = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != name]).alias("_row"), *bins)
    at = [f"_b{i}" for i in range(len(dims))]
    grid = points.select(*at).distinct()  # at most 2**(bits * dimensions) points, usually far fewer
    schema = pa.schema([*((a, pa.int32()) for a in at), (name, pa.int64())])

    def index(batches: Batches) -> Batches:
        for batch in batches:
            cells = [column(batch, a) for a in at]
            yield record(schema, *cells, hilbert_index(np.stack([c.to_numpy() for c in cells], 1), bits))

    indexed = map_batches(grid, index, ", ".join([*(f"{a} int" for a in at), f"{name} long"]))
    return points.join(indexed, at).select("_row.*", name)


def shards(
    df: DataFrame, dims: Sequence[str], ties: Sequence[str], count: int = 16, bits: int = 6
) -> DataFrame:
    """``df`` with hilbert, shard (0 to count - 1) and slot (gapless from 0 in its shard)."""
    df = df.drop("hilbert", "shard", "slot")
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    keys = {f"_d{i}": d for i, d in enumerate(dims)} | {f"_t{i}": t for i, t in enumerate(ties)}
    packed = df.select(row, *[F.col(c).alias(k) for k, c in keys.items()])
    rows = written(curve_index(packed, list(keys)[: len(dims)], bits), "curve")
    total = rows.count()
    order = [F.col(c) for c in ("hilbert", *list(keys)[len(dims) :])]
    numbered = ordered.numbered(rows, order, "_place", limit=BLOCK_ROWS)
    place = F.col("_place") - 1
    shard = F.expr(f"((_place - 1) * {count}L) div {max(total, 1)}L")
    opens = F.expr(f"(_shard * {max(total, 1)}L + {count - 1}L) div {count}L")
    return numbered.withColumn("_shard", shard).select(
        "_row.*", "hilbert", F.col("_shard").cast("int").alias("shard"), (place - opens).alias("slot")
    )


def write_shards(sharded: DataFrame, path: str, count: int = 16) -> None:
    """One folder per shard, rows in curve order inside each file."""
    rows = sharded.repartitionByRange(count, "shard", "slot").sortWithinPartitions("shard", "slot")
    rows.write.partitionBy("shard").parquet(path)


def manifest(sharded: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Rows, minimum and maximum of every dimension per shard."""
    bounds = [f(d).alias(f"{n}_{d}") for d in dims for n, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *bounds)


def prune(shards_manifest: DataFrame, ranges: dict[str, tuple]) -> DataFrame:
    """Shards that can hold rows with every dimension inside its (low, high) range."""
    out = shards_manifest
    for d, (low, high) in ranges.items():
        out = out.where((F.col(f"max_{d}") >= F.lit(low)) & (F.col(f"min_{d}") <= F.lit(high)))
    return out
