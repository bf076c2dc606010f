"""Running totals, positions and quantiles that no single task has to hold.

A plain ``Window.partitionBy(key)`` sends a whole key to one task, and a window
without a key sends the whole table there. The functions here cut each ordered
group into blocks, work inside the blocks, and add what the earlier blocks of
the group carry over. Results are exact.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from txnspark.sources.scratch import written

# Rows one task may hold. A larger key, or a larger ordered table, is cut into blocks.
HOT_ROWS = 1_000_000

# Rows of a table that may be broadcast or collected.
SMALL_ROWS = 200_000

# Sampled rows per block when looking for block bounds.
SAMPLE_PER_BLOCK = 500

# A task of fewer rows takes longer to start than to run. Smaller limits are kept to
# until they would make more than MANY_BLOCKS blocks; these grow to TASK_ROWS first.
TASK_ROWS, MANY_BLOCKS = 1 << 16, 64

BLOCK = "_block"


def block_count(rows: int, limit: int) -> int:
    """Blocks of about ``limit`` rows."""
    return max(2, math.ceil(rows / limit))


def block_rows(rows: int, limit: int) -> int:
    """Rows of a block: ``limit``, or more where that would cut many tiny ones."""
    return max(limit, min(TASK_ROWS, rows // MANY_BLOCKS))


def broadcast_small(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """``df``, marked for broadcast if it has at most ``limit`` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def split_hot(
    df: DataFrame, by: Sequence[str], limit: int = HOT_ROWS, nulls: bool = False
) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary keys, rows of keys past ``limit`` or None).

    Costs one map-side combined count. At most rows/limit keys can be past the
    limit; up to SMALL_ROWS of them are a literal table that is broadcast, more are a
    written one that is joined. Rows with a NULL key count as ordinary unless
    ``nulls`` makes them a key.
    """
    keys = df.select(*by)
    if not nulls:
        keys = keys.dropna(subset=list(by))
    many = keys.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    many = many.select(*[F.col(c).alias(f"_h_{c}") for c in by])
    rows = many.limit(SMALL_ROWS + 1).collect()
    if not rows:
        return df, None
    if len(rows) > SMALL_ROWS:
        hot = written(many, "hot-keys")
    else:
        schema = StructType([StructField(f"_h_{c}", df.schema[c].dataType) for c in by])
        hot = F.broadcast(df.sparkSession.createDataFrame(rows, schema))
    same = _same(by, "_h_")
    return df.join(hot, same, "left_anti"), df.join(hot, same, "left_semi")


def range_blocks(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], blocks: int
) -> DataFrame:
    """Cut rows into even blocks of the (by, order) sequence, hot keys included.

    Range bounds come from a sample, so the numbered rows are written once and
    every later step reads the same numbering.
    """
    cut = df.repartitionByRange(blocks, *[F.col(c) for c in by], *order)
    return written(cut.withColumn(BLOCK, F.spark_partition_id()), "blocks")


def is_number(value: Column) -> Column:
    """Neither NULL nor NaN; infinities are numbers and have a place in the order."""
    return value.isNotNull() & ~F.isnan(value.cast("double"))


def value_bounds(df: DataFrame, value: str, limit: int = HOT_ROWS) -> list[float]:
    """Bounds that cut the values of a double column into blocks; none if one is enough.

    One scan counts rows and (approximately) distinct values, a second one reads
    a sample. Bounds become constants of the plan, so a recomputed task finds the
    same blocks; how even they are does not matter for the result.
    """
    df = df.where(is_number(F.col(value)))
    rows, distinct = df.agg(F.count(value), F.approx_count_distinct(value)).first()
    if distinct <= limit:
        return []
    n = block_count(rows, limit)
    sample = df.select(value)
    if rows > SAMPLE_PER_BLOCK * n:
        sample = sample.sample(SAMPLE_PER_BLOCK * n / rows, seed=42)
    cuts = sample.stat.approxQuantile(value, [i / n for i in range(1, n)], 1 / (4 * n))
    # Infinite values are in order but make no bound: the outer blocks hold them.
    return sorted({c for c in cuts if math.isfinite(c)})


def value_blocks(
    df: DataFrame, value: str, bounds: Sequence[float], descending: bool = False
) -> DataFrame:
    """Number the blocks between the bounds without moving or writing rows."""
    if not bounds:
        return df.withColumn(BLOCK, F.lit(0))
    splits = [float("-inf"), *bounds, float("inf")]
    # A value that is no number goes to a block past the last one, as it sorts.
    cut = Bucketizer(splits=splits, inputCol=value, outputCol="_bucket", handleInvalid="keep").transform(df)
    number = F.col("_bucket").cast("int")
    return cut.withColumn(BLOCK, -number if descending else number).drop("_bucket")


def _same(by: Sequence[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in by])


_FOLD = {"sum": F.sum, "max": F.max}


def _moments(value: Column, frame: WindowSpec | None = None) -> Column:
    """Count, mean and summed squared deviation of a frame, or of an aggregate's rows."""
    count, mean, spread = F.count(value), F.avg(value), F.var_pop(value)
    if frame is not None:
        count, mean, spread = count.over(frame), mean.over(frame), spread.over(frame)
    n = count.cast("double")
    zero = F.lit(0.0)
    return F.struct(n.alias("n"), F.coalesce(mean, zero).alias("mean"), F.coalesce(spread * n, zero).alias("m2"))


def _merged(a: Column, b: Column) -> Column:
    """Moments of two sets of rows together."""
    n = a["n"] + b["n"]
    gap = b["mean"] - a["mean"]
    share = F.when(n > 0, b["n"] / n).otherwise(0.0)
    mean = F.when(a["n"] == 0, b["mean"]).when(b["n"] == 0, a["mean"]).otherwise(a["mean"] + gap * share)
    between = F.when((a["n"] > 0) & (b["n"] > 0), gap * gap * a["n"] * share).otherwise(0.0)
    return F.struct(n.alias("n"), mean.alias("mean"), (a["m2"] + b["m2"] + between).alias("m2"))


def _no_rows() -> Column:
    return F.struct(*[F.lit(0.0).alias(c) for c in ("n", "mean", "m2")])


def _fold(how: str, value: Column) -> Column:
    return _moments(value) if how == "moments" else _FOLD[how](value)


def _fold_over(how: str, value: Column, frame: WindowSpec) -> Column:
    return _moments(value, frame) if how == "moments" else _FOLD[how](value).over(frame)


def _fold_parts(how: str, part: Column, frame: WindowSpec) -> Column:
    """What the blocks of a frame make together; a group has few blocks."""
    if how == "moments":
        return F.aggregate(F.collect_list(part).over(frame), _no_rows(), _merged)
    return _FOLD[how](part).over(frame)


def _in_blocks(
    blocks: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    measures: dict[str, tuple[Column, str, bool]],
    totals: bool,
) -> DataFrame:
    """Running measures over rows that already carry a block number.

    Blocks are consecutive in (by, order), so a block continues at most one group
    from the block before. Only groups seen in several blocks need a carry: at
    most two rows per block, which bounds what is broadcast.
    """
    key = [F.col(c) for c in by]
    src = blocks.withColumns({f"_in_{n}": e for n, (e, _, _) in measures.items()})
    parts = src.groupBy(*by, BLOCK).agg(
        *[_fold(how, F.col(f"_in_{n}")).alias(f"_p_{n}") for n, (_, how, _) in measures.items()]
    )
    whole = Window.partitionBy(*key)
    earlier = whole.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        parts.withColumn("_pieces", F.count(F.lit(1)).over(whole))
        .select(
            "_pieces",
            *[F.col(c).alias(f"_k_{c}") for c in [*by, BLOCK]],
            *[_fold_parts(how, F.col(f"_p_{n}"), earlier).alias(f"_c_{n}") for n, (_, how, _) in measures.items()],
            *[
                _fold_parts(how, F.col(f"_p_{n}"), whole).alias(f"_t_{n}")
                for n, (_, how, _) in measures.items()
                if totals
            ],
        )
        .where(F.col("_pieces") > 1)
    )
    out = src.join(F.broadcast(carry), _same([*by, BLOCK], "_k_"), "left")
    block = Window.partitionBy(*key, BLOCK)
    result = {}
    for n, (_, how, inclusive) in measures.items():
        upto = block.orderBy(*order).rowsBetween(
            Window.unboundedPreceding, 0 if inclusive else -1
        )
        local, carried = _fold_over(how, F.col(f"_in_{n}"), upto), F.col(f"_c_{n}")
        if how == "moments":
            result[n] = _merged(F.coalesce(carried, _no_rows()), local)
        elif how == "sum":
            zero = F.lit(0).cast(src.schema[f"_in_{n}"].dataType)
            result[n] = F.coalesce(local, zero) + F.coalesce(carried, zero)
        else:
            result[n] = F.greatest(local, carried)
        if totals:
            own = _fold_over(how, F.col(f"_in_{n}"), block)
            result[f"total_{n}"] = F.coalesce(F.col(f"_t_{n}"), own)
    return out.withColumns(result).drop(
        BLOCK,
        "_pieces",
        *[f"_k_{c}" for c in [*by, BLOCK]],
        *[f"_{kind}_{n}" for n in measures for kind in ("in", "c", "t")],
    )


def _in_one_task(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    measures: dict[str, tuple[Column, str, bool]],
    totals: bool,
) -> DataFrame:
    """The same for a table known to be small: plain windows."""
    group = Window.partitionBy(*[F.col(c) for c in by])
    result = {}
    for n, (expr, how, inclusive) in measures.items():
        upto = group.orderBy(*order).rowsBetween(
            Window.unboundedPreceding, 0 if inclusive else -1
        )
        value = _fold_over(how, expr, upto)
        if how == "sum":
            # Typed as the measure: a decimal or a long stays one.
            value = F.coalesce(value, F.lit(0).cast(df.select(expr).schema[0].dataType))
        result[n] = value
        if totals:
            result[f"total_{n}"] = _fold_over(how, expr, group)
    return df.withColumns(result)


def running(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    measures: dict[str, tuple[Column, str, bool]],
    totals: bool = False,
    limit: int = HOT_ROWS,
) -> DataFrame:
    """Running measures per group over any order, however large the group.

    ``measures`` maps an output name to (expression, "sum", "max" or "moments", inclusive);
    moments are a struct of count, mean and summed squared deviation. A table past
    ``limit`` rows is cut into blocks of ``block_rows``.
    With ``totals`` the whole-group value comes along as ``total_<name>``.
    """
    rows = df.count()
    if rows <= limit:
        return _in_one_task(df, by, order, measures, totals)
    blocks = range_blocks(df, by, order, block_count(rows, block_rows(rows, limit)))
    return _in_blocks(blocks, by, order, measures, totals)


def running_by_value(
    df: DataFrame,
    value: str,
    bounds: Sequence[float],
    measures: dict[str, tuple[Column, str, bool]],
    descending: bool = False,
    totals: bool = False,
) -> DataFrame:
    """Running measures over a whole table in the order of one double column.

    ``bounds`` come from ``value_bounds``. Nothing is written.
    """
    order = [F.col(value).desc() if descending else F.col(value)]
    if not bounds:
        return _in_one_task(df, [], order, measures, totals)
    blocks = value_blocks(df, value, bounds, descending)
    return _in_blocks(blocks, [], order, measures, totals)


def numbered(
    df: DataFrame,
    order: Sequence[Column],
    name: str,
    by: Sequence[str] = (),
    limit: int = HOT_ROWS,
) -> DataFrame:
    """1, 2, 3, ... along ``order`` (per group when ``by`` is given)."""
    one = F.lit(1).cast("long")
    return running(df, list(by), order, {name: (one, "sum", True)}, limit=limit)


def value_positions(
    df: DataFrame, value: str, by: Sequence[str] = (), limit: int = HOT_ROWS
) -> DataFrame:
    """Distinct values with the positions they cover in sorted order; NULL and NaN are left out.

    One row per (group, value): it holds positions ``first`` .. ``last`` of
    ``total`` (1-based). Equal values are counted before they are moved.
    """
    counts = (
        df.where(is_number(F.col(value)))
        .groupBy(*by, value)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    measures = {"last": (F.col("n"), "sum", True)}
    if by:
        out = running(counts, list(by), [F.col(value)], measures, totals=True, limit=limit)
    else:
        bounds = value_bounds(df, value, limit)
        out = running_by_value(counts, value, bounds, measures, totals=True)
    return out.select(
        *by,
        value,
        (F.col("last") - F.col("n") + 1).alias("first"),
        "last",
        F.col("total_last").alias("total"),
    )


def exact_median(
    df: DataFrame, value: str, by: Sequence[str], name: str, limit: int = HOT_ROWS
) -> DataFrame:
    """Median per group, for groups too large for ``percentile`` in one task."""
    at = value_positions(df, value, by, limit)
    low, high = F.expr("(total + 1) div 2"), F.expr("total div 2 + 1")
    middle = at.where(
        low.between(F.col("first"), F.col("last")) | high.between(F.col("first"), F.col("last"))
    )
    # One or two values per group are left here.
    return middle.groupBy(*by).agg(((F.min(value) + F.max(value)) / 2).alias(name))


def exact_quantiles(
    df: DataFrame, value: str, probabilities: Sequence[float], limit: int = HOT_ROWS
) -> list[float]:
    """Quantiles with linear interpolation between neighbours, over a whole table."""
    at = value_positions(df, value, limit=limit)
    wanted = [F.floor(F.lit(float(p)) * (F.col("total") - 1)).cast("long") + 1 for p in probabilities]
    neighbours = reduce(
        lambda a, b: a | b,
        [
            (F.col("first") <= w + 1) & (F.col("last") >= w)
            for w in wanted
        ],
    )
    # At most two values per probability reach the driver.
    rows = at.where(neighbours).orderBy(value).collect()
    if not rows:
        return []
    total = rows[0]["total"]

    def value_at(position: int) -> float:
        return next(float(r[value]) for r in rows if r["first"] <= position <= r["last"])

    out = []
    for p in probabilities:
        place = p * (total - 1)
        low = int(place)
        a = value_at(low + 1)
        b = value_at(min(low + 1, total - 1) + 1)
        out.append(a + (b - a) * (place - low))
    return out
