"""Per-card history: velocity windows, recency, rolling and prior statistics.

Cards up to ``HOT_ROWS`` rows share one exchange on the card and one sort. The
few larger cards go through ``operators.ordered``, which spreads one card over
many tasks; both ways give the same numbers.

Row order inside a card is (time, id). Rows without a card get NULL, and 0 as time
since the last transaction. Rows without a time sort last, count as transactions,
and have no velocity.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from txnspark.functions.time import epoch_micros, epoch_seconds
from txnspark.operators import ordered
from txnspark.operators.limbs import Limbs
from txnspark.operators.ordered import HOT_ROWS

HOUR = 3600
DAY = 86400
ROLLING_ROWS = 50
#: Longest card whose prior medians are taken from a growing frame.
SHORT_ROWS = 128

# A window sum is the difference of two running sums, which would lose digits in
# floating point. Amounts are therefore summed exactly, as integer limbs.
# An amount that is NaN or infinite counts as missing, whatever the size of the card:
# it adds nothing to a sum and enters no statistic.


@dataclass(frozen=True)
class Columns:
    card: str = "cc_num"
    time: str = "trans_date_trans_time"
    id: str = "trans_num"
    amount: str = "amt"
    category: str = "category"
    distance: str = "dist_home_merch"


@dataclass(frozen=True)
class Velocity:
    """Transactions or amount of the card inside a time window.

    Modes: ``closed`` is [t-W, t] on whole seconds; ``half_open`` is (t-W, t] on
    the full clock; ``app`` is everything from t-W on, later rows included.
    """

    seconds: int
    what: str = "count"
    mode: str = "closed"
    by_category: bool = False


@dataclass(frozen=True)
class SinceLast:
    """Time since the card's previous transaction; 0 for the first."""

    unit: str = "seconds"  # or "minutes"
    whole_seconds: bool = False


@dataclass(frozen=True)
class PrevTime:
    """Time of the card's previous transaction."""


@dataclass(frozen=True)
class TxnIndex:
    """Running transaction number of the card, from 1."""


@dataclass(frozen=True)
class Rolling:
    """Statistic of the last ``rows`` rows, the current one included."""

    stat: str  # mean, std, median, max
    distance: bool = False
    rows: int = ROLLING_ROWS


@dataclass(frozen=True)
class Prior:
    """Statistic of the amounts of all earlier rows; 0 for the first row."""

    stat: str  # mean, std, median, max


Feature = Velocity | SinceLast | PrevTime | TxnIndex | Rolling | Prior

# Seconds, microseconds and row number in the form the windows need.
_U, _M, _ROW = "_u", "_m", "_row"
_AMOUNT, ALONE = "_amount", "_alone"


def alone(k: Columns = Columns()) -> Column:
    """A group of its own for every row without a card; NULL for the others."""
    own = F.coalesce(F.col(k.id).cast("string"), F.concat(F.lit("row "), F.monotonically_increasing_id()))
    return F.when(F.col(k.card).isNull(), own)


def _over(stat: str, column: Column, frame) -> Column:
    """Statistic of the frame, NULL where it holds no value."""
    if stat == "median":
        # A frame is short; sorting its values beats a percentile's hash table.
        held = F.collect_list(column).over(frame)
        values, size = F.sort_array(held), F.size(held)
        low = F.get(values, F.floor((size - 1) / 2).cast("int"))
        return (low + F.get(values, F.floor(size / 2).cast("int"))) / 2
    return {"mean": F.avg, "std": F.stddev_samp, "max": F.max}[stat](column).over(frame)


def _prepared(df: DataFrame, k: Columns) -> DataFrame:
    out = df.withColumns({_U: epoch_seconds(F.col(k.time)), _M: epoch_micros(F.col(k.time))})
    if k.amount not in df.columns:
        return out
    amount = F.col(k.amount).cast("double")
    usable = ~F.isnan(amount) & (F.abs(amount) < F.lit(math.inf))
    return out.withColumn(_AMOUNT, F.when(usable, amount))


def _amount(k: Columns) -> Column:
    """The amount, 0 where it is missing."""
    return F.coalesce(F.col(k.amount), F.lit(0.0))


def _row_order(k: Columns) -> list[Column]:
    return [F.col(_U).asc_nulls_last(), F.col(_M).asc_nulls_last(), F.col(k.id).asc()]


def _since(previous: Column, feature: SinceLast) -> Column:
    if feature.whole_seconds:
        gap = (F.col(_U) - previous).cast("double")
    else:
        gap = (F.col(_M) - previous) / 1_000_000
    if feature.unit == "minutes":
        gap = gap / 60
    return F.coalesce(gap, F.lit(0.0))


def add_history(
    df: DataFrame,
    want: Mapping[str, Feature],
    k: Columns = Columns(),
    hot_rows: int = HOT_ROWS,
    short_rows: int = SHORT_ROWS,
) -> DataFrame:
    """``df`` with one column per wanted feature; rows and keys are untouched."""
    ready = _prepared(df, k)
    if _AMOUNT in ready.columns:
        k = replace(k, amount=_AMOUNT)
    usual, hot = ordered.split_hot(ready, [k.card], hot_rows)
    out = _plain(usual, want, k, hot_rows, short_rows)
    if hot is not None:
        out = out.unionByName(_spread(hot, want, k, hot_rows), allowMissingColumns=True)
    return out.select(*df.columns, *want)


# ---------------------------------------------------------------- plain cards


def _is_sum(f: Feature) -> bool:
    return isinstance(f, Velocity) and f.what != "count"


def _plain(df: DataFrame, want: Mapping[str, Feature], k: Columns, hot_rows: int, short_rows: int) -> DataFrame:
    """Windows partitioned by card. Rows without a card are groups of their own."""
    out = df
    medians = [n for n, f in want.items() if _is_prior_median(f)]
    sums = {n: f for n, f in want.items() if _is_sum(f)}
    limbs = Limbs.of(df, k.amount, hot_rows) if sums else None
    parts = {n: [f"_{n}_{i}" for i in range(limbs.count)] for n in sums}
    # A caller that has grouped by card before hands its column through: one exchange.
    if ALONE not in out.columns:
        out = out.withColumn(ALONE, alone(k))
    rest = {n: f for n, f in want.items() if not _is_prior_median(f)}
    by_card = [f for f in rest.items() if not getattr(f[1], "by_category", False)]
    by_category = [f for f in rest.items() if getattr(f[1], "by_category", False)]
    has_card = F.col(k.card).isNotNull()
    # Card windows come first: their exchange on the card also serves the
    # narrower (card, category) groups.
    card = Window.partitionBy(k.card, ALONE)
    known = has_card & F.col(k.category).isNotNull() if by_category else has_card
    narrow = Window.partitionBy(k.card, ALONE, k.category)
    for group, condition, features in ((card, has_card, by_card), (narrow, known, by_category)):
        add = {}
        for n, f in features:
            if n in sums:
                add |= dict(zip(parts[n], _plain_velocity(f, group, k, limbs.split(_amount(k))), strict=True))
            else:
                missing = F.lit(0.0) if isinstance(f, SinceLast) else F.lit(None)
                add[n] = F.when(condition, _plain_expr(f, group, k)).otherwise(missing)
        joined = {n: F.when(condition, limbs.join([F.col(c) for c in parts[n]])) for n, _ in features if n in sums}
        out = out.withColumns(add).withColumns(joined).drop(*[c for n in joined for c in parts[n]])
    return _prior_median(out, medians, k, short_rows) if medians else out


def _plain_expr(f: Feature, group, k: Columns) -> Column:
    ordered_rows = group.orderBy(*_row_order(k))
    match f:
        case TxnIndex():
            return F.row_number().over(ordered_rows)
        case SinceLast():
            clock = _U if f.whole_seconds else _M
            return _since(F.lag(clock).over(ordered_rows), f)
        case PrevTime():
            return F.lag(k.time).over(ordered_rows)
        case Rolling():
            frame = ordered_rows.rowsBetween(1 - f.rows, 0)
            value = _over(f.stat, F.col(k.distance if f.distance else k.amount), frame)
            return F.coalesce(value, F.lit(0.0)) if f.stat == "std" else value
        case Prior():
            frame = ordered_rows.rowsBetween(Window.unboundedPreceding, -1)
            return F.coalesce(_over(f.stat, F.col(k.amount), frame), F.lit(0.0))
        case Velocity():
            return _plain_velocity(f, group, k, [F.lit(1)])[0]
    raise TypeError(f"unknown feature {f!r}")


def _is_prior_median(f: Feature) -> bool:
    return isinstance(f, Prior) and f.stat == "median"


#: Values told apart in one round of the search for a median.
DIGITS = 16


def _prior_median(df: DataFrame, names: Sequence[str], k: Columns, short_rows: int) -> DataFrame:
    """Median of all earlier amounts of the card, by narrowing ranks, in windows alone.

    A growing frame sorts its whole content again for every row, which is the quickest
    way only if no card has more than ``short_rows`` rows. Otherwise amounts
    get their rank in the card, and each row asks for the rank in the middle of its
    predecessors. Rows and questions stand side by side in the card's partition. A round
    counts, along time, how many predecessors fall under each digit of the rank, which
    picks the next digit of the answer; a question then goes on among the ranks that
    begin like it. All windows begin with the card, so its one exchange serves them.
    """
    group, valued = [F.col(k.card), F.col(ALONE)], F.col(k.amount).isNotNull()
    largest = df.where(F.col(k.card).isNotNull() & valued).groupBy(*group).count().agg(F.max("count")).first()[0] or 1
    if largest <= short_rows:
        frame = Window.partitionBy(*group).orderBy(*_row_order(k)).rowsBetween(Window.unboundedPreceding, -1)
        median = F.when(F.col(k.card).isNotNull(), F.coalesce(_over("median", F.col(k.amount), frame), F.lit(0.0)))
        return df.withColumns({n: median for n in names})
    rounds = 1
    while DIGITS**rounds < largest:
        rounds += 1
    in_time = Window.partitionBy(*group).orderBy(*_row_order(k))
    by_value = Window.partitionBy(*group).orderBy(F.col(k.amount).asc_nulls_last(), F.col(_ROW))
    before = in_time.rowsBetween(Window.unboundedPreceding, -1)
    kept = [F.col(c) for c in df.columns if c not in (k.card, ALONE)]
    rows = df.withColumns({_ROW: F.row_number().over(in_time), "_before": F.count(k.amount).over(before)})
    rows = rows.withColumn("_place", F.when(valued, F.row_number().over(by_value) - 1))
    rows = rows.select(*group, _ROW, "_before", "_place", F.col(k.amount).alias("_value"), F.struct(*kept).alias("_kept"))
    half = F.expr("_before div 2")
    low = F.when(F.col("_before") > 0, F.expr("(_before + 1) div 2"))
    high = F.when((F.col("_before") > 0) & (F.col("_before") % 2 == 0), half + 1)
    # Side -1 is the row itself; 0 and 1 ask for the lower and, if it is another one, the upper middle.
    sides = F.array(*[F.struct(F.lit(i).alias("side"), a.cast("long").alias("k")) for i, a in ((-1, F.lit(None)), (0, low), (1, high))])
    asked = F.filter(sides, lambda s: (s["side"] < 0) | s["k"].isNotNull())
    both = rows.withColumn("_ask", F.explode(asked))
    item = F.col("_ask.side") < 0
    both = both.select(
        *group, _ROW, F.col("_ask.side").alias("_side"), F.col("_ask.k").alias("_k"), F.lit(0).cast("long").alias("_node"),
        *[F.when(item, F.col(c)).alias(c) for c in ("_place", "_value", "_kept")],
    )
    # Counts of one card fit ``bits``; several share a long, and one sum counts them all.
    bits = int(largest).bit_length()
    each, mask = 62 // bits, (1 << bits) - 1
    packed = {
        f"_d{i // each}": [sum(1 << (bits * (d - i)) for d in range(i, min(i + each, DIGITS - 1)) if d >= v) for v in range(DIGITS)]
        for i in range(0, DIGITS - 1, each)
    }
    for step in range(rounds - 1, -1, -1):
        size = DIGITS**step
        # A question at a row comes before the row's own amount: predecessors only.
        along = Window.partitionBy(*group, "_node").orderBy(_ROW, F.col("_side").desc())
        upto = along.rowsBetween(Window.unboundedPreceding, 0)
        digit = F.expr(f"(_place div {size}) % {DIGITS}")
        both = both.withColumns({c: F.sum(F.get(F.array(*map(F.lit, units)), digit.cast("int"))).over(upto) for c, units in packed.items()})
        under = [F.coalesce(F.shiftright(f"_d{d // each}", bits * (d % each)), F.lit(0)).bitwiseAND(mask) for d in range(DIGITS - 1)]
        chosen = reduce(lambda a, b: a + b, [(c < F.col("_k")).cast("int") for c in under])
        both = both.withColumn("_next", chosen)
        below = F.array(F.lit(0).cast("long"), *under)
        both = both.withColumns({
            "_k": F.col("_k") - F.get(below, F.col("_next")),
            "_node": F.when(F.col("_side") < 0, F.expr(f"_place div {size}")).otherwise(F.col("_node") * DIGITS + F.col("_next")),
        }).drop("_next", *packed)
    found = F.max("_value").over(Window.partitionBy(*group, "_node"))
    both = both.withColumn("_found", F.when(F.col("_side") >= 0, found))
    # The questions' answers go back to the row that asked.
    middle = F.avg("_found").over(Window.partitionBy(*group, _ROW))
    done = both.withColumn("_middle", middle).where("_side < 0")
    median = F.when(F.col(k.card).isNotNull(), F.coalesce("_middle", F.lit(0.0)))
    return done.select(*group, "_kept.*", *[median.alias(n) for n in names])


def _plain_velocity(f: Velocity, group, k: Columns, units: list[Column]) -> list[Column]:
    """Sums of the units so far minus those that have left the window: two running totals.

    Cost per row does not grow with the number of rows in the window.
    """
    if f.mode == "half_open":
        left = group.orderBy(F.col(_M).asc_nulls_last()).rangeBetween(
            Window.unboundedPreceding, -f.seconds * 1_000_000
        )
    else:
        # The leading key of the row order, so that one sort serves both frames.
        left = group.orderBy(F.col(_U).asc_nulls_last()).rangeBetween(
            Window.unboundedPreceding, -f.seconds - 1
        )
    known = F.col(_U).isNotNull()
    rows = group.orderBy(*_row_order(k)).rowsBetween(Window.unboundedPreceding, 0)
    entered = group if f.mode == "app" else rows

    def inside(unit: Column) -> Column:
        # The condition keeps rows without a time out of both totals.
        counted = F.when(known, unit)
        return F.sum(counted).over(entered) - F.coalesce(F.sum(counted).over(left), F.lit(0))

    return [F.when(known, inside(unit)) for unit in units]


# ------------------------------------------------------------------ hot cards


def _spread(
    df: DataFrame, want: Mapping[str, Feature], k: Columns, hot_rows: int
) -> DataFrame:
    out = df
    sequence = {n: f for n, f in want.items() if isinstance(f, SinceLast | PrevTime | TxnIndex)}
    prior = {n: f for n, f in want.items() if isinstance(f, Prior)}
    rolling = {n: f for n, f in want.items() if isinstance(f, Rolling)}
    median = {n for n, f in prior.items() if f.stat == "median"}
    if sequence or prior or rolling:
        out = _spread_sequence(out, sequence, prior, k, hot_rows)
    if rolling:
        out = _spread_rolling(out, rolling, k, max(hot_rows, 2 * ROLLING_ROWS))
    for name in median:
        out = _spread_prior_median(out, name, k, hot_rows)
    out = out.drop(_ROW)
    velocity = {n: f for n, f in want.items() if isinstance(f, Velocity)}
    for mode, by_category in sorted({(f.mode, f.by_category) for f in velocity.values()}):
        same = {
            n: f for n, f in velocity.items() if (f.mode, f.by_category) == (mode, by_category)
        }
        out = _spread_velocity(out, same, mode, by_category, k, hot_rows)
    return out


def _spread_sequence(
    df: DataFrame,
    sequence: Mapping[str, Feature],
    prior: Mapping[str, Prior],
    k: Columns,
    limit: int,
) -> DataFrame:
    """Position, previous time and prior statistics from running totals."""
    one = F.lit(1).cast("long")
    measures = {
        _ROW: (one, "sum", True),
        # The order is by time, so the latest earlier time is the previous one.
        "_prev_u": (F.col(_U), "max", False),
        "_prev_m": (F.col(_M), "max", False),
        "_prev_t": (F.col(k.time), "max", False),
        "_timeless": (F.col(k.time).isNull().cast("long"), "sum", False),
    }
    limbs = Limbs.of(df, k.amount) if any(f.stat == "mean" for f in prior.values()) else None
    sums = {f"_sum{i}": part for i, part in enumerate(limbs.split(_amount(k)))} if limbs else {}
    if prior:
        measures |= {"_seen": (F.col(k.amount), "moments", False), "_top": (F.col(k.amount), "max", False)}
        measures |= {c: (part, "sum", False) for c, part in sums.items()}
    out = ordered.running(df, [k.card], _row_order(k), measures, limit=limit)
    add = {}
    for name, f in sequence.items():
        match f:
            case TxnIndex():
                add[name] = F.col(_ROW).cast("int")
            case PrevTime():
                # Rows without a time come last; after one, the previous time is unknown.
                add[name] = F.when(F.col("_timeless") == 0, F.col("_prev_t"))
            case SinceLast():
                add[name] = _since(F.col("_prev_u" if f.whole_seconds else "_prev_m"), f)
    n = F.col("_seen.n")
    values = {
        "mean": F.when(n > 0, limbs.join([F.col(c) for c in sums]) / n) if limbs else None,
        "std": F.when(n > 1, F.sqrt(F.col("_seen.m2") / (n - 1))),
        "max": F.col("_top"),
    }
    for name, f in prior.items():
        if f.stat != "median":
            add[name] = F.coalesce(values[f.stat], F.lit(0.0))
    return out.withColumns(add).drop("_prev_u", "_prev_m", "_prev_t", "_timeless", "_seen", "_top", *sums)


def _spread_rolling(
    df: DataFrame, rolling: Mapping[str, Rolling], k: Columns, chunk: int
) -> DataFrame:
    """Fixed-size chunks of the card's rows, each with the rows it looks back on."""
    back = max(f.rows for f in rolling.values()) - 1
    at = F.col(_ROW) - 1
    own = F.floor(at / chunk).cast("long")
    near_end = at % chunk >= chunk - back
    places = F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))
    copies = df.withColumn("_chunk", F.explode(places))
    group = Window.partitionBy(k.card, "_chunk").orderBy(_ROW)
    add = {}
    for name, f in rolling.items():
        column = F.col(k.distance if f.distance else k.amount)
        value = _over(f.stat, column, group.rowsBetween(1 - f.rows, 0))
        add[name] = F.coalesce(value, F.lit(0.0)) if f.stat == "std" else value
    return copies.withColumns(add).where(F.col("_chunk") == own).drop("_chunk")


def _spread_velocity(
    df: DataFrame,
    want: Mapping[str, Velocity],
    mode: str,
    by_category: bool,
    k: Columns,
    limit: int,
) -> DataFrame:
    """Sweep over time: each row enters at its time and leaves one window later.

    The window value is then a running total over entries and departures, which
    needs no range frame and splits anywhere.
    """
    by = [k.card, k.category] if by_category else [k.card]
    clock, tick = (_M, 1_000_000) if mode == "half_open" else (_U, 1)
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*by, clock]])
    windows = sorted({f.seconds for f in want.values()})
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    # A hot card may have any number of rows.
    limbs = Limbs.of(df, k.amount) if any(_is_sum(f) for f in want.values()) else None
    money = limbs.split(_amount(k)) if limbs else []
    enters = 0.0 if mode == "app" else 1.0
    # At equal times: half_open lets rows leave before others enter, the others after.
    entry_rank, exit_rank = (1, 0) if mode == "half_open" else (0, 1)
    payload = F.struct(*[F.col(c) for c in df.columns])
    rows = df.where(known)

    def event(at: Column, rank: int, row: Column, counts, sums) -> DataFrame:
        return rows.select(
            *by,
            at.alias("_at"),
            F.lit(rank).alias("_rank"),
            F.col(_M).alias("_tie"),
            F.col(k.id).alias("_id"),
            row.alias("_payload"),
            *[c.alias(f"_n{w}") for w, c in zip(windows, counts, strict=True)],
            *[s.alias(f"_s{w}_{i}") for w, limb in zip(windows, sums, strict=True) for i, s in enumerate(limb)],
        )

    events = event(
        F.col(clock),
        entry_rank,
        payload,
        [one if enters else zero for _ in windows],
        [money if enters else [zero] * len(money) for _ in windows],
    )
    for width in windows:
        events = events.unionByName(
            event(
                F.col(clock) + width * tick,
                exit_rank,
                F.when(F.lit(False), payload),
                [-one if w == width else zero for w in windows],
                [[-m if w == width else zero for m in money] for w in windows],
            )
        )
    places = range(len(money))
    measures = {f"_run_n{w}": (F.col(f"_n{w}"), "sum", True) for w in windows}
    measures |= {f"_run_s{w}_{i}": (F.col(f"_s{w}_{i}"), "sum", True) for w in windows for i in places}
    order = [F.col("_at"), F.col("_rank"), F.col("_tie"), F.col("_id")]
    swept = ordered.running(events, by, order, measures, limit=limit).where(F.col("_payload").isNotNull())
    if mode == "app":
        whole = rows.groupBy(*by).agg(
            F.count(F.lit(1)).alias("_all_n"), *[F.sum(m).alias(f"_all_s{i}") for i, m in enumerate(money)]
        )
        swept = swept.join(ordered.broadcast_small(whole), by)
    else:
        swept = swept.withColumns({"_all_n": zero, **{f"_all_s{i}": zero for i in places}})
    add = {}
    for name, f in want.items():
        if f.what == "count":
            add[name] = F.col("_all_n") + F.col(f"_run_n{f.seconds}")
        else:
            add[name] = limbs.join([F.col(f"_all_s{i}") + F.col(f"_run_s{f.seconds}_{i}") for i in places])
    done = swept.withColumns(add).select("_payload.*", *want)
    rest = df.where(~known).withColumns(
        {n: F.lit(None).cast("long" if f.what == "count" else "double") for n, f in want.items()}
    )
    return done.unionByName(rest)


def _spread_prior_median(df: DataFrame, name: str, k: Columns, limit: int) -> DataFrame:
    """Median of all earlier amounts, piece by piece of the card's rows.

    A piece of ``size`` rows moves the middle of the amounts before it by at most half as
    many places either way. Of those amounts it takes the ones so near the middle, and the
    number of those below; with its own rows that is all its medians depend on. Amounts
    have their place in value order, and counts by ranges of places tell, for each piece,
    where the middle of the amounts before it is. Every piece takes about as many of them
    as it has rows, however long the card.
    """
    card = [k.card]
    # Written, so that every branch below sees the same numbers on rows that tie.
    rows = ordered.written(df, "rows")
    size = ordered.block_rows(rows.count(), limit)
    width = max(1, size // 4)
    own = rows.select(k.card, F.expr(f"({_ROW} - 1) div {size}").alias("_piece"), _ROW, F.col(k.amount).alias("_v"))
    place = ordered.numbered(
        own.where(F.col("_v").isNotNull()), [F.col("_v"), F.col(_ROW)], "_place", by=card, limit=limit
    )
    place = ordered.written(place.withColumn("_range", F.expr(f"(_place - 1) div {width}")).drop("_place"), "places")
    cells = place.groupBy(*card, "_range", "_piece").agg(F.count(F.lit(1)).alias("_n"))
    last = own.groupBy(*card).agg(F.max("_piece").alias("_last")).where("_last > 0")
    pieces = place.select(*card, "_range").distinct().join(last, k.card)
    pieces = pieces.select(*card, "_range", F.explode(F.expr("sequence(1L, _last)")).alias("_piece"), F.lit(0).cast("long").alias("_n"))
    # Along the pieces: what each range holds of the pieces before. A piece sorts before its own count.
    in_time = Window.partitionBy(*card, "_range").orderBy("_piece", F.col("_is_cell"))
    upto = F.sum("_n").over(in_time.rowsBetween(Window.unboundedPreceding, 0))
    held = pieces.withColumn("_is_cell", F.lit(False)).unionByName(cells.withColumn("_is_cell", F.lit(True)))
    held = held.withColumn("_n", upto).where(~F.col("_is_cell") & (F.col("_n") > 0))
    whole = Window.partitionBy(*card, "_piece")
    below = F.sum("_n").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    held = held.withColumns({"_below": F.coalesce(below, F.lit(0).cast("long")), "_before": F.sum("_n").over(whole)})
    near = (F.col("_below") + F.col("_n") >= F.expr(f"_before div 2 - {size // 2 + 2}")) & (
        F.col("_below") <= F.expr(f"_before div 2 + {size // 2 + 2}")
    )
    near = held.where(near).select(*card, "_range", F.col("_piece").alias("_for"), "_below", "_before")
    earlier = place.join(ordered.broadcast_small(near), [k.card, "_range"]).where(F.col("_piece") < F.col("_for"))
    earlier = earlier.select(*card, F.col("_for").alias("_piece"), F.lit(None).cast("long").alias(_ROW), "_v", "_below", "_before")
    none = F.lit(None).cast("long")
    both = earlier.unionByName(own.withColumns({"_below": none, "_before": none}))
    schema = StructType([StructField(k.card, df.schema[k.card].dataType), StructField(_ROW, LongType()), StructField(name, DoubleType())])
    answers = both.groupBy(*card, "_piece").applyInArrow(_piece_medians(k.card, name), schema)
    joined = rows.join(answers, [k.card, _ROW], "left")
    return joined.withColumn(name, F.coalesce(F.col(name), F.lit(0.0)))


def _piece_medians(card: str, name: str):
    """For ``applyInArrow``: the median of all amounts before each row of a piece, NULL if there is none."""

    def medians(piece):
        # Imported here: the function travels to the workers, which need nothing of this package.
        import heapq

        import pyarrow as pa
        import pyarrow.compute as pc

        is_own = pc.is_valid(piece["_row"])
        own = piece.filter(is_own).sort_by("_row")
        earlier = piece.filter(pc.invert(is_own)).sort_by("_v")
        n = pc.max(earlier["_before"]).as_py() or 0
        under = pc.min(earlier["_below"]).as_py() or 0
        values = earlier["_v"].to_pylist()
        # Two heaps meet in the middle; the lower one holds negatives, and one more if n is odd.
        # Amounts further off are in neither: this piece's rows do not bring them to the top.
        half = (n + 1) // 2 - under
        low, high = [-v for v in reversed(values[:half])], values[half:]
        found = []
        for v in own["_v"].to_pylist():
            if n == 0:
                found.append(None)
            elif n % 2:
                found.append(-low[0])
            else:
                found.append((high[0] - low[0]) / 2)
            if v is None:
                continue
            if n % 2:
                heapq.heappush(high, -heapq.heappushpop(low, -v))
            else:
                heapq.heappush(low, -heapq.heappushpop(high, v))
            n += 1
        return pa.table({card: own[card], "_row": own["_row"], name: pa.array(found, pa.float64())})

    return medians
