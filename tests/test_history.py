"""History features: hand-made cases, brute force, and hot cards against plain ones."""

import bisect
import math
import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.compare import close
from txnspark.operators import ordered
from txnspark.operators.cards import STATS, add_card_totals, card_stats, join_card_stats
from txnspark.operators.history import (
    DAY,
    HOUR,
    PrevTime,
    Prior,
    Rolling,
    SinceLast,
    TxnIndex,
    Velocity,
    add_history,
)

START = datetime(2024, 1, 1)
SCHEMA = (
    "trans_num long, cc_num long, trans_date_trans_time timestamp_ntz, amt double, "
    "category string, dist_home_merch double"
)


def table(spark, rows):
    return spark.createDataFrame(
        [
            (i, card, None if s is None else START + timedelta(seconds=s), amt, cat, 1.0 * i)
            for i, (card, s, amt, cat) in enumerate(rows)
        ],
        SCHEMA,
    )


def by_id(df, *names):
    return {r["trans_num"]: tuple(r[n] for n in names) for r in df.collect()}


def test_exact_window_boundary(spark):
    df = table(spark, [(1, 0, 1.0, "a"), (1, 3600, 2.0, "a")])
    out = add_history(
        df, {"c": Velocity(HOUR), "h": Velocity(HOUR, mode="half_open"), "p": Velocity(HOUR, mode="app")}
    )
    assert by_id(out, "c", "h", "p")[1] == (2, 1, 2)
    assert by_id(out, "p")[0] == (2,)


def test_tied_times(spark):
    times, amounts = [0, 0, 3600, 3600, 3601, 7200], [1, 2, 4, 8, 16, 32]
    df = table(spark, [(1, t, float(a), "a") for t, a in zip(times, amounts)])
    out = by_id(add_history(df, {"c": Velocity(HOUR), "s": Velocity(HOUR, "sum")}), "c", "s")
    assert [out[i] for i in range(6)] == [(1, 1), (2, 3), (3, 7), (4, 15), (3, 28), (4, 60)]


def test_single_row_card(spark):
    df = table(spark, [(1, 5, 9.0, "a")])
    out = add_history(
        df, {"std": Rolling("std"), "gap": SinceLast(), "n": TxnIndex(), "c": Velocity(DAY)}
    )
    assert by_id(out, "std", "gap", "n", "c")[0] == (0.0, 0.0, 1, 1)


def test_missing_card_time_and_amount(spark):
    df = table(
        spark,
        [(None, 0, 1.0, "a"), (None, 1, 1.0, "a"), (1, 0, 5.0, "a"), (1, None, 7.0, "a"), (1, 9, None, None)],
    )
    want = {
        "c": Velocity(DAY),
        "s": Velocity(DAY, "sum"),
        "k": Velocity(DAY, by_category=True),
        "n": TxnIndex(),
        "m": Prior("median"),
    }
    for hot_rows in (10, 1):
        out = by_id(add_history(df, want, hot_rows=hot_rows), *want)
        assert out[0] == out[1] == (None, None, None, None, None)
        assert out[2] == (1, 5.0, 1, 1, 0.0)
        assert out[3] == (None, None, None, 3, 5.0)
        assert out[4] == (2, 5.0, None, 2, 5.0)


def random_rows(seed, n=160, cards=4):
    """One card holds half of the rows; many times and amounts repeat."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        card = 1 if rng.random() < 0.5 else rng.randrange(2, cards + 2)
        seconds = rng.choice([rng.randrange(0, 3 * DAY), 600 * rng.randrange(0, 40)])
        seconds += rng.choice([0, 0, 0.25, 0.5])
        rows.append((card, seconds, rng.randrange(0, 50) / 4, rng.choice("abc")))
    return rows


def brute(rows):
    """Reference values straight from the definitions."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0], rows[i][1], i))
    out = {}
    seen = {}
    for i in order:
        card, s, amt, cat = rows[i]
        past = seen.setdefault(card, [])
        mine = past + [i]
        closed = [j for j in mine if int(s) - int(rows[j][1]) <= HOUR]
        half = [j for j in mine if s - rows[j][1] < DAY]
        app = [j for j in range(len(rows)) if rows[j][0] == card and int(s) - int(rows[j][1]) <= HOUR]
        in_cat = [j for j in mine if rows[j][3] == cat and int(s) - int(rows[j][1]) <= DAY]
        last = [rows[j][2] for j in mine[-50:]]
        before = [rows[j][2] for j in past]
        out[i] = {
            "closed": len(closed),
            "closed_sum": sum(rows[j][2] for j in closed),
            "half": len(half),
            "half_sum": sum(rows[j][2] for j in half),
            "app": len(app),
            "app_sum": sum(rows[j][2] for j in app),
            "cat": len(in_cat),
            "gap": s - rows[past[-1]][1] if past else 0.0,
            "index": len(mine),
            "r_mean": statistics.mean(last),
            "r_std": statistics.stdev(last) if len(last) > 1 else 0.0,
            "r_median": statistics.median(last),
            "r_max": max(last),
            "p_mean": statistics.mean(before) if before else 0.0,
            "p_std": statistics.stdev(before) if len(before) > 1 else 0.0,
            "p_median": statistics.median(before) if before else 0.0,
            "p_max": max(before) if before else 0.0,
        }
        past.append(i)
    return out


WANT = {
    "closed": Velocity(HOUR),
    "closed_sum": Velocity(HOUR, "sum"),
    "half": Velocity(DAY, mode="half_open"),
    "half_sum": Velocity(DAY, "sum", "half_open"),
    "app": Velocity(HOUR, mode="app"),
    "app_sum": Velocity(HOUR, "sum", "app"),
    "cat": Velocity(DAY, by_category=True),
    "gap": SinceLast(),
    "index": TxnIndex(),
    "r_mean": Rolling("mean"),
    "r_std": Rolling("std"),
    "r_median": Rolling("median"),
    "r_max": Rolling("max"),
    "p_mean": Prior("mean"),
    "p_std": Prior("std"),
    "p_median": Prior("median"),
    "p_max": Prior("max"),
}


@pytest.mark.parametrize(("hot_rows", "short_rows"), [(1_000_000, 1000), (1_000_000, 0), (30, 1000)])
def test_against_brute_force(spark, hot_rows, short_rows):
    rows = random_rows(7)
    want = brute(rows)
    got = by_id(add_history(table(spark, rows), WANT, hot_rows=hot_rows, short_rows=short_rows), *WANT)
    assert len(got) == len(rows)
    for i, values in got.items():
        for name, value in zip(WANT, values):
            assert close(value, want[i][name]), (i, name, value, want[i][name])


def test_previous_time_of_hot_card(spark):
    rows = [*random_rows(3), (1, None, 1.0, "a"), (1, None, 2.0, "a"), (None, 5, 1.0, "a")]
    df = table(spark, rows)
    want = {"t": PrevTime(), "g": SinceLast("minutes"), "w": SinceLast(whole_seconds=True)}
    plain, spread = by_id(add_history(df, want), *want), by_id(add_history(df, want, hot_rows=20), *want)
    assert plain == spread
    assert plain[160][0] is not None and plain[161][0] is None
    assert plain[161][1] == 0.0 and plain[162] == (None, 0.0, 0.0)


def test_card_statistics_of_hot_card(spark):
    df = table(spark, [*random_rows(5), *[(None, 1, float(a), "a") for a in range(30)]])
    df = df.withColumn("amt", F.when(F.col("trans_num") % 9 != 0, F.col("amt")))
    for fn in (join_card_stats, add_card_totals):
        a = by_id(fn(df), *STATS)
        b = by_id(fn(df, hot_rows=25), *STATS)
        assert all(close(x, y) for i in a for x, y in zip(a[i], b[i], strict=True))
    a = {r["cc_num"]: r for r in card_stats(df).collect()}
    b = {r["cc_num"]: r for r in card_stats(df, hot_rows=25).collect()}
    assert a.keys() == b.keys() and None not in a
    assert all(close(a[c][s], b[c][s]) for c in a for s in STATS)


def test_prior_median_of_hot_cards_in_pieces(spark, monkeypatch):
    """Values that drift or jump move the middle as far as they can; the work stays a few blocks."""
    blocks, cut = [], ordered.range_blocks
    monkeypatch.setattr(ordered, "range_blocks", lambda df, by, order, n: blocks.append(n) or cut(df, by, order, n))
    rng, n = random.Random(5), 600
    shapes = {
        1: [float(i) for i in range(n)],
        2: [float(-i) for i in range(n)],
        3: [1e6 - i if i % 2 else float(i) for i in range(n)],
        4: [7.0] * n,
        5: [rng.choice([None, float("nan"), 0.0, -1.5, rng.gauss(0, 50)]) for _ in range(n)],
        6: [None] * n,
        7: [rng.random() + (100 if i > n // 2 else 0) for i in range(n)],
    }
    rows = [(f"{card}-{i:04}", card, i, v) for card, values in shapes.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "trans_num string, cc_num long, at long, amt double")
    df = df.withColumn("trans_date_trans_time", F.timestamp_seconds("at"))
    out = add_history(df, {"m": Prior("median")}, hot_rows=20).select("trans_num", "m").collect()
    got, expect = dict(map(tuple, out)), {}
    for card, values in shapes.items():
        seen = []
        for i, v in enumerate(values):
            expect[f"{card}-{i:04}"] = statistics.median(seen) if seen else 0.0
            if v is not None and not math.isnan(v):
                bisect.insort(seen, v)
    assert len(out) == len(rows) and got == expect
    # Positions in time, and places in value order: the card's rows are cut twice, however long it is.
    assert len(blocks) == 2 and max(blocks) <= 65
