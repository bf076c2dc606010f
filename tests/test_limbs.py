"""Exact sums: limbs of any range, and window sums and statistics of amounts without a cap."""

import math
import random
import statistics
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tests.compare import close
from tests.test_history import by_id, table
from txnspark.operators.history import DAY, HOUR, Prior, Rolling, Velocity, add_history
from txnspark.operators.limbs import Limbs

RANGES = {
    "cents": lambda r: r.randrange(-10**7, 10**7) / 100,
    "tiny and huge": lambda r: r.choice([1e-10, 1e30, -1e30, 2e12, 1e15, 0.1, 1 / 3]) * r.random(),
    "every double": lambda r: math.ldexp(r.random() - 0.5, r.randrange(-1060, 1010)),
    "lowest": lambda r: r.choice([5e-324, 1e-320, 2.2e-308, 0.0]),
    "highest": lambda r: r.choice([8.9e307, -8.9e307, 1.0]),
}


@pytest.mark.parametrize("name", RANGES)
@pytest.mark.parametrize("rows", [None, 100, 1_000_000])
def test_sums_are_exact(spark, name, rows):
    rng = random.Random(name)
    values = [RANGES[name](rng) for _ in range(400)]
    df = spark.createDataFrame([(i % 7, v) for i, v in enumerate(values)] + [(0, None), (1, math.inf), (2, math.nan)], "g int, x double")
    limbs = Limbs.of(df, "x", rows)
    held = df.where(F.abs("x") < math.inf)
    parts = limbs.split(F.col("x"))
    sums = held.groupBy("g").agg(*[F.sum(p).alias(f"s{i}") for i, p in enumerate(parts)])
    got = dict(sums.select("g", limbs.join([F.col(f"s{i}") for i in range(limbs.count)])).collect())
    for g in range(7):
        exact = sum(map(Fraction, values[g::7]), Fraction(0))
        if abs(exact) < Fraction(1.7e308):
            assert math.isclose(got[g], float(exact), rel_tol=4e-16, abs_tol=5e-324), (g, got[g], float(exact))


def test_no_value(spark):
    df = spark.createDataFrame([(None,), (math.nan,)], "x double")
    limbs = Limbs.of(df, "x", 10)
    assert limbs.count == 1 and df.where("x is null").select(limbs.join(limbs.split(F.coalesce("x", F.lit(0.0))))).first()[0] == 0.0


def amounts(seed):
    rng = random.Random(seed)
    pool = [1e-10, 1e30, -1e30, 2e12, 1e15, 0.01, 19.99, None, math.nan, math.inf, -math.inf]
    return [(1 + i % 2, rng.randrange(0, 2 * DAY), rng.choice(pool), rng.choice("ab")) for i in range(120)]


@pytest.mark.parametrize("hot_rows", [1_000_000, 25])
def test_window_sums_of_any_amount(spark, hot_rows):
    rows = amounts(11)
    want = {"h": Velocity(HOUR, "sum"), "d": Velocity(DAY, "sum", "half_open"), "a": Velocity(DAY, "sum", "app"), "c": Velocity(DAY, "sum", by_category=True)}
    got = by_id(add_history(table(spark, rows), want, hot_rows=hot_rows), *want)
    usable = [Fraction(a) if a is not None and math.isfinite(a) else Fraction(0) for _, _, a, _ in rows]
    for i, (card, s, _, cat) in enumerate(rows):
        before = [j for j, r in enumerate(rows) if r[0] == card and (r[1], j) <= (s, i)]
        after = [j for j, r in enumerate(rows) if r[0] == card]
        exact = [
            sum((usable[j] for j in before if s - rows[j][1] <= HOUR), Fraction(0)),
            sum((usable[j] for j in before if s - rows[j][1] < DAY), Fraction(0)),
            sum((usable[j] for j in after if s - rows[j][1] <= DAY), Fraction(0)),
            sum((usable[j] for j in before if s - rows[j][1] <= DAY and rows[j][3] == cat), Fraction(0)),
        ]
        assert got[i] == tuple(pytest.approx(float(e), rel=4e-16, abs=0) for e in exact), i


@pytest.mark.parametrize("hot_rows", [1_000_000, 25])
def test_statistics_of_large_amounts(spark, hot_rows):
    rows = [(1, i, a, "a") for i, a in enumerate([2e12, 3e15, math.nan, 1e30, None, 5e12, math.inf] * 6)]
    want = {"pm": Prior("mean"), "pd": Prior("median"), "px": Prior("max"), "rm": Rolling("mean"), "rd": Rolling("median"), "rx": Rolling("max")}
    got = by_id(add_history(table(spark, rows), want, hot_rows=hot_rows), *want)
    held: list[float] = []
    for i, (_, _, a, _) in enumerate(rows):
        prior = [statistics.mean(held), statistics.median(held), max(held)] if held else [0.0] * 3
        if a is not None and math.isfinite(a):
            held.append(a)
        rolling = held[-50:]
        expect = [*prior, statistics.mean(rolling), statistics.median(rolling), max(rolling)]
        assert all(close(x, y) for x, y in zip(got[i], expect, strict=True)), (i, got[i], expect)
