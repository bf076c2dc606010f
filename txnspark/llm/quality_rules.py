"""Quality rules: robust multivariate outliers, with DataFrame operations only.

Six statistics of a text are transformed into a vector. For every language and source,
every language, and the whole table, the minimum-covariance-determinant estimate of
centre and covariance is found by concentration steps: start from the half of the rows
nearest to the marginal medians (in units of their deviations), estimate, keep the
``share`` of the rows with the smallest distances, repeat. The covariance is scaled so
that the median squared distance is that of a normal vector. A row is rejected if its
squared Mahalanobis distance in the finest group of at least ``min_rows`` rows exceeds
``cutoff``. Variances have a floor, so a statistic that hardly varies in a group does not
make every small deviation an outlier.

Ranks inside a group come from histograms of fixed bins, which partial sums merge; a
group with a third of all rows is never gathered, and results do not depend on the order
of rows. Estimates are a table with one row per group and are never collected.

Base rules hold besides: fewer than ``min_words`` words, or more than half of them in
windows of three words that the text repeats.

Defined results: null and empty texts have no words and fail the base rules; null
languages and sources are groups of their own; rows are judged one by one, so repeated
rows get equal verdicts; a table without a group of ``min_rows`` rows has no outliers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnspark.llm.common import row_key, without
from txnspark.sources.scratch import written

MIN_WORDS, MIN_ROWS, SHARE, STEPS = 50, 200, 0.75, 3
# Chi-square with as many degrees of freedom as there are statistics: its median.
MEDIAN_6 = 5.348
CUTOFF = 30.0
#: Name and least standard deviation of each transformed statistic.
FLOORS = {"x_length": 0.3, "x_word": 0.12, "x_symbol": 0.045, "x_line": 0.2, "x_repeat": 0.2, "x_upper": 0.08}
#: Tables of one row per group are broadcast up to this many groups, else shuffled.
BROADCAST_GROUPS = 200_000
#: Columns of the result; input columns of these names are replaced.
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper",
    "base_failed", "distance2", "kept",
)
_SPACE = r"[\x20\x09-\x0D]+"
_LEVELS = ("source", "lang", "all")


def repeated_words(words: Column) -> Column:
    """Words inside windows of three that occur twice or more, the first one included."""
    last = F.size(words) - 3
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(3)]))
    return F.when(last >= 1, hashes)


def covered_by_repeats(hashes: Column) -> Column:
    """Positions covered by windows whose hash is not unique: sort, compare neighbours, measure gaps."""
    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    ordered = F.sort_array(pairs)

    # Bound to a variable, so that the sort happens once.
    bound = F.transform(F.array(ordered), lambda o: F.sort_array(F.transform(
        F.filter(o, lambda x, i: F.coalesce(F.get(o, i - 1)["h"] == x["h"], F.lit(False))
                 | F.coalesce(F.get(o, i + 1)["h"] == x["h"], F.lit(False))),
        lambda x: x["i"],
    )))
    at = F.get(bound, F.lit(0))
    count = F.transform(F.array(at), lambda a: F.aggregate(
        F.transform(a, lambda p, i: F.least(F.coalesce(F.get(a, i + 1) - p, F.lit(3)), F.lit(3))),
        F.lit(0), lambda total, gap: total + gap,
    ))
    return F.get(count, F.lit(0))


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` without its text, with the counts of every text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", *COUNTS)]
    rows = docs.select(*keep, text.alias("_text"), F.array_remove(F.split(text, _SPACE), "").alias("_words"))
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumns({"_runs": repeated_words(F.col("_words")), "_lines": lines})
    unique = F.size(F.array_distinct("_runs")) == F.size("_runs")
    repeats = F.when(F.col("_runs").isNull() | unique, F.lit(0)).otherwise(covered_by_repeats(F.col("_runs")))
    symbols = F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))
    upper = F.length("_text") - F.length(F.translate("_text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    counts = {
        "n_words": F.size("_words"),
        "word_chars": F.length(F.array_join("_words", "")),
        "n_symbols": symbols,
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": repeats,
        "n_upper": upper,
    }
    return rows.select(*keep, *[c.cast("long").alias(n) for n, c in counts.items()])


def transformed() -> dict[str, Column]:
    """The vector: logarithms of sizes, square roots of shares."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {
        "x_length": F.log1p(F.col("n_words").cast("double")),
        "x_word": F.log(chars / words),
        "x_symbol": F.sqrt(F.col("n_symbols") / chars),
        "x_line": F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
        "x_repeat": F.sqrt(F.col("n_repeat_words") / words),
        "x_upper": F.sqrt(F.col("n_upper") / chars),
    }


def at_share(rows: DataFrame, bins: dict[str, Column], share: float) -> DataFrame:
    """Per group and name: the least bin that holds ``share`` of the group's rows below or at it."""
    pairs = F.array(*[F.struct(F.lit(n).alias("_name"), b.cast("long").alias("_bin")) for n, b in bins.items()])
    counts = rows.select("_group", F.inline(pairs)).groupBy("_group", "_name", "_bin").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy("_group", "_name")
    upto = F.sum("_n").over(group.orderBy("_bin"))
    whole = F.sum("_n").over(group)
    found = counts.select("_group", "_name", "_bin", upto.alias("_upto"), whole.alias("_all"))
    found = found.where(F.col("_upto") >= F.ceil(F.col("_all") * share))
    return found.groupBy("_group").pivot("_name", list(bins)).agg(F.min("_bin"))


def distance(names: list[str], prefix: str = "") -> dict[str, Column]:
    """Columns, in order, that end in ``_d2``: forward substitution through the Cholesky factor."""
    out = {}
    for i, x in enumerate(names):
        lower = [F.col(f"l_{i}_{j}") * F.col(f"_y_{j}") for j in range(i)]
        centred = F.col(x) - F.col(f"m_{i}")
        out[f"_y_{i}"] = reduce(lambda a, b: a - b, lower, centred) / F.col(f"l_{i}_{i}")
    out["_d2"] = reduce(lambda a, b: a + b, [F.col(f"_y_{i}") * F.col(f"_y_{i}") for i in range(len(names))])
    return out


def with_columns(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns one after another; later ones may use earlier ones."""
    return reduce(lambda d, item: d.withColumn(*item), columns.items(), df)


def estimate(rows: DataFrame, names: list[str]) -> DataFrame:
    """Mean and Cholesky factor of the covariance (with its floor) per group."""
    p = range(len(names))
    means = [F.avg(names[i]).alias(f"m_{i}") for i in p]
    covs = [F.covar_pop(names[i], names[j]).alias(f"c_{i}_{j}") for i in p for j in range(i + 1)]
    table = rows.groupBy("_group").agg(*means, *covs)
    factor = {}
    for i in p:
        for j in range(i + 1):
            dot = [F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)]
            own = F.col(f"c_{i}_{j}") + (FLOORS[names[i]] ** 2 if i == j else 0.0)
            left = reduce(lambda a, b: a - b, dot, own)
            factor[f"l_{i}_{j}"] = F.sqrt(F.greatest(left, F.lit(1e-12))) if i == j else left / F.col(f"l_{j}_{j}")
    return with_columns(table, factor).drop(*[f"c_{i}_{j}" for i in p for j in range(i + 1)])


def fit(rows: DataFrame, names: list[str], share: float, steps: int, few: bool) -> DataFrame:
    """Centre, factor and scale of every group of ``rows`` (_group and the statistics).

    With ``few`` groups their tables go to the rows, so a hot group is not moved.
    """
    side = F.broadcast if few else lambda table: table
    grid = 256.0
    medians = at_share(rows, {n: F.floor(F.col(n) * grid) for n in names}, 0.5)
    medians = written(medians.select("_group", *[(F.col(n) / grid).alias(f"_med_{n}") for n in names]), "medians")
    away = rows.join(side(medians), "_group")
    spread = at_share(away, {n: F.floor(F.abs(F.col(n) - F.col(f"_med_{n}")) * grid) for n in names}, 0.5)
    spread = spread.select("_group", *[(F.col(n) / grid).alias(f"_mad_{n}") for n in names])
    near = [
        F.pow((F.col(n) - F.col(f"_med_{n}")) / F.greatest(F.col(f"_mad_{n}") * 1.4826, F.lit(FLOORS[n])), 2)
        for n in names
    ]
    scored = away.join(side(spread), "_group").select("_group", *names, reduce(lambda a, b: a + b, near).alias("_d2"))
    level = F.floor(F.log2(F.col("_d2") + 1e-6) * 32)
    keep = 0.5
    for step in range(steps + 1):
        cut = at_share(scored, {"_cut": level}, keep)
        chosen = scored.join(side(cut), "_group").where(level <= F.col("_cut"))
        model = written(estimate(chosen, names), "estimate")
        scored = with_columns(rows.join(side(model), "_group"), distance(names)).select("_group", *names, "_d2")
        keep = share
    middle = at_share(scored, {"_mid": level}, 0.5)
    scale = middle.select("_group", (F.pow(F.lit(2.0), F.col("_mid") / 32) / MEDIAN_6).alias("_scale"))
    return written(model.join(scale, "_group"), "outlier-model")


def judge(
    docs: DataFrame,
    cutoff: float = CUTOFF,
    min_rows: int = MIN_ROWS,
    share: float = SHARE,
    steps: int = STEPS,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """``docs`` without its text, with the counts, base_failed, distance and kept."""
    names = list(FLOORS)
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counted = written(statistics(docs).withColumn("base_failed", base), "statistics")
    lang, source = (F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in ("lang", "source"))
    keys = {
        "source": F.concat_ws("\u0001", F.lit("source"), lang, source),
        "lang": F.concat_ws("\u0001", F.lit("lang"), lang),
        "all": F.lit("all"),
    }
    rows = counted.select("*", *[c.alias(n) for n, c in transformed().items()])
    vectors = rows.where(~F.col("base_failed")).select(F.explode(F.array(*keys.values())).alias("_group"), *names)
    sizes = vectors.groupBy("_group").agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") >= min_rows)
    sizes = written(sizes, "groups")
    few = sizes.count() <= BROADCAST_GROUPS
    side = F.broadcast if few else lambda table: table
    model = fit(vectors.join(side(sizes.select("_group")), "_group"), names, share, steps, few)
    pick = written(sizes.join(model, "_group"), "models")
    finest = rows
    for level in _LEVELS:
        finest = finest.withColumn(f"_key_{level}", keys[level])
        known = pick.select(F.col("_group").alias(f"_key_{level}"), F.lit(True).alias(f"_has_{level}"))
        finest = finest.join(side(known), f"_key_{level}", "left")
    group = F.coalesce(*[F.when(F.col(f"_has_{v}"), F.col(f"_key_{v}")) for v in _LEVELS])
    finest = finest.withColumn("_group", group).drop(*[f"_{k}_{v}" for v in _LEVELS for k in ("key", "has")])
    scored = with_columns(finest.join(side(pick), "_group", "left"), distance(names))
    d2 = F.col("_d2") / F.greatest("_scale", F.lit(1.0))
    kept = ~F.col("base_failed") & (F.coalesce(d2, F.lit(0.0)) <= cutoff)
    return scored.select(*[F.col(f"`{c}`") for c in counted.columns], d2.alias("distance2"), kept.alias("kept"))


def keep(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that the rules reject, all columns kept."""
    rows = docs.select("doc_id", "text", "lang", "source", row_key().alias("_key"))
    rejected = written(judge(rows).where("NOT kept").select("_key"), "rejected")
    return without(docs, rejected, row_key())
