"""Evaluation, thresholds, models and composed jobs."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from txnspark.catalog.registry import B, R, predictions, put, query, tidy
from txnspark.catalog.scalars import DECILE_SQL, EDGES_SQL
from txnspark.catalog.summaries import BLOCK_LIMIT, HEADER_SQL, KEY_SQL, RUN_SQL, sample_key
from txnspark.operators import curves, metrics, model, reports, sampling, thresholds, trees
from txnspark.operators.ordered import HOT_ROWS
from txnspark.plans import features, fitted, jobs, resolve
from txnspark.sources import sinks
from txnspark.sources.scratch import scratch_path, written
from txnspark.sources.testdata import txn

T = "trans_date_trans_time"

# Curve by plain window functions; the shared text the threshold oracles build on.
CURVE_SQL = """g AS (SELECT fraud_probability AS t, sum(is_fraud) AS pos, count(*) - sum(is_fraud) AS neg
  FROM {0} GROUP BY 1),
c AS (SELECT t, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
  sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g WINDOW w AS (ORDER BY t DESC)),
q AS (SELECT *, tp / (tp + fp) AS prec, tp / p AS rec,
  2 * (tp / (tp + fp)) * (tp / p) / (tp / (tp + fp) + tp / p + 1e-12) AS f1 FROM c)"""
_CURVE = CURVE_SQL.format("txn")

# Areas by ranks and by position, not by the curve.
AUC_SQL = """(SELECT (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2e0)
  / (sum(y) * (count(*) - sum(y))) FROM (SELECT is_fraud AS y, rank() OVER (ORDER BY s)
  + (count(*) OVER (PARTITION BY s) - 1) / 2e0 AS r FROM (SELECT is_fraud, fraud_probability AS s
  FROM {0})))"""
AP_SQL = """(SELECT avg(hits / CAST(seen AS DOUBLE)) FROM (SELECT is_fraud,
  sum(is_fraud) OVER w AS hits, count(*) OVER w AS seen FROM {0}
  WINDOW w AS (ORDER BY fraud_probability DESC RANGE UNBOUNDED PRECEDING)) WHERE is_fraud = 1)"""
POLICY_SQL = """{R_prec} AS precision_at_policy, {R_rec} AS recall_at_policy""".format(
    R_prec=R(
        "coalesce(avg(is_fraud) FILTER (decision IS DISTINCT FROM 'allow'), 0)"
    ),
    R_rec=R(
        "coalesce(avg(CASE WHEN decision IS DISTINCT FROM 'allow' THEN 1e0 ELSE 0e0 END)"
        " FILTER (is_fraud = 1), 0)"
    ),
)


def _points(spark, sf):
    return curves.curve_points(txn(spark, sf))


@query("ev_roc_auc", f"SELECT {R(AUC_SQL.format('txn'))} AS roc_auc")
def ev_roc_auc(spark, sf):
    return tidy(_points(spark, sf).agg(curves.roc_auc().alias("roc_auc")))


@query("ev_roc_auc_blocks", f"SELECT {R(AUC_SQL.format('txn'))} AS roc_auc")
def ev_roc_auc_blocks(spark, sf):
    """The curve in blocks of the score range, as for more scores than one task holds."""
    points = curves.curve_points(txn(spark, sf), limit=BLOCK_LIMIT)
    return tidy(points.agg(curves.roc_auc().alias("roc_auc")))


@query("ev_avg_precision", f"SELECT {R(AP_SQL.format('txn'))} AS pr_auc")
def ev_avg_precision(spark, sf):
    return tidy(_points(spark, sf).agg(curves.average_precision().alias("pr_auc")))


@query(
    "ev_pr_curve",
    f"""WITH {_CURVE} SELECT {R('t', 9)} AS threshold, {R('prec')} AS precision,
      {R('rec')} AS recall FROM q UNION ALL SELECT NULL, 1e0, 0e0""",
)
def ev_pr_curve(spark, sf):
    return tidy(curves.pr_curve(_points(spark, sf)), threshold=9)


@query(
    "ev_roc_curve",
    f"""WITH {_CURVE} SELECT {R('t', 9)} AS threshold, {R('fp / n')} AS fpr, {R('tp / p')} AS tpr
    FROM q UNION ALL SELECT 2e0, 0e0, 0e0""",
)
def ev_roc_curve(spark, sf):
    # The start point lies above every score; 2 stands for its infinite threshold.
    out = curves.roc_curve(_points(spark, sf))
    return tidy(out.withColumn("threshold", F.least("threshold", F.lit(2.0))), threshold=9)


# Points stay where the counts at the next threshold differ, and at both ends.
_CORNERS_SQL = f"""WITH g AS (SELECT fraud_probability AS t, sum(is_fraud) AS pos, count(*) - sum(is_fraud) AS neg FROM txn GROUP BY 1),
    w AS (SELECT *, lag(pos) OVER (ORDER BY t) AS pos_below, lag(neg) OVER (ORDER BY t) AS neg_below,
      sum(pos) OVER (ORDER BY t DESC) AS tp, sum(neg) OVER (ORDER BY t DESC) AS fp, lead(t) OVER (ORDER BY t) AS above FROM g)
    SELECT {R('t', 9)} AS threshold, {R('fp / (SELECT CAST(sum(neg) AS DOUBLE) FROM g)')} AS fpr,
      {R('tp / (SELECT CAST(sum(pos) AS DOUBLE) FROM g)')} AS tpr FROM w
    WHERE above IS NULL OR pos_below IS NULL OR pos_below <> pos OR neg_below <> neg UNION ALL SELECT 2e0, 0e0, 0e0"""


def _corners(limit):
    def run(spark, sf):
        points = curves.curve_points(txn(spark, sf), limit=limit)
        out = curves.roc_curve(curves.roc_corners(points, limit))
        return tidy(out.withColumn("threshold", F.least("threshold", F.lit(2.0))), threshold=9)

    return run


put("ev_roc_corners", _corners(HOT_ROWS), _CORNERS_SQL)
put("ev_roc_corners_blocks", _corners(BLOCK_LIMIT), _CORNERS_SQL)

_LABELLED = "j AS (SELECT t.*, p.decision FROM txn t JOIN pred p USING (trans_num))"


def _labelled(spark, sf):
    scores = predictions(spark, sf).select("trans_num", "decision")
    return txn(spark, sf).join(scores, "trans_num")


@query(
    "ev_precision_recall_policy",
    f"""WITH {_LABELLED} SELECT {POLICY_SQL},
      {R("avg(CASE WHEN decision IS DISTINCT FROM 'allow' THEN 1e0 ELSE 0e0 END)")} AS flag_rate
    FROM j""",
)
def ev_precision_recall_policy(spark, sf):
    out = metrics.precision_recall_at_policy(_labelled(spark, sf))
    names = {"precision": "precision_at_policy", "recall": "recall_at_policy"}
    return tidy(out.withColumnsRenamed(names))


@query(
    "ev_flag_rate",
    f"""SELECT {R("1 - count(*) FILTER (decision = 'allow') / count(*)")} AS flag_rate FROM pred""",
)
def ev_flag_rate(spark, sf):
    return tidy(metrics.flag_rate(predictions(spark, sf)))


_CONFUSION = """SELECT count(*) FILTER (is_fraud = 0 AND fraud_probability < 0.9e0) AS tn,
  count(*) FILTER (is_fraud = 0 AND fraud_probability >= 0.9e0) AS fp,
  count(*) FILTER (is_fraud = 1 AND fraud_probability < 0.9e0) AS fn,
  count(*) FILTER (is_fraud = 1 AND fraud_probability >= 0.9e0) AS tp FROM txn"""


@query("ev_confusion", _CONFUSION)
def ev_confusion(spark, sf):
    return tidy(metrics.confusion(txn(spark, sf), 0.9))


@query(
    "ev_class_report",
    f"""WITH k AS ({_CONFUSION}),
    r AS (SELECT tn / (tn + fn) AS p0, tn / (tn + fp) AS r0, tp / (tp + fp) AS p1, tp / (tp + fn) AS r1,
      tn + fp AS s0, tp + fn AS s1, (tn + tp) / (tn + fp + fn + tp) AS acc FROM k),
    f AS (SELECT *, 2 * p0 * r0 / (p0 + r0) AS f0, 2 * p1 * r1 / (p1 + r1) AS f1, s0 + s1 AS s FROM r)
    SELECT '0' AS class, {R('p0')} AS precision, {R('r0')} AS recall, {R('f0')} AS f1,
      {B('s0')} AS support FROM f
    UNION ALL SELECT '1', {R('p1')}, {R('r1')}, {R('f1')}, {B('s1')} FROM f
    UNION ALL SELECT 'accuracy', {R('acc')}, {R('acc')}, {R('acc')}, {B('s')} FROM f
    UNION ALL SELECT 'macro avg', {R('(p0 + p1) / 2')}, {R('(r0 + r1) / 2')}, {R('(f0 + f1) / 2')},
      {B('s')} FROM f
    UNION ALL SELECT 'weighted avg', {R('(p0 * s0 + p1 * s1) / s')}, {R('(r0 * s0 + r1 * s1) / s')},
      {R('(f0 * s0 + f1 * s1) / s')}, {B('s')} FROM f""",
)
def ev_class_report(spark, sf):
    return tidy(metrics.class_report(txn(spark, sf), 0.9))


@query("ev_brier", f"SELECT {R('avg(pow(fraud_probability - is_fraud, 2))')} AS brier FROM txn")
def ev_brier(spark, sf):
    return tidy(metrics.brier(txn(spark, sf)))


@query(
    "ev_calibration_curve",
    f"""SELECT {B('greatest(ceil(fraud_probability * 10) - 1, 0)')} AS bin,
      {R('avg(fraud_probability)')} AS mean_predicted, {R('avg(is_fraud)')} AS fraction_positive,
      {B('count(*)')} AS n FROM txn GROUP BY 1""",
)
def ev_calibration_curve(spark, sf):
    return tidy(metrics.calibration_curve(txn(spark, sf)))


def _recall_sql(fraction):
    return f"""SELECT {fraction}e0 AS fraction, {B('max(k)')} AS k,
      {R('sum(is_fraud) FILTER (i <= k) / sum(is_fraud)')} AS recall FROM (SELECT is_fraud,
        row_number() OVER (ORDER BY fraud_probability DESC, trans_num) AS i,
        greatest(1, floor({fraction}e0 * count(*) OVER ())) AS k FROM txn)"""


@query("ev_recall_at_k", f"{_recall_sql(0.005)} UNION ALL {_recall_sql(0.01)}")
def ev_recall_at_k(spark, sf):
    rows = txn(spark, sf)
    points = curves.frozen_points(curves.curve_points(rows))
    parts = [
        curves.recall_at_k(rows, f, points=points).withColumn("fraction", F.lit(f))
        for f in (0.005, 0.01)
    ]
    return tidy(parts[0].unionByName(parts[1]))


# ----------------------------------------------------------------- thresholds

_BEST = f"{R('t', 9)} AS threshold, {R('prec')} AS precision, {R('rec')} AS recall"


@query(
    "thr_best_f1",
    f"WITH {_CURVE} SELECT {_BEST}, {R('f1')} AS f1 FROM q ORDER BY q.f1 DESC, t LIMIT 1",
)
def thr_best_f1(spark, sf):
    return tidy(thresholds.best_f1(_points(spark, sf)), threshold=9)


def _grid_sql(grid, eps):
    values = ", ".join(f"({t!r}::DOUBLE)" for t in grid)
    e = f"{eps!r}::DOUBLE"

    def ratio(a, b):
        return f"coalesce(({a}) / nullif({b} + {e}, 0), 0)"

    return f"""WITH g(t) AS (VALUES {values}),
    k AS (SELECT t, count(*) FILTER (fraud_probability >= t) AS flagged,
      count(*) FILTER (fraud_probability >= t AND is_fraud = 1) AS tp, sum(is_fraud) AS p
      FROM g CROSS JOIN txn GROUP BY t),
    q AS (SELECT t, {ratio('tp', 'flagged')} AS prec, {ratio('tp', 'p')} AS rec FROM k),
    f AS (SELECT *, {ratio('2 * prec * rec', 'prec + rec')} AS f1 FROM q)
    SELECT {_BEST}, {R('f1')} AS f1 FROM f ORDER BY f.f1 DESC, t LIMIT 1"""


for _name, _grid, _eps in (
    ("thr_grid_f1", thresholds.f1_grid(0.05, 0.99, 191), 0.0),
    ("thr_grid_f1_99", thresholds.f1_grid(0.01, 0.99, 99), 1e-9),
):
    put(
        _name,
        lambda spark, sf, grid=_grid, eps=_eps: tidy(
            thresholds.grid_f1(txn(spark, sf), grid, eps=eps), threshold=9
        ),
        _grid_sql(_grid, _eps),
    )


@query(
    "thr_target_precision",
    f"""WITH {_CURVE} SELECT {R('coalesce((SELECT t FROM q WHERE prec >= 0.2 ORDER BY rec DESC, t LIMIT 1),'
    ' 0.5e0)', 9)} AS threshold,
      {R('coalesce((SELECT t FROM q WHERE prec >= 1.1 ORDER BY rec DESC, t LIMIT 1), 0.5e0)', 9)}
      AS unreachable""",
)
def thr_target_precision(spark, sf):
    points = _points(spark, sf)
    never = thresholds.target_precision(points, 1.1)
    out = thresholds.target_precision(points).select(
        "threshold", never.scalar().alias("unreachable")
    )
    return tidy(out, 9)


@query(
    "thr_recall_and_precision",
    f"""WITH {_CURVE} SELECT {_BEST} FROM q WHERE rec >= 0.85 AND prec >= 0.5
    ORDER BY prec DESC, t LIMIT 1""",
)
def thr_recall_and_precision(spark, sf):
    return tidy(thresholds.recall_and_precision(_points(spark, sf)), threshold=9)


def _suggest_sql(pick, view="q"):
    block = f"coalesce((SELECT {pick}(t) FROM {view} WHERE prec >= 0.98), (SELECT max(t) FROM {view}))"
    return f"""b AS (SELECT {block} AS block),
    s AS (SELECT block, coalesce((SELECT {pick}(t) FROM {view} WHERE prec >= 0.75 AND t < block),
      least(block, 0.5e0)) AS review FROM b)"""


for _name, _pick, _fn in (
    ("thr_suggest_policy", "max", thresholds.suggest_policy),
    ("thr_suggest_widest", "min", thresholds.suggest_widest),
):
    put(
        _name,
        lambda spark, sf, fn=_fn: tidy(fn(_points(spark, sf)), 9),
        f"""WITH {_CURVE}, {_suggest_sql(_pick)}
        SELECT {R('block', 9)} AS block, {R('review', 9)} AS review, 0e0 AS allow FROM s""",
    )

# --------------------------------------------------------------------- models

FEATURES = ["amt", "hour", "transaction_count", "txn_count_last_24h", "mean_amt", "gender_bin"]
#: Least ROC area and average precision of the trained model; about 0.07 of the rows are positive.
ROC_FLOOR, PRECISION_FLOOR = 0.8, 0.6
_SMALL = model.TreeSettings(trees=8, depth=4, learning_rate=0.2)


def _training_table(spark, sf):
    """Features written once, with a score as one more input so labels can be learned."""
    built = features.build(txn(spark, sf), FEATURES, "eval")
    split = sampling.stratified_split(built, key=sample_key())
    names = [*FEATURES, "fraud_probability", "is_fraud", "is_test"]
    table = split.select("trans_num", *names).withColumnRenamed("fraud_probability", "hint")
    return written(table, "training"), [*FEATURES, "hint"]


_SPLIT_SQL = f"""split AS (SELECT trans_num, is_fraud, row_number() OVER (PARTITION BY is_fraud
  ORDER BY {KEY_SQL}, trans_num) <= ceil(0.2e0 * count(*) OVER (PARTITION BY is_fraud)) AS is_test FROM txn)"""


@query(
    "ml_train_gbt",
    f"""WITH {_SPLIT_SQL} SELECT {B('count(*)')} AS test_rows, {B('sum(is_fraud)')} AS test_frauds,
      true AS better_than_chance, true AS in_range FROM split WHERE is_test""",
)
def ml_train_gbt(spark, sf):
    """Facts about a model on the held-out part; both areas must pass a floor."""
    rows, names = _training_table(spark, sf)
    trained = model.train_gbt(rows.where(~F.col("is_test")), names, settings=_SMALL)
    scored = written(model.score(rows.where("is_test"), trained), "scored")
    passes = (curves.roc_auc() > ROC_FLOOR) & (curves.average_precision() > PRECISION_FLOOR)
    areas = curves.curve_points(scored).agg(passes.alias("passes"))
    p = F.col("fraud_probability")
    return scored.agg(
        F.count(F.lit(1)).alias("test_rows"),
        F.sum("is_fraud").cast("long").alias("test_frauds"),
        areas.scalar().alias("better_than_chance"),
        F.every((p >= 0) & (p <= 1)).alias("in_range"),
    )


#: Inputs with few values each: all midpoints between them are candidates for a split.
GROWN = ["hour", "dayofweek", "gender_bin"]
_ONE_TREE = model.TreeSettings(trees=1, depth=2, subsample=1.0)


def _best_sql(level, rows):
    """Views c (all candidate splits of the nodes of ``rows``) and b (each node's best one)."""
    gain = "(sl * sl / wl + (st - sl) * (st - sl) / (wt - wl) - st * st / wt)"
    return f"""c{level} AS (SELECT node, feat, thr, sum(w) FILTER (x <= thr) AS wl, sum(w * y) FILTER (x <= thr) AS sl,
      sum(w) AS wt, sum(w * y) AS st FROM {rows} JOIN thr USING (feat) GROUP BY node, feat, thr),
    b{level} AS (SELECT node, feat, thr, {gain} AS gain, row_number() OVER (PARTITION BY node
      ORDER BY round({gain}, 9) DESC, feat, thr) AS best FROM c{level} WHERE wl IS NOT NULL AND wl < wt)"""


# A tree of two levels, grown from the definition: weighted squares of labels -1 and 1.
_GROWN_SQL = f"""wt AS (SELECT count(*) / (2e0 * sum(is_fraud)) AS w1, count(*) / (2e0 * (count(*) - sum(is_fraud))) AS w0 FROM txn),
  f AS (SELECT trans_num, 2e0 * is_fraud - 1 AS y, CASE WHEN is_fraud = 1 THEN w1 ELSE w0 END AS w,
    CAST(hour({T}) AS DOUBLE) AS f0, CAST(isodow({T}) - 1 AS DOUBLE) AS f1,
    CASE WHEN gender = 'M' THEN 1e0 ELSE 0e0 END AS f2 FROM txn, wt),
  long AS (SELECT trans_num, y, w, unnest([0, 1, 2]) AS feat, unnest([f0, f1, f2]) AS x FROM f),
  vals AS (SELECT DISTINCT feat, x FROM long),
  thr AS (SELECT feat, (x + next) / 2 AS thr FROM (SELECT feat, x, lead(x) OVER (PARTITION BY feat ORDER BY x) AS next FROM vals)
    WHERE next IS NOT NULL),
  r0 AS (SELECT *, 1 AS node FROM long), {_best_sql(0, 'r0')},
  r1 AS (SELECT l.*, 2 + CAST(k.x > b.thr AS INTEGER) AS node FROM long l, b0 b, long k
    WHERE b.best = 1 AND k.trans_num = l.trans_num AND k.feat = b.feat), {_best_sql(1, 'r1')},
  inner_nodes AS (SELECT node, feat, thr, gain FROM b0 WHERE best = 1 UNION ALL SELECT node, feat, thr, gain FROM b1 WHERE best = 1),
  leaf_of AS (SELECT l.trans_num, l.y, l.w, 2 * l.node + CAST(k.x > b.thr AS INTEGER) AS node FROM r1 l JOIN b1 b USING (node)
    JOIN long k ON k.trans_num = l.trans_num AND k.feat = b.feat WHERE l.feat = 0 AND b.best = 1),
  leaves AS (SELECT node, sum(w * y) / sum(w) AS prediction FROM leaf_of GROUP BY node)"""
_NAMES_SQL = "['" + "', '".join(GROWN) + "'][feat + 1]"


def _one_tree(spark, sf):
    built = features.build(txn(spark, sf), GROWN, "eval").select("trans_num", "is_fraud", *GROWN)
    table = written(built, "grown")
    return table, model.train_gbt(table, GROWN, settings=_ONE_TREE)


@query(
    "ml_tree_splits",
    f"""WITH {_GROWN_SQL} SELECT {B('node')} AS node, {_NAMES_SQL} AS feature, {R('thr')} AS threshold, CAST(NULL AS DOUBLE) AS prediction
    FROM inner_nodes UNION ALL SELECT {B('node')}, NULL, NULL, {R('prediction')} FROM leaves""",
)
def ml_tree_splits(spark, sf):
    """The splits and leaves of a trained tree, against one grown in SQL."""
    _, trained = _one_tree(spark, sf)
    return tidy(trees.compiled(trained).splits(spark).drop("tree"))


@query(
    "ml_score",
    f"""WITH {_GROWN_SQL} SELECT trans_num, {R('1e0 / (1e0 + exp(-2e0 * prediction))')} AS fraud_probability
    FROM leaf_of JOIN leaves USING (node)""",
)
def ml_score(spark, sf):
    """Every row's probability from the trained model, its splits compiled to an expression."""
    table, trained = _one_tree(spark, sf)
    scored = trees.score_compiled(table, trees.compiled(trained))
    return tidy(scored.select("trans_num", "fraud_probability"))


@query(
    "ml_calibrate_isotonic",
    f"""WITH g AS (SELECT fraud_probability AS s, avg(is_fraud) AS y, count(*) AS w FROM txn GROUP BY 1),
    i AS (SELECT s, row_number() OVER (ORDER BY s) AS i, sum(y * w) OVER (ORDER BY s) AS cy,
      sum(w) OVER (ORDER BY s) AS cw, y * w AS yw, w FROM g),
    pairs AS (SELECT a.i AS j, b.i AS k, (b.cy - a.cy + a.yw) / (b.cw - a.cw + a.w) AS m
      FROM i a JOIN i b ON a.i <= b.i),
    low AS (SELECT j, k, min(m) OVER (PARTITION BY j ORDER BY k DESC) AS m FROM pairs),
    fit AS (SELECT k, max(m) AS fitted FROM low GROUP BY k)
    SELECT {R('s', 9)} AS score, {R('fitted')} AS fitted FROM fit JOIN i ON i.i = fit.k""",
)
def ml_calibrate_isotonic(spark, sf):
    """The isotonic map of the given score, at every score that occurs."""
    rows = txn(spark, sf)
    isotonic = model.fit_isotonic(rows, "fraud_probability", "is_fraud")
    scores = rows.select(F.col("fraud_probability").alias("_p")).distinct()
    out = isotonic.setPredictionCol("fitted").transform(scores)
    return tidy(out.select(F.col("_p").alias("score"), "fitted"), score=9)


@query(
    "ml_calibrated_folds",
    f"""WITH {_SPLIT_SQL} SELECT {B('count(*)')} AS rows, true AS in_range, true AS better_than_chance
    FROM split WHERE is_test""",
)
def ml_calibrated_folds(spark, sf):
    """Facts about the fold-wise calibrated model on the held-out part."""
    rows, names = _training_table(spark, sf)
    calibrated = model.calibrate_isotonic(rows.where(~F.col("is_test")), names, settings=_SMALL)
    scored = written(calibrated.transform(rows.where("is_test")), "calibrated")
    areas = curves.curve_points(scored).agg(curves.roc_auc().alias("auc"))
    p = F.col("fraud_probability")
    return scored.agg(
        F.count(F.lit(1)).alias("rows"),
        F.every((p >= 0) & (p <= 1)).alias("in_range"),
        (areas.scalar() > 0.6).alias("better_than_chance"),
    )


@query(
    "ml_importance",
    f"""WITH {_GROWN_SQL}, g AS (SELECT feat, sum(gain) AS gain FROM inner_nodes GROUP BY feat)
    SELECT {_NAMES_SQL} AS feature, {R('coalesce(gain, 0) / (SELECT sum(gain) FROM g)')} AS importance
    FROM (SELECT DISTINCT feat FROM long) LEFT JOIN g USING (feat)""",
)
def ml_importance(spark, sf):
    """Share of the gain that each feature's splits brought."""
    _, trained = _one_tree(spark, sf)
    return tidy(model.importance(trained))


@query(
    "ml_class_weight",
    f"""SELECT {R('count(*) / (2e0 * count(*) FILTER (is_fraud = 0))')} AS weight_0,
      {R('count(*) / (2e0 * count(*) FILTER (is_fraud = 1))')} AS weight_1,
      {R('count(*) FILTER (is_fraud = 0) / CAST(count(*) FILTER (is_fraud = 1) AS DOUBLE)')}
      AS scale_pos_weight FROM txn""",
)
def ml_class_weight(spark, sf):
    return tidy(model.class_weights(txn(spark, sf)))


# -------------------------------------------------------------- composed jobs

# A stand-in for a fitted model that both engines compute alike.
_INPUTS = ["transaction_count", "hour", "txn_count_last_24h"]


def stand_in(df):
    raw = F.col("transaction_count") * 37 + F.col("hour") * 11 + F.col("txn_count_last_24h") * 101
    return df.withColumn("fraud_probability", (raw % 1009) / F.lit(1008.0))


_EARLIER = f"(b.{T} < a.{T} OR (b.{T} = a.{T} AND b.trans_num <= a.trans_num))"
_RECENT = f"epoch_us(a.{T}) // 1000000 - epoch_us(b.{T}) // 1000000 <= 86400"


def _stand_in_sql(numbered, recent):
    """Views z (scored) and y (with decisions); the tests pick the rows of a card to count."""
    return f"""h AS (SELECT a.trans_num, count(*) FILTER ({numbered}) AS i,
      count(*) FILTER ({recent}) AS d FROM txn a JOIN txn b USING (cc_num) GROUP BY 1),
    z AS (SELECT trans_num, {T}, amt, is_fraud,
      ((i * 37 + hour({T}) * 11 + d * 101) % 1009) / 1008e0 AS fraud_probability
      FROM txn JOIN h USING (trans_num)),
    y AS (SELECT *, CASE WHEN fraud_probability >= 0.9e0 THEN 'block'
      WHEN fraud_probability >= 0.6e0 THEN 'review' ELSE 'allow' END AS decision FROM z)"""


_Y = _stand_in_sql(_EARLIER, f"{_EARLIER} AND {_RECENT}")


@query(
    "pipe_batch_score",
    f"""WITH {_Y} SELECT trans_num, {R('fraud_probability')} AS fraud_probability, decision FROM y""",
)
def pipe_batch_score(spark, sf):
    rows = txn(spark, sf).drop("fraud_probability")
    return tidy(jobs.batch_score(rows, stand_in, _INPUTS))


@query(
    "pipe_batch_fallback",
    f"""WITH {_GROWN_SQL}, p AS (SELECT trans_num, 1e0 / (1e0 + exp(-2e0 * prediction)) AS p FROM leaf_of JOIN leaves USING (node))
    SELECT way, trans_num, {R('p')} AS fraud_probability,
      CASE WHEN p >= 0.9e0 THEN 'block' WHEN p >= 0.6e0 THEN 'review' ELSE 'allow' END AS decision
    FROM p, (VALUES ('pipeline'), ('pipeline(features)'), ('base')) v(way)""",
)
def pipe_batch_fallback(spark, sf):
    """The same scores three ways: input that a pipeline takes as it is, raw input for it, and a model alone."""
    table, trained = _one_tree(spark, sf)
    raw = txn(spark, sf).drop("fraud_probability")
    ways = [
        resolve.batch_score(table, resolve.Scorers(pipeline=trained)),
        resolve.batch_score(raw, resolve.Scorers(pipeline=trained)),
        resolve.batch_score(raw, resolve.Scorers(base=trained)),
    ]
    parts = [scored.select(F.lit(way).alias("way"), "trans_num", "fraud_probability", "decision") for way, scored in ways]
    return tidy(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def _quality_sql(view):
    return f"""{R(AUC_SQL.format(view))} AS roc_auc, {R(AP_SQL.format(view))} AS pr_auc,
      (SELECT {R('block', 9)} FROM s) AS block, (SELECT {R('review', 9)} FROM s) AS review"""


def _flat_quality(df):
    return df.select("*", "threshold_suggestion.block", "threshold_suggestion.review").drop(
        "threshold_suggestion"
    )


@query(
    "pipe_holdout_eval",
    f"""WITH {_Y}, test AS (SELECT * FROM y WHERE {T} >= TIMESTAMP '2024-01-21'),
    {CURVE_SQL.format('test')}, {_suggest_sql('max')}
    SELECT {_quality_sql('test')}, {POLICY_SQL},
      {R("avg(CASE WHEN decision <> 'allow' THEN 1e0 ELSE 0e0 END)")} AS flag_rate FROM test""",
)
def pipe_holdout_eval(spark, sf):
    rows = txn(spark, sf).drop("fraud_probability")
    out = jobs.holdout_eval(rows, stand_in, _INPUTS, "2024-01-21")
    return tidy(_flat_quality(out), block=9, review=9)


@query(
    "pipe_review_queues",
    f"""WITH j AS (SELECT t.*, p.decision FROM txn t LEFT JOIN pred p USING (trans_num))
    SELECT CASE WHEN decision IN ('block', 'review') THEN decision ELSE 'lost' END AS sheet,
      category, {B('count(*)')} AS n, {R('avg(fraud_probability)')} AS avg_prob
    FROM j WHERE decision IS DISTINCT FROM 'allow' AND decision IS NOT NULL GROUP BY 1, 2
    UNION ALL SELECT 'summary_by_category', category, count(*), {R('avg(fraud_probability)')}
    FROM j WHERE decision IS DISTINCT FROM 'allow' GROUP BY 2""",
)
def pipe_review_queues(spark, sf):
    raw = txn(spark, sf).drop("fraud_probability")
    tables = jobs.review_queues(raw, predictions(spark, sf))
    queues = tables["block"].unionByName(tables["review"])
    per_sheet = queues.groupBy(F.col("decision").alias("sheet"), "category").agg(
        F.count(F.lit(1)).alias("n"), F.avg("fraud_probability").alias("avg_prob")
    )
    summary = tables["summary_by_category"].select(
        F.lit("summary_by_category").alias("sheet"),
        "category",
        F.col("count").alias("n"),
        "avg_prob",
    )
    return tidy(per_sheet.unionByName(summary))


@query(
    "pipe_monthly_eval",
    f"""WITH {_LABELLED}, {CURVE_SQL.format('j')}, {_suggest_sql('max')}
    SELECT {HEADER_SQL.replace('AS review,', 'AS review_floor,')}, {POLICY_SQL},
      {_quality_sql('j')} FROM j""",
)
def pipe_monthly_eval(spark, sf):
    raw = txn(spark, sf).drop("fraud_probability")
    out = jobs.monthly_eval(raw, predictions(spark, sf))
    tiers = [F.col("tier_counts")[t].alias(f"{t}_rows") for t in reports.TIERS]
    flat = _flat_quality(out.select("*", *tiers, F.col("policy.review").alias("review_floor")))
    return tidy(flat.drop("tier_counts", "policy"), block=9, review=9)


@query("pipe_run_report", RUN_SQL)
def pipe_run_report(spark, sf):
    return tidy(jobs.run_report(predictions(spark, sf)))


@query(
    "pipe_app_score",
    f"""WITH {_stand_in_sql('true', _RECENT)},
    top AS (SELECT trans_num, amt, fraud_probability FROM z
      ORDER BY fraud_probability DESC, trans_num LIMIT 200)
    SELECT 'kpis' AS panel, CAST(count(*) AS VARCHAR) AS item,
      {R('avg(fraud_probability)')} AS value FROM z
    UNION ALL SELECT 'top', CAST(trans_num AS VARCHAR), {R('fraud_probability')} FROM top
    UNION ALL SELECT 'decile', CAST(decile AS VARCHAR), {R('avg(fraud_probability)')}
      FROM (SELECT z.*, {DECILE_SQL} AS decile FROM z, (SELECT {EDGES_SQL}) e) GROUP BY 2
    UNION ALL SELECT 'histogram', CAST(CAST(least(floor(fraud_probability * 40), 39) AS BIGINT)
      AS VARCHAR), CAST(count(*) AS DOUBLE) FROM z GROUP BY 2""",
)
def pipe_app_score(spark, sf):
    raw = txn(spark, sf).drop("fraud_probability", "is_fraud")
    panels = jobs.app_score(raw, stand_in, _INPUTS)
    kpis = panels["kpis"].select(
        F.lit("kpis").alias("panel"),
        F.col("rows_scored").cast("string").alias("item"),
        F.col("mean_probability").alias("value"),
    )
    top = panels["top"].select(
        F.lit("top").alias("panel"),
        F.col("transaction_id").cast("string").alias("item"),
        F.col("fraud_probability").alias("value"),
    )
    bars = panels["histogram"].select(
        F.lit("histogram").alias("panel"),
        F.col("bin").cast("string").alias("item"),
        F.col("count").cast("double").alias("value"),
    )
    deciles = panels["deciles"].select(
        F.lit("decile").alias("panel"),
        F.col("decile").cast("string").alias("item"),
        F.col("avg_prob").alias("value"),
    )
    return tidy(kpis.unionByName(top).unionByName(bars).unionByName(deciles))


@query(
    "pipe_monthly_eval_partial",
    f"""WITH j AS (SELECT t.*, p.decision FROM txn t JOIN pred p USING (trans_num)
      WHERE {T} < TIMESTAMP '2024-01-15')
    SELECT {B('count(*)')} AS rows, {B("count(*) FILTER (decision IS DISTINCT FROM 'allow')")} AS flags_total,
      (SELECT strftime(max({T}), '%Y-%m') FROM txn) AS month FROM j""",
)
def pipe_monthly_eval_partial(spark, sf):
    """Scores for the first part only: the month is that of the whole input."""
    raw = txn(spark, sf).drop("fraud_probability")
    early = raw.where(F.col(T) < F.lit("2024-01-15").cast("timestamp_ntz")).select("trans_num")
    out = jobs.monthly_eval(raw, predictions(spark, sf).join(early, "trans_num"))
    return tidy(out.select("rows", "flags_total", "month"))


@query(
    "pipe_review_queues_positional",
    f"""WITH a AS (SELECT *, row_number() OVER (ORDER BY trans_num) AS i FROM txn),
    b AS (SELECT fraud_probability AS p, decision, row_number() OVER (ORDER BY fraud_probability, decision NULLS FIRST) AS i
      FROM pred)
    SELECT decision AS sheet, category, {B('count(*)')} AS n, {R('avg(p)')} AS avg_prob
    FROM a JOIN b USING (i) WHERE decision IN ('block', 'review') GROUP BY 1, 2""",
)
def pipe_review_queues_positional(spark, sf):
    """Predictions without an id, paired along declared orders."""
    raw = txn(spark, sf).drop("fraud_probability")
    scores = predictions(spark, sf).drop("trans_num")
    tables = jobs.review_queues(
        raw, scores, raw_order=["trans_num"], prediction_order=["fraud_probability", "decision"]
    )
    queues = tables["block"].unionByName(tables["review"])
    return tidy(queues.groupBy(F.col("decision").alias("sheet"), "category").agg(
        F.count(F.lit(1)).alias("n"), F.avg("fraud_probability").alias("avg_prob")
    ))


@query(
    "snk_threshold_suggestion",
    f"""WITH {_CURVE}, {_suggest_sql('max')}
    SELECT {R('block', 9)} AS block, {R('review', 9)} AS review, 0e0 AS allow FROM s""",
)
def snk_threshold_suggestion(spark, sf):
    suggestion = thresholds.suggest_policy(_points(spark, sf))
    path = sinks.write_threshold_suggestion(suggestion, scratch_path(spark, "suggestion"), "2024-01")
    return tidy(spark.read.schema(suggestion.schema).json(path), 9)


@query(
    "pipe_fitted_score",
    f"""WITH {_SPLIT_SQL} SELECT {B('count(*)')} AS rows, {B('count(DISTINCT trans_num)')} AS ids,
      true AS in_range, true AS same_after_loading FROM split WHERE is_test""",
)
def pipe_fitted_score(spark, sf):
    """Fit from raw rows, save, load, and score the held-out rows with both."""
    raw = written(sampling.stratified_split(txn(spark, sf), key=sample_key()), "raw")
    trained = fitted.fit(raw.where(~F.col("is_test")).drop("is_test"), settings=_SMALL)
    path = scratch_path(spark, "fitted")
    fitted.save(trained, path)
    held = raw.where("is_test").drop("is_test", "fraud_probability")
    one = fitted.score(held, trained).select("trans_num", "fraud_probability")
    two = fitted.score(held, fitted.load(path)).select("trans_num", F.col("fraud_probability").alias("again"))
    p = F.col("fraud_probability")
    return one.join(two, "trans_num").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("trans_num").alias("ids"),
        F.every(p.between(0, 1)).alias("in_range"),
        F.every(p == F.col("again")).alias("same_after_loading"),
    )


@query(
    "enc_fitted_target",
    f"""WITH {_SPLIT_SQL}, t AS (SELECT txn.*, is_test FROM txn JOIN split USING (trans_num)),
    p AS (SELECT avg(is_fraud) AS prior FROM t WHERE NOT is_test),
    m AS (SELECT merchant, avg(is_fraud) AS mean, count(*) AS n FROM t WHERE NOT is_test GROUP BY 1)
    SELECT trans_num, {R('coalesce((mean * n + prior * 200) / (n + 200e0), prior)')} AS merchant_mean,
      {B("CASE category WHEN '' THEN 0 ELSE 1 END")} AS category_hot
    FROM t LEFT JOIN m USING (merchant), p WHERE is_test""",
)
def enc_fitted_target(spark, sf):
    """Categories of the held-out rows as the fitted pipeline encodes them."""
    raw = written(sampling.stratified_split(txn(spark, sf), key=sample_key()), "raw")
    trained = fitted.fit(
        raw.where(~F.col("is_test")).drop("is_test"), features=["amt", "hour"], settings=_ONE_TREE,
        one_hot=["category"], target_mean=["merchant"],
    )
    path = scratch_path(spark, "fitted")
    fitted.save(trained, path)
    out = fitted.load(path).transform(raw.where("is_test").drop("is_test", "fraud_probability"))
    hot = F.aggregate(vector_to_array("_h_category"), F.lit(0.0), lambda a, x: a + x)
    return tidy(out.select("trans_num", F.col("_t_merchant").alias("merchant_mean"), hot.cast("long").alias("category_hot")))
