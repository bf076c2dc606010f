"""Sources, sinks and column operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnspark.catalog.registry import B, R, predictions, query, tidy
from txnspark.operators import columns, joins, reports, sampling
from txnspark.plans import features, jobs
from txnspark.sources import sinks, tables
from txnspark.sources.scratch import scratch_path
from txnspark.sources.testdata import txn

TS = "strftime(trans_date_trans_time, '%Y-%m-%d %H:%M:%S.%f')"


def stamp(name="trans_date_trans_time"):
    return F.date_format(F.col(name), "yyyy-MM-dd HH:mm:ss.SSSSSS")


# ------------------------------------------------------------------- sources

_RAW_SQL = f"""SELECT CAST(trans_num AS VARCHAR) AS trans_num, {TS} AS ts, cc_num, merchant,
  category, {R('amt')} AS amt, gender, {R('lat')} AS lat, {R('long')} AS long,
  {R('merch_lat')} AS merch_lat, {R('merch_long')} AS merch_long, {B('is_fraud')} AS is_fraud
FROM txn"""


@query("src_transactions", _RAW_SQL)
def src_transactions(spark, sf):
    path = scratch_path(spark, "transactions")
    raw = txn(spark, sf).drop("fraud_probability").withColumn("Unnamed: 0", F.col("trans_num"))
    sinks.write_table(raw, path)
    out = tables.read_transactions(spark, path)
    return tidy(out.withColumn("ts", stamp()).drop("trans_date_trans_time"))


@query(
    "src_latin1",
    "SELECT trans_num, concat('café ', category) AS place FROM txn",
)
def src_latin1(spark, sf):
    path = scratch_path(spark, "latin1")
    rows = txn(spark, sf).select("trans_num", F.concat(F.lit("café "), "category").alias("place"))
    sinks.write_table(rows, path, encoding="ISO-8859-1")
    return tables.read_table(spark, path, rows.schema, encoding="ISO-8859-1")


@query(
    "src_mixed_encodings",
    "SELECT trans_num, concat('café ', category) AS place FROM txn",
)
def src_mixed_encodings(spark, sf):
    """Files of both encodings in one folder, told apart by their bytes."""
    path = scratch_path(spark, "mixed")
    rows = txn(spark, sf).select("trans_num", F.concat(F.lit("café "), "category").alias("place"))
    for odd, encoding in ((0, "UTF-8"), (1, "ISO-8859-1")):
        part = rows.where(F.col("trans_num") % 2 == odd)
        part.write.mode("append").option("header", True).option("encoding", encoding).csv(path)
    return tables.read_table(spark, path, rows.schema, encoding="auto")


@query("src_drop_index_col", f"SELECT trans_num, cc_num, {R('amt')} AS amt FROM txn")
def src_drop_index_col(spark, sf):
    rows = txn(spark, sf).select("trans_num", "cc_num", "amt")
    return tidy(tables.drop_index_column(rows.withColumn("Unnamed: 0", F.col("trans_num"))))


_PRED_OUT = f"""SELECT CAST(trans_num AS VARCHAR) AS trans_num,
  {R('fraud_probability')} AS fraud_probability, decision FROM pred"""


@query("src_predictions", _PRED_OUT)
def src_predictions(spark, sf):
    path = scratch_path(spark, "predictions")
    predictions(spark, sf).write.json(path)
    return tidy(tables.read_predictions(spark, path, "json"))


# --------------------------------------------------------------------- sinks


@query("snk_predictions", _PRED_OUT)
def snk_predictions(spark, sf):
    path = scratch_path(spark, "predictions")
    sinks.write_predictions(predictions(spark, sf), path)
    return tidy(tables.read_predictions(spark, path))


@query(
    "snk_scored",
    f"""SELECT trans_num, cc_num, {R('amt')} AS amt, {R('fraud_probability')} AS fraud_probability,
      {B('CASE WHEN fraud_probability >= 0.5e0 THEN 1 ELSE 0 END')} AS fraud_prediction FROM txn""",
)
def snk_scored(spark, sf):
    path = scratch_path(spark, "scored")
    scored = jobs.app_panels(
        txn(spark, sf).select("trans_num", "cc_num", "amt", "fraud_probability")
    )["scored"]
    sinks.write_scored(scored, path)
    return tidy(tables.read_table(spark, path, scored.schema))


@query(
    "snk_queues",
    f"""SELECT trans_num, category, {R('fraud_probability')} AS fraud_probability, decision
    FROM txn JOIN pred USING (trans_num, fraud_probability)
    WHERE decision IN ('block', 'review')""",
)
def snk_queues(spark, sf):
    path = scratch_path(spark, "queues")
    rows = txn(spark, sf).select("trans_num", "category")
    joined = joins.join_predictions(rows, predictions(spark, sf))
    sinks.write_queues(joined, path, fmt="parquet")
    out = spark.read.parquet(path)
    return tidy(out.withColumn("decision", F.col("decision").cast("string")))


@query(
    "snk_analyst_pack",
    f"""WITH j AS (SELECT t.*, p.decision FROM txn t JOIN pred p USING (trans_num)),
    f AS (SELECT * FROM j WHERE decision IS NULL OR decision <> 'allow'),
    m AS (SELECT merchant AS k, count(*) AS n, avg(fraud_probability) AS p FROM f GROUP BY 1
      ORDER BY p DESC, k LIMIT 50)
    SELECT decision AS sheet, CAST(trans_num AS VARCHAR) AS item, CAST(1 AS BIGINT) AS n,
      {R('fraud_probability')} AS p FROM j WHERE decision IN ('block', 'review')
    UNION ALL SELECT 'summary_by_category', category, count(*), {R('avg(fraud_probability)')}
      FROM f GROUP BY category
    UNION ALL SELECT 'top_merchants', k, n, {R('p')} FROM m
    UNION ALL SELECT 'summary_by_hour', CAST(hour(trans_date_trans_time) AS VARCHAR),
      count(fraud_probability), {R('avg(fraud_probability)')} FROM j GROUP BY 2""",
)
def snk_analyst_pack(spark, sf):
    root = scratch_path(spark, "pack")
    pack = jobs.review_queues(txn(spark, sf).drop("fraud_probability"), predictions(spark, sf))
    sinks.write_analyst_pack(pack, root, "parquet")
    item = {
        "block": ("trans_num", F.lit(1), "fraud_probability"),
        "review": ("trans_num", F.lit(1), "fraud_probability"),
        "summary_by_category": ("category", F.col("count"), "avg_prob"),
        "top_merchants": ("merchant", F.col("count"), "avg_prob"),
        "summary_by_hour": ("hour", F.col("flagged"), "avg_prob"),
    }
    out = None
    for sheet, (key, n, p) in item.items():
        part = spark.read.parquet(f"{root}/{sheet}").select(
            F.lit(sheet).alias("sheet"),
            F.col(key).cast("string").alias("item"),
            n.cast("long").alias("n"),
            F.col(p).alias("p"),
        )
        out = part if out is None else out.unionByName(part)
    return tidy(out)


@query(
    "snk_metrics_json",
    f"""SELECT {B('count(*)')} AS rows, {B("count(*) FILTER (decision IS NULL OR decision <> 'allow')")}
      AS flags_total, {B("count(*) FILTER (decision = 'block')")} AS block_rows,
      (SELECT strftime(max(trans_date_trans_time), '%Y-%m') FROM txn) AS month FROM pred""",
)
def snk_metrics_json(spark, sf):
    rows = joins.join_for_evaluation(txn(spark, sf), predictions(spark, sf))
    record = reports.monthly_header(rows)
    month = record.first()["month"]
    path = sinks.write_metrics(record, scratch_path(spark, "metrics"), month)
    return spark.read.schema(record.schema).json(path).select(
        "rows", "flags_total", F.col("tier_counts")["block"].alias("block_rows"), "month"
    )


# ------------------------------------------------------------------- columns

_JUNK = "CASE WHEN trans_num % 10 = 3 THEN 0e0 ELSE amt END"


def _amount_text(df):
    return F.when(F.col("trans_num") % 10 == 3, "n/a").otherwise(F.col("amt").cast("string"))


@query(
    "proj_alias_resolve",
    f"""SELECT CAST(trans_num AS VARCHAR) AS trans_num, cc_num, {R(_JUNK)} AS amt, {R('lat')} AS lat,
      {R('long')} AS long, {R('merch_lat')} AS merch_lat, {R('merch_long')} AS merch_long,
      0e0 AS merch_zipcode FROM txn""",
)
def proj_alias_resolve(spark, sf):
    t = txn(spark, sf)
    named = t.select(
        F.col("trans_num").alias("transaction_id"),
        F.col("cc_num").alias("user_id"),
        _amount_text(t).alias("amount"),
        F.col("lat").alias("home_lat"),
        F.col("long").alias("lng"),
        F.col("merch_lat").alias("merchant_lat"),
        F.col("merch_long").alias("merch_lng"),
    )
    out = columns.resolve_aliases(named)
    return tidy(
        out.select(
            "trans_num", "cc_num", "amt", "lat", "long", "merch_lat", "merch_long", "merch_zipcode"
        )
    )


@query(
    "proj_synth_id",
    f"""SELECT CAST(row_number() OVER (ORDER BY trans_date_trans_time, cc_num) - 1 AS VARCHAR)
      AS trans_num, cc_num, {R('amt')} AS amt FROM txn""",
)
def proj_synth_id(spark, sf):
    rows = txn(spark, sf).select("trans_date_trans_time", "cc_num", "amt")
    out = columns.synth_id(rows, ["trans_date_trans_time", "cc_num"])
    return tidy(out.select("trans_num", "cc_num", "amt"))


@query("proj_coerce_numeric", f"SELECT trans_num, {R(_JUNK)} AS amt FROM txn")
def proj_coerce_numeric(spark, sf):
    t = txn(spark, sf)
    return tidy(columns.coerce_numeric(t.select("trans_num", _amount_text(t).alias("amt")), ["amt"]))


@query(
    "proj_object_to_numeric",
    f"""SELECT CAST(trans_num AS VARCHAR) AS trans_num, CAST(cc_num AS DOUBLE) AS card_text,
      category, {R('amt')} AS amt FROM txn""",
)
def proj_object_to_numeric(spark, sf):
    text = txn(spark, sf).select(
        F.col("trans_num").cast("string").alias("trans_num"),
        F.col("cc_num").cast("string").alias("card_text"),
        "category",
        "amt",
    )
    return tidy(columns.object_to_numeric(text))


@query(
    "proj_want_cols",
    f"""SELECT trans_num, {B('hour(trans_date_trans_time)')} AS hour,
      {B('CASE WHEN isodow(trans_date_trans_time) >= 6 THEN 1 ELSE 0 END')} AS is_weekend,
      {B('row_number() OVER (PARTITION BY cc_num ORDER BY trans_date_trans_time, trans_num)')}
      AS transaction_count FROM txn""",
)
def proj_want_cols(spark, sf):
    want = ["hour", "is_weekend", "transaction_count"]
    return tidy(features.build(txn(spark, sf), want, "eval").select("trans_num", *want))


_EXPECTED = ["amt", "code_text", "not_there", "cc_num"]


def _mixed(spark, sf):
    t = txn(spark, sf)
    return t.select(
        "trans_num",
        "category",
        "cc_num",
        _amount_text(t).alias("code_text"),
        F.when(F.col("trans_num") % 11 != 0, F.col("amt")).alias("amt"),
    )


def _aligned_sql(fill):
    return f"""SELECT trans_num, {R('CASE WHEN trans_num % 11 <> 0 THEN amt END')} AS amt,
      {R(_JUNK)} AS code_text, {fill} AS not_there, cc_num FROM txn"""


@query("proj_align_numeric", _aligned_sql("0e0"))
def proj_align_numeric(spark, sf):
    return tidy(columns.align(_mixed(spark, sf), _EXPECTED, keep=["trans_num"]))


@query("proj_align_reindex", _aligned_sql("0e0"))
def proj_align_reindex(spark, sf):
    return tidy(columns.align(_mixed(spark, sf), _EXPECTED, fill=0.0, keep=["trans_num"]))


@query("proj_align_model", _aligned_sql("CAST(0 AS BIGINT)"))
def proj_align_model(spark, sf):
    return tidy(columns.align(_mixed(spark, sf), _EXPECTED, fill=0, keep=["trans_num"]))


@query(
    "proj_score_fill_missing",
    f"SELECT trans_num, cc_num, {R('amt')} AS amt, CAST(0 AS BIGINT) AS not_there FROM txn",
)
def proj_score_fill_missing(spark, sf):
    rows = txn(spark, sf).select("trans_num", "cc_num", "amt")
    return tidy(columns.fill_missing(rows, ["amt", "not_there"]))


@query("proj_drop_labels", f"SELECT trans_num, {R('amt')} AS amt FROM txn")
def proj_drop_labels(spark, sf):
    rows = txn(spark, sf).select("trans_num", "amt", "is_fraud", F.col("is_fraud").alias("target"))
    return tidy(columns.drop_present(rows, columns.LABELS_BATCH))


@query(
    "proj_drop_ids_leakage",
    f"""SELECT {R('amt')} AS amt, {R('lat')} AS lat, {R('long')} AS long,
      {R('merch_lat')} AS merch_lat, {R('merch_long')} AS merch_long,
      {R('fraud_probability')} AS fraud_probability, category, merchant, gender FROM txn""",
)
def proj_drop_ids_leakage(spark, sf):
    return tidy(columns.drop_present(txn(spark, sf), columns.LEAKAGE["baseline"]))


@query(
    "proj_numeric_only",
    f"""SELECT trans_num, cc_num, {R('coalesce(CASE WHEN trans_num % 11 <> 0 THEN amt END, 0e0)')}
      AS amt FROM txn""",
)
def proj_numeric_only(spark, sf):
    return tidy(columns.numeric_only(_mixed(spark, sf)))


@query(
    "proj_whitelist",
    f"""SELECT trans_num, {R('amt')} AS amt, {B('hour(trans_date_trans_time)')} AS hour FROM txn""",
)
def proj_whitelist(spark, sf):
    rows = features.build(txn(spark, sf), ["hour"], "eval")
    return tidy(columns.whitelist(rows, columns.KEEP_MODEL, keep=["trans_num"]))


@query(
    "proj_inf_to_zero",
    f"SELECT trans_num, {R('CASE WHEN trans_num % 7 < 3 THEN 0e0 ELSE amt END')} AS amt FROM txn",
)
def proj_inf_to_zero(spark, sf):
    kind = F.col("trans_num") % 7
    odd = (
        F.when(kind == 0, float("inf"))
        .when(kind == 1, float("nan"))
        .when(kind == 2, F.lit(None).cast("double"))
        .otherwise(F.col("amt"))
    )
    return tidy(columns.inf_to_zero(txn(spark, sf).select("trans_num", odd.alias("amt")), ["amt"]))


@query(
    "proj_sanitize_names",
    f"SELECT trans_num, {R('amt')} AS amt_usd, cc_num AS amt_usd_1, category AS col FROM txn",
)
def proj_sanitize_names(spark, sf):
    rows = txn(spark, sf).select("trans_num", "amt", "cc_num", "category")
    return tidy(columns.sanitize(rows.toDF("trans num", "amt (usd)", "amt__usd_", "?!")))


@query("proj_clean_colon", f"SELECT trans_num, {R('amt')} AS usd_amt, category FROM txn")
def proj_clean_colon(spark, sf):
    rows = txn(spark, sf).select("trans_num", "amt", "category")
    return tidy(columns.clean_colons(rows.toDF("trans_num", "usd:amt", " category ")))


@query("proj_dedupe_columns", f"SELECT trans_num, {R('amt')} AS amt FROM txn")
def proj_dedupe_columns(spark, sf):
    rows = txn(spark, sf).select("trans_num", "amt", "cc_num").toDF("trans_num", "amt", "amt")
    return tidy(columns.dedupe_columns(rows))


@query(
    "proj_safe_display",
    f"""SELECT trans_num AS transaction_id, {R('amt')} AS amount, cc_num AS customer_id,
      {B('is_fraud')} AS is_fraud, {R('fraud_probability')} AS fraud_probability FROM txn""",
)
def proj_safe_display(spark, sf):
    return tidy(columns.safe_display(txn(spark, sf)))


# ------------------------------------------------------------------- filters


@query(
    "flt_decision",
    f"""SELECT trans_num, {R('fraud_probability')} AS fraud_probability FROM pred
    WHERE decision = 'block'""",
)
def flt_decision(spark, sf):
    return tidy(reports.of_tier(predictions(spark, sf), "block").drop("decision"))


@query(
    "flt_flagged",
    """SELECT trans_num, coalesce(decision, 'lost') AS decision FROM pred
    WHERE decision IS NULL OR decision <> 'allow'""",
)
def flt_flagged(spark, sf):
    out = reports.flagged(predictions(spark, sf))
    return out.select("trans_num", F.coalesce("decision", F.lit("lost")).alias("decision"))


@query(
    "flt_temporal_holdout",
    """SELECT trans_num, coalesce(CASE WHEN trans_num % 13 <> 0 THEN trans_date_trans_time END
      >= TIMESTAMP '2024-01-21', false) AS is_test FROM txn""",
)
def flt_temporal_holdout(spark, sf):
    time = F.when(F.col("trans_num") % 13 != 0, F.col("trans_date_trans_time"))
    rows = txn(spark, sf).select("trans_num", time.alias("trans_date_trans_time"))
    return sampling.temporal_holdout(rows, "2024-01-21").select("trans_num", "is_test")


_SHOW = ["merchant", "category", "amt", "hour", "no_such_column"]
_VIEW_SQL = f"""SELECT trans_num, merchant, category, {R('amt')} AS amt,
  {B('is_fraud')} AS true_label, {B('CASE WHEN fraud_probability >= 0.9e0 THEN 1 ELSE 0 END')}
  AS pred_label, {R('fraud_probability')} AS pred_prob FROM txn"""


def _view(spark, sf):
    return reports.error_view(txn(spark, sf), 0.9, _SHOW)


@query("ev_error_view", _VIEW_SQL)
def ev_error_view(spark, sf):
    return tidy(_view(spark, sf))


@query(
    "flt_false_positives",
    f"""{_VIEW_SQL} WHERE is_fraud = 0 AND fraud_probability >= 0.9e0
    ORDER BY fraud_probability DESC, trans_num LIMIT 10""",
)
def flt_false_positives(spark, sf):
    return tidy(reports.false_positives(_view(spark, sf)))


@query(
    "flt_false_negatives",
    f"""{_VIEW_SQL} WHERE is_fraud = 1 AND NOT fraud_probability >= 0.9e0
    ORDER BY fraud_probability, trans_num LIMIT 10""",
)
def flt_false_negatives(spark, sf):
    return tidy(reports.false_negatives(_view(spark, sf)))
