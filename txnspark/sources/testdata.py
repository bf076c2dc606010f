"""Card-transaction views over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The same text runs in Spark and in other SQL engines.
TXN_SQL = """SELECT event_id AS trans_num, user_id AS cc_num, ts AS trans_date_trans_time,
  value AS amt, event_type AS category,
  concat('fraud_m', CAST(event_id % 97 AS VARCHAR(9))) AS merchant,
  CASE WHEN user_id % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
  25e0 + (user_id*37 % 2400)/100e0 AS lat, -120e0 + (user_id*53 % 5000)/100e0 AS long,
  25e0 + (user_id*37 % 2400)/100e0 + ((event_id*29 % 2001) - 1000)/1000e0 AS merch_lat,
  -120e0 + (user_id*53 % 5000)/100e0 + ((event_id*41 % 2001) - 1000)/1000e0 AS merch_long,
  (event_id*7919 % 1009)/1008e0 AS fraud_probability,
  CASE WHEN (event_id*7919 % 1009) + (event_id*31 % 997)/10e0 > 990 THEN 1 ELSE 0 END AS is_fraud
FROM events"""

TIES_SQL = """SELECT o_orderkey AS trans_num, o_custkey AS cc_num,
  o_orderdate AS trans_date_trans_time, o_totalprice AS amt, o_orderpriority AS category
FROM orders"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _select(spark: SparkSession, sf_dir: str, source: str, text: str) -> DataFrame:
    return spark.sql(text.replace(f"FROM {source}", "FROM {source}"), source=table(spark, sf_dir, source))


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as card transactions with a synthetic score and label."""
    return _select(spark, sf_dir, "events", TXN_SQL)


def txn_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as card transactions; some share card and time."""
    return _select(spark, sf_dir, "orders", TIES_SQL)
