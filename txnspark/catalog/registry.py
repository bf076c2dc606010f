"""Registry of queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegralType

from txnspark.functions.scoring import risk_tier
from txnspark.sources.testdata import TIES_SQL, TXN_SQL, txn

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Predictions with a few lost decisions, as a scoring run could leave them.
PRED_SQL = """SELECT trans_num, fraud_probability,
  CASE WHEN trans_num % 97 = 5 THEN CAST(NULL AS VARCHAR(9))
    WHEN fraud_probability >= 0.9e0 THEN 'block'
    WHEN fraud_probability >= 0.6e0 THEN 'review' ELSE 'allow' END AS decision
FROM txn"""


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``oracle`` may refer to the views txn, ties and pred."""

    def add(fn: Query) -> Query:
        put(name, fn, oracle)
        return fn

    return add


def put(name: str, fn: Query, oracle: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = fn
    if oracle is not None:
        ORACLES[name] = with_views(oracle)


def with_views(body: str) -> str:
    views = f"txn AS ({TXN_SQL}),\nties AS ({TIES_SQL}),\npred AS ({PRED_SQL})"
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"


def R(expr: str, digits: int = 6) -> str:
    """SQL rounding without negative zeros."""
    return f"(ROUND({expr}, {digits}) + 0e0)"


def B(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def tidy(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Integers as bigint and doubles rounded, for comparison across engines."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, IntegralType):
            c = c.cast("long")
        elif isinstance(f.dataType, DoubleType | FloatType):
            c = F.round(c.cast("double"), special.get(f.name, digits))
        out.append(c.alias(f.name))
    return df.select(*out)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = txn(spark, sf_dir)
    lost = F.col("trans_num") % 97 == 5
    decision = F.when(~lost, risk_tier(F.col("fraud_probability")))
    return rows.select("trans_num", "fraud_probability", decision.alias("decision"))
