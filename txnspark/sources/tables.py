"""Readers with fixed schemas for transactions and predictions."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DataType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

_text, _number, _whole = StringType(), DoubleType(), LongType()


def _schema(**columns: DataType) -> StructType:
    return StructType([StructField(n, t) for n, t in columns.items()])


TRANSACTIONS = _schema(
    trans_num=_text,
    trans_date_trans_time=TimestampNTZType(),
    cc_num=_whole,
    merchant=_text,
    category=_text,
    amt=_number,
    first=_text,
    last=_text,
    gender=_text,
    street=_text,
    city=_text,
    state=_text,
    zip=IntegerType(),
    lat=_number,
    long=_number,
    city_pop=_whole,
    job=_text,
    dob=DateType(),
    unix_time=_whole,
    merch_lat=_number,
    merch_long=_number,
    merch_zipcode=_number,
    is_fraud=IntegerType(),
)

PREDICTIONS = _schema(trans_num=_text, fraud_probability=_number, decision=_text)

# Columns an empty upload template offers.
TEMPLATE = _schema(
    transaction_id=_text,
    trans_date_trans_time=TimestampNTZType(),
    cc_num=_whole,
    amount=_number,
    lat=_number,
    long=_number,
    merch_lat=_number,
    merch_long=_number,
)

INDEX_COLUMN = "Unnamed: 0"


def read_table(
    spark: SparkSession,
    path: str,
    schema: StructType | None = None,
    fmt: str = "csv",
    encoding: str = "UTF-8",
) -> DataFrame:
    """Read CSV (with header), JSON, Parquet or ORC.

    CSV columns are matched by header name, so a schema may name them in any
    order and name only some of them. Spark replaces bytes that are no UTF-8 instead
    of failing; with ``encoding="auto"`` files that hold such bytes are found first and
    read as Latin-1, file by file.
    """
    if fmt == "csv" and encoding == "auto":
        return _read_mixed(spark, path, schema)
    if fmt == "csv":
        return _read_csv(spark, path, schema, encoding)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.format(fmt).load(path)


def encodings(spark: SparkSession, path: str) -> DataFrame:
    """(file, utf8): whether all lines of a file are UTF-8. One pass over the bytes, one row per file."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.is_valid_utf8("value").alias("valid"))
    return lines.groupBy("file").agg(F.every("valid").alias("utf8"))


def _read_mixed(spark: SparkSession, path: str, schema: StructType | None) -> DataFrame:
    """Every file by the encoding it is in. The driver holds the names of files, which it lists anyway."""
    found = [(unquote(r["file"]), r["utf8"]) for r in encodings(spark, path).collect()]
    latin = sorted(f for f, utf8 in found if not utf8)
    if not latin:
        return _read_csv(spark, path, schema, "UTF-8")
    out = _read_csv(spark, latin, schema, "ISO-8859-1")
    plain = sorted(f for f, utf8 in found if utf8)
    if not plain:
        return out
    return _read_csv(spark, plain, schema, "UTF-8").unionByName(out, allowMissingColumns=True)


def _read_csv(
    spark: SparkSession, path: str | list[str], schema: StructType | None, encoding: str
) -> DataFrame:
    reader = spark.read.option("header", True).option("encoding", encoding)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    names = reader.csv(path).columns
    wanted = {f.name: f.dataType for f in schema.fields}
    # Text first, so that one unreadable value costs a NULL and not the row.
    text = reader.schema(StructType([StructField(n, _text) for n in names])).csv(path)
    return text.select(
        *[text[f"`{n}`"].try_cast(wanted[n]).alias(n) for n in names if n in wanted]
    )


def read_transactions(
    spark: SparkSession, path: str, fmt: str = "csv", encoding: str = "UTF-8"
) -> DataFrame:
    return drop_index_column(read_table(spark, path, TRANSACTIONS, fmt, encoding))


def read_predictions(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return read_table(spark, path, PREDICTIONS, fmt)


def drop_index_column(df: DataFrame) -> DataFrame:
    return df.drop(INDEX_COLUMN)
