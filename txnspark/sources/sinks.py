"""Writers for predictions, queues, summaries and metrics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, DataFrameWriter
from pyspark.sql import functions as F

from txnspark.functions.scoring import sortable_score


# The default CSV time format stops at milliseconds.
CSV_TIME = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _writer(
    df: DataFrame, fmt: str, mode: str = "overwrite", encoding: str = "UTF-8"
) -> DataFrameWriter:
    writer = df.write.mode(mode).format(fmt)
    if fmt != "csv":
        return writer
    return writer.options(
        header=True, encoding=encoding, timestampFormat=CSV_TIME, timestampNTZFormat=CSV_TIME
    )


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "csv",
    mode: str = "overwrite",
    encoding: str = "UTF-8",
) -> None:
    _writer(df, fmt, mode, encoding).save(path)


def write_by_month(
    df: DataFrame, path: str, time: str = "trans_date_trans_time", fmt: str = "parquet"
) -> None:
    """One folder per month, so that an evaluation of one month reads only that.

    Build history features first: a card's window may start in an earlier month.
    """
    month = F.date_format(F.col(time), "yyyy-MM")
    _writer(df.withColumn("month", month), fmt).partitionBy("month").save(path)


def write_predictions(
    scored: DataFrame, path: str, id_column: str | None = "trans_num", fmt: str = "csv"
) -> None:
    """``[id,] fraud_probability, decision``."""
    ids = [id_column] if id_column and id_column in scored.columns else []
    write_table(scored.select(*ids, "fraud_probability", "decision"), path, fmt)


def write_scored(scored: DataFrame, path: str, fmt: str = "csv") -> None:
    """Input columns plus ``fraud_probability`` and ``fraud_prediction``."""
    write_table(scored, path, fmt)


def write_queues(df: DataFrame, path: str, id_column: str = "trans_num", fmt: str = "csv") -> None:
    """Block and review queues in one pass, highest scores in the first files.

    The rows are sorted here; hand them in unsorted.
    """
    queues = df.where(F.col("decision").isin("block", "review")).orderBy(
        "decision",
        sortable_score(F.col("fraud_probability")).desc_nulls_last(),
        id_column,
    )
    _writer(queues, fmt).partitionBy("decision").save(path)


def write_analyst_pack(tables: Mapping[str, DataFrame], root: str, fmt: str = "csv") -> None:
    """One folder per named table."""
    for name, df in tables.items():
        write_table(df, f"{root}/{name}", fmt)


def write_threshold_suggestion(record: DataFrame, root: str, month: str | None = None) -> str:
    """The suggested policy of a record (or a suggestion itself) as a JSON file of its own."""
    path = f"{root}/{month}/threshold_suggestion" if month else f"{root}/threshold_suggestion"
    nested = "threshold_suggestion" in record.columns
    suggestion = record.select("threshold_suggestion.*") if nested else record
    suggestion.coalesce(1).write.mode("overwrite").json(path)
    return path


def write_metrics(record: DataFrame, root: str, month: str | None = None) -> str:
    """One-row record as JSON, under the month when one is given."""
    path = f"{root}/{month}/metrics" if month else f"{root}/metrics"
    record.coalesce(1).write.mode("overwrite").json(path)
    return path
