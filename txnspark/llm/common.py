"""What several operators share: Arrow batches, words, checksums, code points of a batch."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bytes and rows of one Arrow batch. A single longer row still makes a batch of its own.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 4096

Batches = Iterator[pa.RecordBatch]


#: Where this package was imported from; Python workers on the same path find it there.
_HOME = str(Path(__file__).resolve().parents[2])


def map_batches(df: DataFrame, fn: Callable[[Batches], Batches], schema: str) -> DataFrame:
    """``mapInArrow`` with batches of bounded size, so a task holds one batch of texts."""
    environment = df.sparkSession.sparkContext.environment
    if _HOME not in environment.get("PYTHONPATH", "").split(os.pathsep):
        known = [p for p in (environment.get("PYTHONPATH"),) if p]
        environment["PYTHONPATH"] = os.pathsep.join([_HOME, *known])
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def as_array(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values))


def record(schema: pa.Schema, *columns: object) -> pa.RecordBatch:
    arrays = [
        c if isinstance(c, pa.Array) else pa.array(c, type=f.type)
        for c, f in zip(columns, schema, strict=True)
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def lists_of(values: pa.Array, lengths: np.ndarray) -> pa.Array:
    """Consecutive runs of ``values`` as a list array."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def filled(text: pa.Array) -> pa.Array:
    return pc.fill_null(text, "")


def flat_words(text: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words between ASCII white space of a batch, and how many each row has."""
    split = pc.ascii_split_whitespace(filled(text))
    words, rows = split.flatten(), pc.list_parent_indices(split).to_numpy()
    some = pc.greater(pc.binary_length(words), 0)
    if not pc.all(some, min_count=0).as_py():
        words = words.filter(some)
        rows = rows[some.to_numpy(zero_copy_only=False)]
    return words.dictionary_encode(), np.bincount(rows, minlength=len(text)).astype(np.int64)


def bytes_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a batch and the bounds of each row in them."""
    text = pc.cast(filled(text), pa.large_binary())
    bounds = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def doc_crc(doc_id: str = "doc_id") -> F.Column:
    """crc32 of the document's number written as text."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


#: Keys that are broadcast at most; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def row_key() -> F.Column:
    """A hash of a row's number and text: equal rows share a verdict."""
    return F.xxhash64(F.lit("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))


def without(docs: DataFrame, rejected: DataFrame, key: F.Column) -> DataFrame:
    """``docs`` without the rows whose ``key`` is in ``rejected`` (one column), filtered in place if few."""
    keys = rejected.select(F.col(rejected.columns[0]).alias("__rejected")).distinct()
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    kept = docs.withColumn("__key", key)
    same = kept["__key"] == keys["__rejected"]
    return kept.join(F.broadcast(keys) if few else keys, same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
