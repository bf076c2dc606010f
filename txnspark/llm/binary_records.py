"""Length-delimited binary records of token ids, with a separate offset index.

A record is one document's sequence in a frame of

    8 bytes  length of the payload, little-endian
    4 bytes  masked crc32 of those 8 bytes
    payload  1 byte flags (1: no document number), 8 bytes document number,
             1 byte width of an id (2 or 4), the ids, little-endian
    4 bytes  masked crc32 of the payload
    1 byte   10, the end of the frame

The masked checksum is the crc rotated right by 15 bits plus a constant, so that a
checksum of bytes that hold checksums stays useful. Frames are written through
Spark's file committer, in ascending document order, to any file system Spark can
write; a lost task leaves nothing behind. The index is a Parquet table of
(file, offset, bytes, doc_id, n_tokens), built from the files themselves.

Defined results: a null text is an empty one; a null document number sorts first
and is read back as null; equal numbers keep one record per row; an empty table
gives no records; other columns are not read. A file holds about ``FILE_BYTES`` of text
and must stay below 2 GB; a single longer text makes reading fail.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from txnspark.llm.common import Batches, column, filled, map_batches, record
from txnspark.llm.tokens import encoder

#: Files whose starts are broadcast; with more, records are joined by a shuffle.
BROADCAST_FILES = 100_000
#: Bytes of text in one file, about; Spark reads a file back as one row of at most 2 GB.
FILE_BYTES = 256 << 20
MASK_DELTA = 0xA282EAD8
END = b"\n"
_HEAD = struct.Struct("<QI")
_META = struct.Struct("<BqB")

READ = (
    "file string, offset long, bytes long, doc_id long, n_tokens long, before long, "
    "ids binary"
)


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes) -> bytes:
    """One record; ``ids`` are little-endian unsigned 32-bit integers."""
    numbers = np.frombuffer(ids, "<u4")
    width = 2 if not len(numbers) or int(numbers.max()) < 1 << 16 else 4
    meta = _META.pack(int(doc_id is None), doc_id or 0, width)
    payload = meta + (numbers.astype("<u2").tobytes() if width == 2 else ids)
    length = struct.pack("<Q", len(payload))
    parts = (length, struct.pack("<I", masked_crc(length)), payload)
    return b"".join((*parts, struct.pack("<I", masked_crc(payload)), END))


def frames_of(data: memoryview, with_ids: bool = True) -> list[tuple[int, int, int | None, int, bytes]]:
    """(offset, bytes, doc_id, ids held, ids as unsigned 32-bit) of each record, checksums verified."""
    at, out = 0, []
    while at < len(data):
        length, check = _HEAD.unpack_from(data, at)
        if masked_crc(bytes(data[at : at + 8])) != check:
            raise ValueError(f"length checksum differs at byte {at}")
        payload = bytes(data[at + 12 : at + 12 + length])
        tail = at + 12 + length
        (check,) = struct.unpack_from("<I", data, tail)
        if len(payload) != length or masked_crc(payload) != check or data[tail + 4] != END[0]:
            raise ValueError(f"payload checksum differs at byte {at}")
        missing, doc_id, width = _META.unpack_from(payload)
        held = (length - _META.size) // width
        ids = b""
        if with_ids:
            ids = np.frombuffer(payload, f"<u{width}", offset=_META.size).astype("<u4").tobytes()
        out.append((at, tail + 5 - at, None if missing else doc_id, held, ids))
        at = tail + 5
    return out


def write_records(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int, files: int | None = None
) -> None:
    """Encode whole texts, append ``end_id``, write frames in ascending doc_id order.

    One range exchange of the texts orders the documents; each task then encodes and
    frames its own range. Equal numbers are told apart by their text's hash. Unless it
    is given, the number of files follows the bytes of text, so that files do not grow
    with the table.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    if files is None:
        held = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held // FILE_BYTES))
    rows = rows.repartitionByRange(files, *order)
    schema = pa.schema([("frame", pa.binary())])
    end = struct.pack("<I", end_id)

    def encode(batches: Batches) -> Batches:
        enc = encoder(tokenizer_path)
        for batch in batches:
            ids = enc.encode(filled(column(batch, "text")))
            numbers = column(batch, "doc_id").to_pylist()
            yield record(schema, [frame(n, i + end) for n, i in zip(numbers, ids, strict=True)])

    framed = map_batches(rows.sortWithinPartitions(*order), encode, "frame binary")
    # A frame's last byte is the line end that the text writer puts after each row.
    body = F.expr("substring(frame, 1, octet_length(frame) - 1)").cast("string")
    framed.select(body.alias("value")).write.option("compression", "none").text(path)


def read_records(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Records of all files with their places; ``before`` counts the ids before, in the file."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    schema = pa.schema(
        [("file", pa.string()), ("offset", pa.int64()), ("bytes", pa.int64()), ("doc_id", pa.int64())]
        + [("n_tokens", pa.int64()), ("before", pa.int64()), ("ids", pa.binary())]
    )

    def parse(batches: Batches) -> Batches:
        for batch in batches:
            for name, data in zip(column(batch, "file").to_pylist(), column(batch, "content"), strict=True):
                places = frames_of(memoryview(data.as_buffer()), with_ids)
                before = 0
                for at in range(0, len(places), 512):
                    part = places[at : at + 512]
                    offset, size, doc_id, held, ids = map(list, zip(*part, strict=True))
                    n = np.array(held, np.int64)
                    ends = before + np.cumsum(n)
                    yield record(schema, [name] * len(part), offset, size, doc_id, n, ends - n, ids)
                    before = int(ends[-1])

    name = F.element_at(F.split("path", "/"), -1).alias("file")
    return map_batches(found.select(name, "content"), parse, READ)


def file_number() -> F.Column:
    """The number in a file's name. Names have five digits and more beyond, so they do not sort as text."""
    return F.regexp_extract("file", r"^part-(\d+)", 1).cast("long")


def file_starts(records: DataFrame) -> DataFrame:
    """Ids before each file. One row per file: that number bounds the window's only task."""
    sums = records.groupBy("file").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy(file_number(), "file").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("file", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long").alias("base"))


def write_index(spark: SparkSession, path: str, index_path: str) -> None:
    """The offset index beside the records, one Parquet row per record."""
    places = read_records(spark, path, with_ids=False).drop("ids")
    places.write.parquet(index_path)


def fetch(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """The records at ``places`` (file, offset, bytes, any others), read at their offsets alone.

    Places of a file meet its bytes once; records that are not asked for are not parsed.
    Returns the columns of ``places`` with the record's ids.
    """
    kept = [c for c in places.columns if c not in ("file", "ids")]
    asked = places.groupBy("file").agg(F.collect_list(F.struct(*kept)).alias("_asked"))  # bounded by the file
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    found = found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    fields = ", ".join(f"{places.schema[c].name} {places.schema[c].dataType.simpleString()}" for c in kept)
    schema = pa.schema([("file", pa.string()), *((c, to_arrow_type(places.schema[c].dataType)) for c in kept), ("ids", pa.binary())])

    def cut(batches: Batches) -> Batches:
        for batch in batches:
            for name, data, wanted in zip(column(batch, "file").to_pylist(), column(batch, "content"), column(batch, "_asked"), strict=True):
                view, wanted = memoryview(data.as_buffer()), wanted.as_py()
                for at in range(0, len(wanted), 512):
                    part = wanted[at : at + 512]
                    ids = [frames_of(view[p["offset"] : p["offset"] + p["bytes"]])[0][4] for p in part]
                    yield record(schema, [name] * len(part), *[[p[c] for p in part] for c in kept], ids)

    return map_batches(found.join(asked, "file"), cut, f"file string, {fields}, ids binary")


def read_in_order(spark: SparkSession, path: str, index_path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): records joined to the global start of their file."""
    base = file_starts(spark.read.parquet(index_path))
    if base.count() <= BROADCAST_FILES:
        base = F.broadcast(base)
    records = read_records(spark, path)
    return records.join(base, "file").select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids"
    )


def shuffled(spark: SparkSession, path: str, index_path: str, seed: int) -> DataFrame:
    """Index entries in a random order that a seed fixes: a reading plan for training."""
    places = spark.read.parquet(index_path).select("file", "offset", "bytes", "doc_id", "n_tokens")
    return places.orderBy(*_shuffle(seed))


def _shuffle(seed: int) -> list:
    return [F.xxhash64(F.lit(seed), "file", "offset"), F.col("file"), F.col("offset")]


def read_shuffled(spark: SparkSession, path: str, index_path: str, seed: int) -> DataFrame:
    """Records (doc_id, n_tokens, ids) in the order of ``shuffled``, fetched through the index."""
    places = spark.read.parquet(index_path).select("file", "offset", "bytes", "doc_id", "n_tokens")
    return fetch(spark, path, places).orderBy(*_shuffle(seed)).select("doc_id", "n_tokens", "ids")
