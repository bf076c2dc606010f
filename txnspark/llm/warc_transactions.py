"""WARC archives: written with duplicates as revisits, and put together again capture by capture.

A capture is written as three records: the request, the response (or a revisit, when
another capture has the same payload), and metadata; request and metadata name the
primary record in WARC-Concurrent-To. Archives are gzip files of about ``file_bytes``
before compression, written through Spark's committer. No page is exchanged for that:
payload digests are counted first, and what is looked up per page is one row for each
digest that occurs twice or more.

``captures`` reads archives back, from here or elsewhere, and joins records through
their identifiers: a record that names a primary record (or is named by one) is part of
its capture, one that names such a record too, and so on; records that lead to no
primary record form captures without one, by the identifiers they hold or name. One nested row is emitted per capture. A
capture of more than ``members`` records goes on in rows with a higher ``part``, so no
row grows without bound. Only identifiers and places are joined; blocks come along at
the end, and only if they are asked for.

Defined results: a null html is an empty payload; rows with equal payload and equal
page_id have one response among them; a null page_id comes last and is read back as
null; a null url has no WARC-Target-URI; white space and control characters in a url
are percent-encoded; an empty table makes no record and no capture; other columns are
not read. Payloads are equal if length and SHA-1 are. A damaged archive raises. A
compressed archive must be smaller than 2 GB, what Spark reads as one binary file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnspark.llm.common import Batches, column, map_batches, record
from txnspark.llm.components import components
from txnspark.operators import joins, ordered
from txnspark.sources.scratch import written

FILE_BYTES = 64 << 20
#: Requests and metadata of one capture in one row.
MEMBERS = 1000
#: Digests that are broadcast to the pages at most.
BROADCAST_DIGESTS = 100_000

VERSION, BREAK = b"WARC/1.1", b"\r\n\r\n"
PRIMARY = ("response", "revisit", "resource")
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SITE = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)")
_ODD = re.compile(r"[\x00-\x20\x7f]")

RECORD = (
    "file string, offset long, record_id string, type string, target_uri string, date string, "
    "concurrent_to array<string>, refers_to string, payload_digest string, payload_bytes long, "
    "fields map<string,string>"
)


# ------------------------------------------------------------------ writing


def _record(kind: str, ident: str, content_type: str, block: bytes, named: list[tuple[str, str | None]]) -> bytes:
    """One record without the two line ends after it."""
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<{ident}>"), *named, ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    head = b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in lines if v is not None)])
    return head + BREAK + block


def digest_text(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def capture_records(
    page_id: int | None, url: str | None, html: bytes, size: int, sha1: bytes, ident: str, first: str | None, date: str
) -> list[bytes]:
    """Request, response or revisit of ``first``, and metadata of one page."""
    uri = None if url is None else _ODD.sub(lambda m: quote(m.group()), url)
    site = _SITE.match(uri or "")
    host, path = site.groups() if site else ("", "")
    about = [("WARC-Target-URI", uri), ("WARC-Date", date)]
    beside = [*about, ("WARC-Concurrent-To", f"<{ident}>")]
    request = f"GET {path or '/'} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    digest = ("WARC-Payload-Digest", f"sha1:{digest_text(sha1)}")
    if first is None:
        primary = _record("response", ident, "application/http; msgtype=response", http + html, [*about, digest])
    else:
        again = [*about, digest, ("WARC-Profile", IDENTICAL), ("WARC-Refers-To", f"<{first}>")]
        primary = _record("revisit", ident, "application/http; msgtype=response", http, again)
    fields = b"" if page_id is None else f"page-id: {page_id}\r\n".encode()
    return [
        _record("request", uuid.uuid4().urn, "application/http; msgtype=request", request, beside),
        primary,
        _record("metadata", uuid.uuid4().urn, "application/warc-fields", fields, beside),
    ]


def _with_first(rows: DataFrame, least: int, broadcast_rows: int) -> tuple[DataFrame, int]:
    """Pages with ``_revisit`` (whether another page is the response) and the mean size of a page."""
    narrow = rows.select("page_id", "_payload", "_size")
    same = narrow.groupBy("_payload", "page_id", "_size").agg(F.count(F.lit(1)).alias("_n"))
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("_n").alias("copies"))).alias("_first")
    firsts = written(same.groupBy("_payload", "_size").agg(first, F.sum("_n").alias("_n")), "payloads")
    total, pages = firsts.agg(F.sum(F.col("_size") * F.col("_n")), F.sum("_n")).first()
    mean = (total or 0) // (pages or 1) + 1
    shared = firsts.where((F.col("_n") > 1) & (F.col("_size") >= least)).select("_payload", "_first")
    none = F.lit(None).cast(shared.schema["_first"].dataType)
    seen = joins.lookup(rows, shared, "_payload", "_first", none, broadcast_rows=broadcast_rows)
    is_first = F.col("_first").isNull() | F.col("page_id").eqNullSafe(F.col("_first.page_id"))
    seen = seen.withColumn("_revisit", ~is_first)
    if shared.where("_first.copies > 1").isEmpty():
        return seen.drop("_first"), mean
    # The same page with the same payload more than once: the rows are frozen, and one is chosen.
    tied = ~F.col("_revisit") & (F.coalesce(F.col("_first.copies"), F.lit(1)) > 1)
    ties = written(seen.where(tied).drop("_first").withColumn("_row", F.monotonically_increasing_id()), "ties")
    chosen = ties.groupBy("_payload").agg(F.min("_row").alias("_chosen"))
    ties = joins.lookup(ties, chosen, "_payload", "_chosen", F.lit(None).cast("long"), broadcast_rows=broadcast_rows)
    ties = ties.withColumn("_revisit", F.col("_row") != F.col("_chosen")).drop("_row", "_chosen")
    return seen.where(~tied).drop("_first").unionByName(ties), mean


def write_archives(
    pages: DataFrame, path: str, least: int = 0, date: str | None = None, file_bytes: int = FILE_BYTES,
    broadcast_rows: int = BROADCAST_DIGESTS,
) -> None:
    """Archives of pages (page_id, url, html). Of equal payloads of ``least`` bytes or more one is stored."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    size, sha1 = F.octet_length("html").cast("long"), F.sha1("html")
    rows = rows.withColumns({"_size": size, "_payload": F.concat(sha1, F.lit(":"), size.cast("string"))})
    rows, mean = _with_first(rows, least, broadcast_rows)
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    run = uuid.uuid4()
    schema = pa.schema([("value", pa.binary())])

    def frame(batches: Batches) -> Batches:
        for batch in batches:
            made = []
            for page_id, url, html, size, payload, again in zip(*(column(batch, c).to_pylist() for c in names), strict=True):
                # The response's identifier follows from the payload, so that revisits know it.
                known = uuid.uuid5(run, payload).urn
                ident = known if size >= least and not again else uuid.uuid4().urn
                sha1 = bytes.fromhex(payload[:40])
                made += capture_records(page_id, url, html, size, sha1, ident, known if again else None, date)
            yield record(schema, made)

    names = ["page_id", "url", "html", "_size", "_payload", "_revisit"]
    rows = rows.withColumn("html", F.when(~F.col("_revisit"), F.col("html")).otherwise(F.lit(b"")))
    framed = map_batches(rows.select(*names), frame, "value binary").select(F.col("value").cast("string").alias("value"))
    # Three records a page; a record's end is the text writer's line end.
    most = max(3, 3 * file_bytes // (mean + 1000))
    options = {"compression": "gzip", "lineSep": BREAK.decode(), "maxRecordsPerFile": most}
    framed.write.options(**options).text(path)


# ------------------------------------------------------------------ reading


class _Stream:
    """Bytes of an archive, unpacked piece by piece."""

    def __init__(self, data: memoryview):
        self.data, self.at, self.held, self.start = data, 0, bytearray(), 0
        self.packed = bytes(data[:2]) == b"\x1f\x8b"
        self.unpack = zlib.decompressobj(31) if self.packed else None

    def more(self) -> bool:
        if self.at >= len(self.data):
            return False
        piece = self.data[self.at : self.at + (1 << 20)]
        if not self.packed:
            self.held += piece
            self.at += len(piece)
            return True
        self.held += self.unpack.decompress(piece)
        self.at += len(piece)
        if self.unpack.eof:  # the next member
            self.at -= len(self.unpack.unused_data)
            self.unpack = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What stands before ``mark``, which is passed over."""
        searched = 0
        while (end := self.held.find(mark, searched)) < 0:
            searched = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                return None
        found = bytes(self.held[:end])
        self._drop(end + len(mark))
        return found

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        found = bytes(self.held[:n])
        self._drop(n)
        return found

    def _drop(self, n: int) -> None:
        del self.held[:n]
        self.start += n

    def ended(self) -> bool:
        while not self.held and self.more():
            pass
        return not self.held


def _named(lines: bytes) -> list[tuple[str, str]]:
    text = lines.decode("utf-8", "replace")
    text = re.sub(r"\r?\n[ \t]+", " ", text)  # folded lines
    pairs = (line.partition(":") for line in re.split(r"\r?\n", text) if ":" in line)
    return [(k.strip().lower(), v.strip()) for k, _, v in pairs]


def records_of(data: memoryview) -> Iterator[tuple[int, dict[str, str], list[str], bytes]]:
    """(offset, headers, identifiers it is concurrent to, block) of every record of an archive."""
    stream = _Stream(data)
    while not stream.ended():
        at = stream.start
        head = stream.until(BREAK)
        version, _, lines = (head or b"").partition(b"\r\n")
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        pairs = _named(lines)
        headers = dict(pairs)
        if not headers.get("content-length", "").isdigit():
            raise ValueError(f"no length at byte {at}")
        length = int(headers["content-length"])
        block = stream.take(length)
        if len(block) != length or stream.take(4) != BREAK:
            raise ValueError(f"record at byte {at} does not end where its length says")
        yield at, headers, [v.strip("<>") for k, v in pairs if k == "warc-concurrent-to"], block


def _payload(headers: dict[str, str], block: bytes) -> tuple[str | None, int | None]:
    """Digest and bytes of the full payload; a revisit states what it does not hold."""
    stated = headers.get("warc-payload-digest", "")
    stated = stated.removeprefix("sha1:").upper() if stated.startswith("sha1:") else None
    if headers.get("warc-type") == "revisit":
        size = dict(_named(block.partition(BREAK)[0])).get("content-length", "")
        return stated, int(size) if size.isdigit() else None
    if headers.get("warc-type") not in PRIMARY:
        return None, None
    payload = block.partition(BREAK)[2] if headers.get("content-type", "").startswith("application/http") else block
    found = digest_text(hashlib.sha1(payload).digest())
    if stated is not None and stated != found:
        raise ValueError(f"payload digest of {headers.get('warc-record-id')} differs")
    return found, len(payload)


def read_records(spark: SparkSession, path: str, blocks: bool = False) -> DataFrame:
    """All records below ``path``, lengths and payload digests verified; ``blocks`` adds their bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.*").load(path)
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.list_(pa.string()), pa.string(), pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
    names = ["file", "offset", "record_id", "type", "target_uri", "date", "concurrent_to", "refers_to", "payload_digest", "payload_bytes", "fields", "block"]
    schema = pa.schema(list(zip(names, kinds, strict=True))[: None if blocks else -1])

    def parse(batches: Batches) -> Batches:
        for batch in batches:
            for name, data in zip(column(batch, "file").to_pylist(), column(batch, "content"), strict=True):
                rows, held = [], 0
                for at, headers, beside, block in records_of(memoryview(data.as_buffer())):
                    digest, size = _payload(headers, block)
                    kind = headers.get("warc-type")
                    fields = _named(block) if kind == "metadata" and "warc-fields" in headers.get("content-type", "") else []
                    ident, refers = (headers.get(k, "").strip("<>") or None for k in ("warc-record-id", "warc-refers-to"))
                    row = (name, at, ident, kind, headers.get("warc-target-uri"), headers.get("warc-date"), beside, refers, digest, size, list(dict(fields).items()))
                    rows.append((*row, block) if blocks else row)
                    held += len(block) if blocks else 0
                    if len(rows) >= 2048 or held > 4 << 20:
                        yield record(schema, *map(list, zip(*rows, strict=True)))
                        rows, held = [], 0
                if rows:
                    yield record(schema, *map(list, zip(*rows, strict=True)))

    name = F.element_at(F.split("path", "/"), -1).alias("file")
    return map_batches(files.select(name, "content"), parse, RECORD + (", block binary" if blocks else ""))


# ----------------------------------------------------------------- assembly


def assign(records: DataFrame) -> DataFrame:
    """(record_id, capture_id): every request, metadata or other record with the capture it belongs to.

    A round looks at the records that have no capture yet. Archives whose records name
    their response need one; the last round finds nothing left.
    """
    primary = F.col("type").isin(*PRIMARY)
    named = records.select("record_id", primary.alias("_primary"), F.explode("concurrent_to").alias("_to"))
    placed = records.where(primary).select("record_id", F.col("record_id").alias("capture_id"))
    known = placed.select("record_id")
    # Either side may name the other.
    links = named.where(~F.col("_primary")).select("record_id", F.col("_to").alias("other"))
    links = links.unionByName(named.select(F.col("_to").alias("record_id"), F.col("record_id").alias("other")))
    links = links.join(known, "record_id", "left_anti").join(records.select("record_id"), "record_id", "left_semi").distinct()
    links = written(links, "links")
    found, open_links = None, links
    while not open_links.isEmpty():
        step = open_links.join(placed.withColumnRenamed("record_id", "other"), "other")
        step = written(step.groupBy("record_id").agg(F.min("capture_id").alias("capture_id")), "placed")
        if step.isEmpty():
            break
        found = step if found is None else found.unionByName(step)
        placed = step
        open_links = written(open_links.join(step.select("record_id"), "record_id", "left_anti"), "links")
    if found is None:
        found = placed.where(F.lit(False))
    rest = open_links.select(F.col("record_id").alias("a"), F.col("other").alias("b"))
    # What leads to no primary record: the smallest identifier among those they hold or name.
    alone = records.where(~primary & F.col("type").isin("request", "metadata")).join(found, "record_id", "left_anti").select("record_id")
    if alone.isEmpty():
        return found
    loose = components(rest).select(F.col("id").alias("record_id"), F.col("label").alias("_label"))
    own = alone.join(loose, "record_id", "left").select("record_id", F.coalesce("_label", "record_id").alias("capture_id"))
    return found.unionByName(own)


def captures(spark: SparkSession, path: str, blocks: bool = False, members: int = MEMBERS) -> DataFrame:
    """One nested row per capture: (capture_id, part, primary, requests, metadata).

    ``primary`` is the response, revisit or resource (null if the archives lack it),
    ``requests`` and ``metadata`` are arrays of records in the order of their places.
    """
    records = written(read_records(spark, path).where(F.col("record_id").isNotNull()), "records")
    return assemble(records, read_records(spark, path, True) if blocks else None, members)


def assemble(records: DataFrame, with_blocks: DataFrame | None = None, members: int = MEMBERS) -> DataFrame:
    """The captures of ``records``, with the blocks of ``with_blocks`` if given."""
    owners = written(assign(records), "owners")
    full = records if with_blocks is None else with_blocks
    fields = [F.col(c) for c in ("file", "offset", *[c for c in full.columns if c not in ("file", "offset")])]
    whole = F.struct(*fields)
    many = owners.groupBy(F.col("capture_id").alias("_c")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > members)
    many = ordered.broadcast_small(many)
    parts = F.coalesce(F.ceil(F.col("_n") / F.lit(members)), F.lit(1))
    salted = owners.join(many, F.col("capture_id") == F.col("_c"), "left").select(
        "record_id", "capture_id", F.pmod(F.xxhash64("record_id"), parts).cast("int").alias("part")
    )
    primary = F.col("type").isin(*PRIMARY)
    rows = full.where(~primary).join(salted, "record_id").select("capture_id", "part", "type", whole.alias("_record"))

    def all_of(kind: Column) -> Column:
        return F.sort_array(F.collect_list(F.when(kind, F.col("_record"))))

    request = F.col("type") == "request"
    # A map cannot be sorted; the records' fields come as entries here.
    entries = F.col("_record").withField("fields", F.map_entries("_record.fields"))
    grouped = rows.withColumn("_record", entries).groupBy("capture_id", "part").agg(
        all_of(request).alias("requests"), all_of(~request).alias("metadata")
    )
    own = full.where(primary).select(F.col("record_id").alias("capture_id"), F.lit(0).alias("part"), whole.alias("primary"))
    out = own.join(grouped, ["capture_id", "part"], "full")
    none = F.array().cast(grouped.schema["requests"].dataType)
    return out.select("capture_id", "part", "primary", *[F.coalesce(c, none).alias(c) for c in ("requests", "metadata")])
