"""WARC archives: written, read back and put together, against plain Python."""

import base64
import gzip
import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from txnspark.llm import warc_transactions as warc
from txnspark.sources.scratch import scratch_path

SCHEMA = "page_id long, url string, html string, file string, type string, part int, _payload string, _revisit string"
BIG = "<p>größe</p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 3000


def pages():
    out = [
        (1, "http://a.example/x?q=1#f", "<p>one</p>"), (2, "https://b.example", "<p>one</p>"), (3, None, None), (4, "no url at all", ""),
        (5, "http://a.example/ü \r\nWARC-Type: x", BIG), (6, "http://[bad", BIG), (None, "http://a.example/n", "<p>one</p>"),
        (None, "http://a.example/m", "only nulls"), (None, "http://a.example/m", "only nulls"),
        (8, "http://a.example/same", "twice"), (8, "http://a.example/same", "twice"), (8, "http://a.example/other", "twice"), (9, "", "\r\n\r\n"),
    ]
    return [(*p, "f", "t", 1, "p", "r") for p in out + [(100 + i, f"http://c.example/{i}", "many copies") for i in range(60)]]


def wanted(rows, least):
    groups = defaultdict(list)
    for page_id, _, html, *_ in rows:
        groups[html or ""].append(page_id)
    out = []
    for html, ids in groups.items():
        size, digest = len(html.encode()), base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        ids.sort(key=lambda i: (i is None, i or 0))
        for n, page_id in enumerate(ids):
            again = n > 0 and size >= least
            out.append((page_id, size, digest, "revisit" if again else "response", ids[0] if again else None))
    return sorted(out, key=str)


def flat(spark, path, **options):
    fields = F.map_from_entries(F.get("metadata", 0)["fields"])
    rows = warc.captures(spark, path, **options).where("part = 0")
    own = {r["capture_id"]: (r["page_id"], r["primary"]) for r in rows.select("capture_id", fields["page-id"].cast("long").alias("page_id"), "primary").collect()}
    out = []
    for page_id, p in own.values():
        first = own[p["refers_to"]][0] if p["refers_to"] else None
        out.append((page_id, p["payload_bytes"], p["payload_digest"], p["type"], first))
    return sorted(out, key=str)


@pytest.mark.parametrize(("least", "file_bytes", "small"), [(0, 1 << 26, 1000), (6, 20_000, 0)])
def test_round_trip(spark, least, file_bytes, small):
    df = spark.createDataFrame(pages(), SCHEMA).repartition(3)
    path = scratch_path(spark, "warc")
    warc.write_archives(df, path, least, "2024-01-02T03:04:05Z", file_bytes, small)
    assert flat(spark, path) == wanted(pages(), least)
    # Three records a page, and each member of a capture names its primary record.
    rows = warc.read_records(spark, path, True).collect()
    assert len(rows) == 3 * len(pages())
    assert len({r["record_id"] for r in rows}) == len(rows)
    assert all(r["date"] == "2024-01-02T03:04:05Z" for r in rows if r["type"] != "other")
    payload = {r["block"].partition(b"\r\n\r\n")[2].decode() for r in rows if r["type"] == "response"}
    assert payload == {p[2] or "" for p in pages()}
    assert all(bytes(r["block"]).endswith(b"\r\n\r\n") for r in rows if r["type"] == "revisit")


def test_nested_rows_hold_the_blocks(spark):
    path = scratch_path(spark, "warc")
    warc.write_archives(spark.createDataFrame(pages()[:2], SCHEMA), path)
    out = warc.captures(spark, path, blocks=True).collect()
    assert len(out) == 2
    for r in out:
        assert len(r["requests"]) == len(r["metadata"]) == 1
        assert r["requests"][0]["block"].startswith(b"GET /")
        assert r["primary"]["concurrent_to"] == [] and r["requests"][0]["concurrent_to"] == [r["capture_id"]]
    assert {r["primary"]["block"].partition(b"\r\n\r\n")[2] for r in out} == {b"<p>one</p>", b""}


def made(kind, ident, beside=(), block=b"x: 1\r\n"):
    named = [("WARC-Concurrent-To", f"<{b}>") for b in beside]
    return warc._record(kind, ident, "application/warc-fields", block, named) + warc.BREAK




def test_links_in_either_direction_and_through_others(spark):
    one = [made("response", "r1", ["q1"]), made("request", "q1"), made("metadata", "m1", ["q1"]), made("metadata", "m2", ["m1"])]
    two = [made("metadata", "o1", ["o2"]), made("request", "o2"), made("request", "lost", ["absent"]), made("warcinfo", "w")]
    records = [r for part in (one, two) for r in part]
    frame = []
    for data in records:
        for _, headers, beside, block in warc.records_of(memoryview(data)):
            frame.append(("f", len(frame), headers["warc-record-id"].strip("<>"), headers["warc-type"], None, None, beside, None, None, None, {}))
            assert block == b"x: 1\r\n"
    out = {r["capture_id"]: r for r in warc.assemble(spark.createDataFrame(frame, warc.RECORD)).collect()}
    ids = {c: (r["primary"] and r["primary"]["record_id"], [x["record_id"] for x in r["requests"]], [x["record_id"] for x in r["metadata"]]) for c, r in out.items()}
    assert ids == {"r1": ("r1", ["q1"], ["m1", "m2"]), "o1": (None, ["o2"], ["o1"]), "absent": (None, ["lost"], [])}


def test_a_large_capture_goes_on_in_further_rows(spark):
    frame = [("f", i, f"m{i}", "metadata", None, None, ["r"], None, None, None, {}) for i in range(95)]
    frame.append(("f", 99, "r", "response", None, None, [], None, None, None, {}))
    out = warc.assemble(spark.createDataFrame(frame, warc.RECORD), members=20).collect()
    assert len(out) == 5 and sum(r["primary"] is not None for r in out) == 1
    assert sorted(x["record_id"] for r in out for x in r["metadata"]) == sorted(f"m{i}" for i in range(95))


def test_members_of_a_packed_archive_and_damage():
    whole = made("response", "r1", block=b"abc") + made("metadata", "m1", ["r1"])
    packed = b"".join(gzip.compress(r) for r in (made("response", "r1", block=b"abc"), made("metadata", "m1", ["r1"])))
    plain = [(at, h["warc-record-id"], beside, block) for at, h, beside, block in warc.records_of(memoryview(whole))]
    assert plain == [(at, h["warc-record-id"], beside, block) for at, h, beside, block in warc.records_of(memoryview(packed))]
    for broken in (whole[:-3], whole.replace(b"abc", b"abcd"), b"x" + whole):
        with pytest.raises(ValueError, match="byte"):
            list(warc.records_of(memoryview(broken)))
    headers = {"warc-type": "response", "warc-payload-digest": "sha1:AAAA", "warc-record-id": "r"}
    with pytest.raises(ValueError, match="digest"):
        warc._payload(headers, b"abc")


def test_no_page(spark):
    path = scratch_path(spark, "warc")
    warc.write_archives(spark.createDataFrame([], SCHEMA), path)
    assert warc.captures(spark, path).count() == 0
