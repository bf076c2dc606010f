"""The contract queries of the operators: opN_<name> over the whole intended tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnspark.llm import (
    binary_records,
    chat_repair,
    conversation_trie,
    decontamination,
    hilbert_shards,
    language_id,
    license_scan,
    merkle_manifest,
    ngram_join,
    packing,
    quality_classifier,
    quality_rules,
    warc_transactions,
)
from txnspark.llm.common import doc_crc
from txnspark.operators import joins
from txnspark.sources.scratch import scratch_path, written
from txnspark.sources.testdata import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every conversation with its repair and its rendered fragment."""
    return chat_repair.repair(table(spark, sf_dir, "conversations"))


@query
def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 runs of the curve through language, source and length."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", "n_chars",
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    out = hilbert_shards.shards(docs, ["lang", "source", "n_chars"], ["text_crc32", "size", "doc_id"])
    law, grown = F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return out.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown, "hilbert")


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from four fifths of the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    held_out = doc_crc() % 5 == 0
    model = language_id.train(docs.select("doc_id", "text", "lang").where(~held_out))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_per_byte")


@query
def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity component of every document: three-word shingles, Jaccard 0.9 or more."""
    return ngram_join.similarity_classes(table(spark, sf_dir, "documents"), k=3, percent=90)


# Every pair that shares a shingle, then everything reachable.
ORACLES["op4_ngram_join"] = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w]
  ELSE list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (shingle)
  WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id)
SELECT id AS doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(root) AS component_id
FROM r LEFT JOIN n ON n.doc_id = id GROUP BY id"""


@query
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from two thirds of the labels."""
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    held_out = doc_crc() % 3 == 1
    scored = quality_classifier.classify(docs, labels.where(~held_out))
    predicted = (F.col("score") >= 0.5).cast("int")
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", predicted.alias("predicted"))


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with its place in the folded text."""
    docs, benchmark = (table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return decontamination.contaminated(docs, benchmark)


@query
def op7_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the records read back from the written files."""
    path, index = scratch_path(spark, "records"), scratch_path(spark, "index")
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    binary_records.write_records(table(spark, sf_dir, "documents"), path, tokenizer, end_id=2)
    binary_records.write_index(spark, path, index)
    back = binary_records.read_in_order(spark, path, index)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer, end_id=1, length=2048)
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and license labels of every document."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    judged = quality_rules.judge(table(spark, sf_dir, "documents").drop("n_chars"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *counts, "base_failed", "kept", "distance2")




@query
def op11_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's capture, read back from the archives and put together from their records."""
    path = scratch_path(spark, "archives")
    warc_transactions.write_archives(table(spark, sf_dir, "pages"), path, least=0)
    fields = F.map_from_entries(F.get("metadata", 0)["fields"])
    page_id = fields["page-id"].cast("long").alias("page_id")
    taken = ["payload_bytes", "payload_digest", F.col("primary.type").alias("record_type")]
    rows = warc_transactions.captures(spark, path).where("part = 0").select(
        page_id, "capture_id", *[F.col(f"primary.{c}") if isinstance(c, str) else c for c in taken],
        F.col("primary.refers_to").alias("_first"),
    )
    rows = written(rows, "captures")
    # A revisit names the response's record; its page is that of the response's capture.
    named = rows.where("record_type = 'response'").select(F.col("capture_id").alias("_first"), F.col("page_id").alias("refers_to"))
    again, first = rows.where("_first IS NOT NULL"), rows.where("_first IS NULL")
    none = F.lit(None).cast("long")
    out = joins.lookup(again, named, "_first", "refers_to", none).unionByName(first.withColumn("refers_to", none))
    return out.drop("_first", "capture_id")


# SHA-1 in groups of five bits.
ORACLES["op11_warc_transactions"] = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
s AS (SELECT *, sha1(body) AS hex FROM p),
b AS (SELECT *, array_to_string(list_transform(string_split(hex, ''), lambda c: lpad(bin(instr('0123456789abcdef', c) - 1), 4, '0')), '') AS bits
  FROM s),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, body, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST('0b' || substr(bits, 5 * i + 1, 5) AS BIGINT) + 1, 1)), '') AS payload_digest FROM b),
f AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""
@query
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all conversations, their first turns taken from every 20th one."""
    turns = conversation_trie.turns(table(spark, sf_dir, "conversations"))
    rebuilt = conversation_trie.with_shared_heads(turns, 20, (doc_crc("conv_id") % 4).cast("int"), 3)
    return conversation_trie.trie(rebuilt).drop("turn_id", "words")


# The checksum of a short text, bit by bit.
CRC_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({0} AS VARCHAR), ''),
    lambda ch: CAST(ord(ch) AS BIGINT))), lambda acc, b: list_reduce(list_prepend(xor(acc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))))"""


# Prefixes as lists of turns; what a subtree holds by comparing every node with every other.
ORACLES["op12_conversation_trie"] = rf"""WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i FROM conversations),
c AS (SELECT DISTINCT conv_id, {CRC_SQL.format('conv_id')} % 4 AS h FROM conversations),
r AS (SELECT c.conv_id, 0 AS part, i, {{{{'role': role, 'text': text}}}} AS t FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 20 AND i <= h
  UNION ALL SELECT c.conv_id, 1, i, {{{{'role': role, 'text': text}}}} FROM c JOIN o ON o.conv_id = c.conv_id AND i > h),
w AS (SELECT c.conv_id, coalesce(list(t ORDER BY part, i) FILTER (t IS NOT NULL), []) AS ts FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id),
x AS (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS d FROM w),
n AS (SELECT d, ts[1:d] AS p, min(conv_id) AS conv_id, count(*) AS n,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = len(ts)), '') AS ends FROM x GROUP BY d, ts[1:d]),
k AS (SELECT n.*, u.conv_id AS up, (SELECT count(*) FROM n v WHERE v.d = n.d + 1 AND v.p[1:n.d] = n.p) AS kids,
    (n.n - 1) * CASE WHEN n.d = 0 THEN 0 ELSE len(regexp_extract_all(n.p[n.d].text, '[^ 	-
]+')) END AS own
  FROM n LEFT JOIN n u ON u.d = n.d - 1 AND u.p = n.p[1:n.d - 1])
SELECT k.conv_id, CAST(k.d AS BIGINT) AS depth, k.up AS parent_conv_id, k.n AS n_convs, k.kids AS n_children,
  count(*) FILTER (b.kids = 0) AS n_leaves, CAST(sum(b.own) AS BIGINT) AS saved_tokens, sha256(k.ends) AS ends_sha256
FROM k JOIN k b ON b.d >= k.d AND b.p[1:k.d] = k.p GROUP BY ALL""".replace("{{", "{").replace("}}", "}")


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof, and the root that its leaf, tampered with or not, leads to."""
    changed = {"n_chars": F.col("n_chars") + 1}
    leaves = merkle_manifest.leaves(table(spark, sf_dir, "documents"), tampered=changed, where=doc_crc() % 7 == 0)
    tree = merkle_manifest.build(leaves)
    text = {c: F.lower(F.hex(c)) for c in ("digest", "subroot", "proof", "folded")}
    return merkle_manifest.fold(tree, leaves).select(
        F.col("key").alias("doc_id"), text["digest"].alias("leaf"), text["subroot"].alias("subroot"),
        F.lit(tree.root).alias("root"), text["proof"].alias("proof_sha256"), text["folded"].alias("folded_root"),
        (text["folded"] == F.lit(tree.root)).alias("verified"),
    )


def _leaf_sql(n_chars: str) -> str:
    fields = ("doc_id", "source", "lang", n_chars, "text")
    parts = [f"coalesce(strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR), '-')" for f in fields]
    return f"sha256({' || '.join(parts)})"


ORACLES["op13_merkle_manifest"] = f"""WITH RECURSIVE d AS (SELECT doc_id, lang,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS idx, {_leaf_sql('n_chars')} AS leaf,
    CASE WHEN {CRC_SQL.format('doc_id')} % 7 = 0 THEN {_leaf_sql('(n_chars + 1)')} ELSE {_leaf_sql('n_chars')} END AS given
  FROM documents),
n AS (SELECT lang, 0 AS lvl, idx, leaf AS h, count(*) OVER (PARTITION BY lang) AS c FROM d
  UNION ALL SELECT lang, lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (any_value(c) + 1) // 2
  FROM n WHERE c > 1 GROUP BY lang, lvl, idx // 2),
s AS (SELECT lang, h AS subroot, lvl AS depth, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM n WHERE c = 1),
m AS (SELECT 0 AS lvl, place AS idx, subroot AS h, count(*) OVER () AS c FROM s
  UNION ALL SELECT lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (any_value(c) + 1) // 2
  FROM m WHERE c > 1 GROUP BY lvl, idx // 2),
t AS (SELECT h AS root, lvl AS depth FROM m WHERE c = 1),
up AS (SELECT doc_id, lang, leaf, 0 AS lvl, idx, given AS h, '' AS passed FROM d
  UNION ALL SELECT up.doc_id, up.lang, up.leaf, up.lvl + 1, up.idx // 2,
    sha256(CASE WHEN n.h IS NULL THEN up.h WHEN up.idx % 2 = 0 THEN up.h || n.h ELSE n.h || up.h END), passed || coalesce(n.h, '')
  FROM up JOIN s ON s.lang IS NOT DISTINCT FROM up.lang AND up.lvl < s.depth
  LEFT JOIN n ON n.lang IS NOT DISTINCT FROM up.lang AND n.lvl = up.lvl AND n.idx = xor(up.idx, 1)),
a AS (SELECT up.doc_id, leaf, subroot, 0 AS lvl, place AS idx, h, passed
    FROM up JOIN s ON s.lang IS NOT DISTINCT FROM up.lang AND up.lvl = s.depth
  UNION ALL SELECT a.doc_id, a.leaf, a.subroot, a.lvl + 1, a.idx // 2,
    sha256(CASE WHEN m.h IS NULL THEN a.h WHEN a.idx % 2 = 0 THEN a.h || m.h ELSE m.h || a.h END), passed || coalesce(m.h, '')
  FROM a JOIN t ON a.lvl < t.depth LEFT JOIN m ON m.lvl = a.lvl AND m.idx = xor(a.idx, 1))
SELECT doc_id, leaf, subroot, root, sha256(passed) AS proof_sha256, h AS folded_root, h = root AS verified
FROM a JOIN t ON a.lvl = t.depth"""
