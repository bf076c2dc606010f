"""Record files: numbers past five digits, and records fetched through the index."""

import public_tokenizers
from pyspark.sql import functions as F

from txnspark.llm import binary_records
from txnspark.llm.conversation_trie import member_checksums
from txnspark.sources.scratch import scratch_path


def test_files_are_in_the_order_of_their_numbers(spark):
    names = ["part-99998-x", "part-99999-x", "part-100000-x", "part-100001-x", "part-00000-x"]
    rows = spark.createDataFrame([(n, 10) for n in names] + [("part-99999-x", 5)], "file string, n_tokens long")
    starts = {r["file"]: r["base"] for r in binary_records.file_starts(rows).collect()}
    assert starts == {"part-00000-x": 0, "part-99998-x": 10, "part-99999-x": 20, "part-100000-x": 35, "part-100001-x": 45}


def test_records_are_fetched_at_their_offsets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(
        spark.createDataFrame([(None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    )
    path, index = scratch_path(spark, "records"), scratch_path(spark, "index")
    binary_records.write_records(docs, path, public_tokenizers.path("byte_bpe_50k.json"), 2, files=3)
    binary_records.write_index(spark, path, index)
    whole = {r["doc_id"]: bytes(r["ids"]) for r in binary_records.read_records(spark, path).collect()}
    plan = [r["doc_id"] for r in binary_records.shuffled(spark, path, index, 7).collect()]
    got = binary_records.read_shuffled(spark, path, index, 7).collect()
    assert [r["doc_id"] for r in got] == plan and plan != sorted(plan, key=lambda i: (i is not None, i or 0))
    assert {r["doc_id"]: bytes(r["ids"]) for r in got} == whole
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in got)
    some = spark.read.parquet(index).where("doc_id % 10 = 3").select("file", "offset", "bytes", "doc_id")
    part = binary_records.fetch(spark, path, some).collect()
    assert {r["doc_id"]: bytes(r["ids"]) for r in part} == {d: i for d, i in whole.items() if d is not None and d % 10 == 3}


def test_checksums_of_many_members(spark):
    import hashlib

    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("key"), F.col("id").alias("conv_id"))
    got = {r["key"]: r["ends_sha256"] for r in member_checksums(rows.repartition(7)).collect()}
    want = {}
    for i in range(20_000):
        want.setdefault("hot" if i % 3 == 0 else f"k{i % 500}", []).append(str(i))
    assert got == {k: hashlib.sha256(",".join(v).encode()).hexdigest() for k, v in want.items()}
