"""Every switch between a broadcast and a shuffle: both sides give the same rows."""

import public_tokenizers
import pytest

from txnspark.llm import binary_records, common, decontamination, license_scan, ngram_join, quality_rules
from txnspark.sources.scratch import scratch_path


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").repartition(5)


def same(monkeypatch, module, switch, run):
    results = []
    for value in (None, 0):
        with monkeypatch.context() as m:
            if value is not None:
                m.setattr(module, switch, value)
            results.append(sorted(map(tuple, run().collect()), key=str))
    assert results[0] and results[0] == results[1]


def test_id_lists_of_the_ngram_join(docs, monkeypatch):
    same(monkeypatch, ngram_join, "BROADCAST_IDS", lambda: ngram_join.similarity_classes(docs, 3, 90))


def test_a_hot_group_is_dealt_out(docs, monkeypatch):
    results = []
    for meetings, block in ((1 << 16, 64), (1, 1)):
        monkeypatch.setattr(ngram_join, "MEETINGS", meetings)
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        results.append(sorted(map(tuple, ngram_join.similarity_classes(docs, 2, 60).collect())))
    assert results[0] == results[1]


def test_rejected_keys(docs, monkeypatch):
    some = docs.where("doc_id % 3 = 0").select(common.row_key().alias("k"))
    same(monkeypatch, common, "BROADCAST_KEYS", lambda: common.without(docs, some, common.row_key()))


def test_groups_of_the_quality_rules(docs, monkeypatch):
    columns = ["doc_id", "n_words", "base_failed", "kept"]
    same(monkeypatch, quality_rules, "BROADCAST_GROUPS", lambda: quality_rules.judge(docs.drop("n_chars")).select(*columns))


def test_grams_of_the_license_scan(docs, monkeypatch):
    same(monkeypatch, license_scan, "BROADCAST_GRAMS", lambda: license_scan.scan(docs))


def test_starts_of_record_files(spark, docs, monkeypatch):
    path, index = scratch_path(spark, "records"), scratch_path(spark, "index")
    binary_records.write_records(docs, path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    binary_records.write_index(spark, path, index)
    columns = ["doc_id", "start", "n_tokens"]
    same(monkeypatch, binary_records, "BROADCAST_FILES", lambda: binary_records.read_in_order(spark, path, index).select(*columns))


def test_parts_of_the_benchmark(spark, sf, docs):
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet").limit(40)
    whole, parts = (sorted(map(tuple, decontamination.contaminated(docs, benchmark, part_bytes=b).collect())) for b in (1 << 23, 2000))
    assert whole and whole == parts
