"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing names: every operator."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from txnspark.llm import (
    binary_records,
    chat_repair,
    decontamination,
    hilbert_shards,
    language_id,
    license_scan,
    ngram_join,
    packing,
    quality_classifier,
    quality_rules,
)
from txnspark.sources.scratch import scratch_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, label string"
BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def rows():
    prose = " ".join(f"wort{i % 97} und satz{i % 89}" for i in range(400))
    long = " ".join(f"w{i * 7919 % 10007}" for i in range(60_000))
    out = [
        (1, None, "de", "a", 0), (2, "", "de", "a", 0), (3, " \n\t ", None, None, None),
        (4, prose, "de", "a", 5), (4, prose, "de", "a", 5), (5, prose, "de", "b", 5),
        (None, "no number here but a few words", "en", "a", 3), (None, None, None, None, None),
        (6, long, "en", "a", 7), (7, "### $$$ 123", "en", "b", 2), (8, "naïve café – 日本語 <|endoftext|> x", "fr", "b", 9),
        (9, "one", "en", "a", 1), (10, "one", "en", "a", 1),
    ]
    return [(*r, 0.5, "x", "y") for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_language(docs, none, spark):
    model = language_id.train(docs)
    out = language_id.identify(docs, model).collect()
    assert len(out) == len(rows())
    for r in out:
        assert 0 <= r["score"] <= 1
        if r["text"] is None or not any(c.isalpha() for c in r["text"]):
            assert r["lang_pred"] == "und"
    assert out[3]["lang_pred"] == "de" and out[3]["score"] == out[4]["score"]
    untaught = language_id.train(none)
    assert {r["lang_pred"] for r in language_id.identify(docs, untaught).collect()} == {"und"}
    assert language_id.identify(none, model).count() == 0


def test_records(docs, none, spark):
    for df, n in ((docs, len(rows())), (none, 0)):
        path, index = scratch_path(spark, "r"), scratch_path(spark, "i")
        binary_records.write_records(df, path, BYTES, 2)
        binary_records.write_index(spark, path, index)
        back = binary_records.read_in_order(spark, path, index).orderBy("start", "n_tokens").collect()
        assert len(back) == n
        assert [r["start"] for r in back] == np.cumsum([0, *(r["n_tokens"] for r in back)])[:-1].tolist()
        ids = [r["doc_id"] for r in back]
        assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_packing(docs, none):
    out = packing.pack(docs, WORDS, 1, 64, 4).collect()
    per = {}
    for r in out:
        per.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert len(r["ids"]) == 4 * r["length"]
    for seq in per.values():
        at = 0
        for offset, length in sorted(seq):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(r["start"] == 0 for r in out) == len(rows())
    assert packing.pack(none, WORDS).count() == 0


def test_ngrams(docs, none):
    out = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in ngram_join.similarity_classes(docs).collect()}
    assert out[4, out_size(out, 4)] == out[5, out_size(out, 5)] == 4
    assert out[9, 1] == out[10, 1] == 9
    assert out[1, 0] == 1 and out[2, 0] == 2 and out[3, 0] == 3
    assert all(c is None for (d, _), c in out.items() if d is None)
    assert ngram_join.similarity_classes(none).count() == 0
    kept = ngram_join.keep_first(docs)
    assert kept.columns == docs.columns
    # Rows that repeat number and text are exact copies: one of them stays.
    assert sorted(r["doc_id"] for r in kept.where("doc_id > 3").collect()) == [4, 6, 7, 8, 9]


def out_size(out, doc):
    return next(n for d, n in out if d == doc)


def test_decontamination(docs, none, spark):
    items = [(1, "few words no"), (2, None), (None, "one"), (3, ""), (4, "!!"), (5, " ".join(f"satz{i % 89} wort{(i + 1) % 97} und" for i in range(20)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.contaminated(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(4, 5), (5, 5)}
    assert len(found) == 3
    assert decontamination.contaminated(none, bench).count() == 0
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0
    assert decontamination.clean(docs, bench).count() == len(rows()) - 3


def test_shards(docs, none):
    out = hilbert_shards.shards(docs, ["lang", "source", "n_chars"], ["doc_id"], 5).collect()
    assert len(out) == len(rows())
    for s in range(5):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots))) and len(slots) in (2, 3)
    assert hilbert_shards.shards(none, ["lang"], ["doc_id"]).count() == 0
    named = docs.select("doc_id", "lang", *[F.lit(n).alias(n) for n in ("_b0", "_place", "_shard", "_row", "_d0", "hilbert")])
    kept = hilbert_shards.shards(named, ["lang"], ["doc_id"], 5)
    assert kept.columns == ["doc_id", "lang", "_b0", "_place", "_shard", "_row", "_d0", "hilbert", "shard", "slot"]
    assert all(r["_b0"] == "_b0" and r["_shard"] == "_shard" and r["_place"] == "_place" for r in kept.collect())


def test_classifier(docs, none, spark):
    labels = spark.createDataFrame([(4, 1), (7, 0), (9, None), (None, 1)], "doc_id long, quality int")
    out = quality_classifier.classify(docs, labels).collect()
    assert len(out) == len(rows()) and all(0 <= r["score"] <= 1 for r in out)
    assert {r["score"] for r in quality_classifier.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.classify(none, labels).count() == 0


def test_licenses(docs, none):
    out = license_scan.scan(docs).collect()
    assert len(out) == len(rows())
    assert all(r["n_words"] == 0 and r["labels"] == "" for r in out if r["doc_id"] in (1, 2, 3))
    assert license_scan.scan(none).count() == 0


def test_rules(docs, none):
    out = quality_rules.judge(docs).collect()
    assert len(out) == len(rows())
    assert all(r["base_failed"] and not r["kept"] for r in out if r["doc_id"] in (1, 2, 3, 9))
    assert quality_rules.judge(none).count() == 0
    assert quality_rules.keep(docs).columns == docs.columns


def test_chat(spark):
    turns = [(1, 0, "user", "a"), (1, 0, "user", "a"), (None, None, None, None), (2, 1, "assistant", None), (2, 0, "robot", "")]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, cost int")
    assert chat_repair.repair(df).count() == 5
    assert chat_repair.repair(df.limit(0)).count() == 0


def test_pipeline_keeps_columns(docs, none, spark, sf):
    assert len(corpus_pipeline.STAGES) == 5
    for start in (docs, none):
        now = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, sf)
            assert now.columns == start.columns
            path = scratch_path(spark, "stage")
            now.write.parquet(path)
            now = spark.read.parquet(path)
        assert corpus_pipeline.STAGES[-1][1](spark, now, sf).columns[0] == "doc_id"
    assert now.where(F.col("doc_id").isNotNull()).count() == 0
