"""The pipeline's stages, each on all its predecessor kept, against plain Python."""

import re

import public_tokenizers
import pytest

import corpus_pipeline
from tests.llm.test_brute_force import SPACED, brute_components, shingle_sets
from txnspark.llm import decontamination, quality_rules
from txnspark.llm.tokens import Encoder
from txnspark.sources.scratch import scratch_path


@pytest.fixture(scope="module")
def kept(spark, sf):
    """Rows after every stage, by stage name; the input under ``documents``."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, "stage")
        stage(spark, docs, sf).write.parquet(path)
        out[name] = docs = spark.read.parquet(path)
    return out


def texts(df):
    return {r["doc_id"]: r["text"] or "" for r in df.collect()}


def test_names_and_columns(kept):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language id", "quality rules", "n-gram join", "decontamination", "packing"]
    assert all(kept[n].columns == kept["documents"].columns for n in names[:-1])


def test_language_stage_keeps_texts_and_names_their_language(kept):
    before = {r["doc_id"]: r["lang"] for r in kept["documents"].collect()}
    after = {r["doc_id"]: r["lang"] for r in kept["language id"].collect()}
    assert set(after) == {d for d, t in texts(kept["documents"]).items() if re.search(r"[^\W\d_]", t)}
    assert sum(before[d] == lang for d, lang in after.items()) > 0.95 * len(after)


def test_rules_stage(kept):
    before = kept["language id"]
    judged = {r["doc_id"]: r for r in quality_rules.judge(before.drop("n_chars")).collect()}
    after = set(texts(kept["quality rules"]))
    assert after == {d for d, r in judged.items() if r["kept"]}
    assert not after & {d for d, t in texts(before).items() if len(re.findall(SPACED, t)) < 50}


def test_duplicates_stage(kept):
    before = texts(kept["quality rules"])
    component = brute_components(shingle_sets(before, 5), 80)
    assert set(texts(kept["n-gram join"])) == {d for d in before if component[d] == d}


def test_decontamination_stage(kept, spark, sf):
    items = [decontamination.fold(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before = texts(kept["n-gram join"])
    leaks = {d for d, t in before.items() if any(i in decontamination.fold(t) for i in items)}
    assert set(texts(kept["decontamination"])) == set(before) - leaks


def test_packing_stage(kept):
    encoder = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for r in kept["packing"].orderBy("doc_id", "start").collect():
        pieces[r["doc_id"]] = pieces.get(r["doc_id"], b"") + bytes(r["ids"])
    want = {d: encoder.encode([t])[0] + (1).to_bytes(4, "little") for d, t in texts(kept["decontamination"]).items()}
    assert pieces == want


def test_run_gives_the_last_stage(kept, spark, sf):
    names = ["doc_id", "start", "length", "sequence_id", "offset"]
    got = corpus_pipeline.run(spark, sf).select(*names).orderBy(*names).collect()
    assert got == kept["packing"].select(*names).orderBy(*names).collect()
