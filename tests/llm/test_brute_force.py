"""The operators' results against plain Python over the small tables."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from txnspark.llm import chat_repair, decontamination, hilbert_shards, language_id, ngram_join, packing
from txnspark.llm.queries import QUERIES
from txnspark.llm.tokens import Encoder

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD, SPACED = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def result(name, spark, sf):
    return {r["doc_id"]: r for r in QUERIES[name](spark, sf).collect()}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_those_of_whole_texts(name, texts):
    rng = random.Random(5)
    pool = [*"ab AB.,'!\n\t éÉß<|12-_", "  ", "don't", "<|endoftext|>", " ", "İ", "Σ", "日本", "\r\n", "\u0085", "ẋ", "×"]
    odd = ["".join(rng.choices(pool, k=rng.randint(0, 40))) for _ in range(5000)]
    encoder = Encoder(public_tokenizers.path(name), most=5000)
    for sample in (odd, list(texts.values())):
        want = [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch(sample, add_special_tokens=False)]
        assert encoder.encode(sample) == want


def test_records_round_trip(spark, sf, texts):
    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    start, got = 0, result("op7_binary_records", spark, sf)
    for doc in sorted(texts):
        ids = encoder.encode([texts[doc]])[0] + (2).to_bytes(4, "little")
        assert (got[doc]["start"], got[doc]["n_tokens"], got[doc]["ids_crc32"]) == (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4


def test_a_damaged_record_is_found():
    from txnspark.llm.binary_records import frame, frames_of

    data = bytearray(frame(7, np.arange(70_000, 70_010, dtype="<u4").tobytes()) + frame(None, b""))
    assert [(d, n, len(i) // 4) for _, _, d, n, i in frames_of(memoryview(bytes(data)))] == [(7, 10, 10), (None, 0, 0)]
    data[30] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        frames_of(memoryview(bytes(data)))


def test_packing_holds_every_id_once(spark, sf, texts):
    encoder = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    rows = QUERIES["op8_packing"](spark, sf).collect()
    per, used = {}, Counter()
    for r in rows:
        per.setdefault(r["doc_id"], []).append(r)
        used[r["sequence_id"]] += r["length"]
    for doc, text in texts.items():
        ids, at = encoder.encode([text])[0] + (1).to_bytes(4, "little"), 0
        for r in sorted(per[doc], key=lambda r: r["start"]):
            piece = ids[4 * at : 4 * (at + r["length"])]
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(piece) and r["doc_tokens"] == len(ids) // 4
            at += r["length"]
        assert 4 * at == len(ids)
    assert max(used.values()) <= 2048 and sum(used.values()) > 0.97 * 2048 * len(used)


def test_patterns_reach_the_bound():
    demand = np.zeros(32, np.int64)
    demand[[19, 11, 7]] = 300, 300, 10
    chosen = packing.solve(demand)
    held = sum(p * t for p, t in chosen)
    assert (held == demand).all() and all((p * np.arange(1, 33)).sum() <= 32 for p, _ in chosen)
    assert sum(t for _, t in chosen) <= 303


def shingle_sets(texts, k):
    out = {}
    for doc, text in texts.items():
        words = re.findall(SPACED, text.translate(LOWER))
        grams = [tuple(words)] if 0 < len(words) < k else zip(*[words[i:] for i in range(k)], strict=False)
        out[doc] = set(grams) if words else set()
    return out


def brute_components(sets, percent):
    index, parent = {}, {d: d for d in sets}
    for doc, s in sets.items():
        for gram in s:
            index.setdefault(gram, []).append(doc)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for doc, s in sets.items():
        for other, n in Counter(e for g in s for e in index[g] if e < doc).items():
            if 100 * n >= percent * (len(s) + len(sets[other]) - n):
                a, b = root(doc), root(other)
                parent[max(a, b)] = min(a, b)
    return {d: root(d) for d in sets}


def near_copies():
    """Chains, clusters and pairs around the threshold."""
    rng, out = random.Random(11), {}
    for cluster in range(12):
        words = [f"c{cluster}w{rng.randint(0, 400)}" for _ in range(rng.choice([4, 30, 120, 400]))]
        for _ in range(12):
            out[len(out)] = " ".join(words)
            if rng.random() < 0.6:
                words = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                words[rng.randrange(len(words))] = f"x{rng.randint(0, 10**6)}"
    return out


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_components(spark, texts, k, percent):
    all_texts = {**texts, **{10_000 + d: t for d, t in near_copies().items()}}
    df = spark.createDataFrame(list(all_texts.items()), "doc_id long, text string")
    sets = shingle_sets(all_texts, k)
    want = brute_components(sets, percent)
    got = {r["doc_id"]: r for r in ngram_join.similarity_classes(df, k, percent).collect()}
    assert {d: r["component_id"] for d, r in got.items()} == want
    assert {d: r["n_shingles"] for d, r in got.items()} == {d: len(s) for d, s in sets.items()}


def test_language_held_out(spark, sf):
    got = result("op3_language_id", spark, sf)
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [d for d, r in got.items() if r["held_out"]]
    assert {d for d in got if zlib.crc32(str(d).encode()) % 5 == 0} == set(held)
    assert np.mean([got[d]["lang_pred"] == lang[d] for d in held]) > 0.95


def test_code_lengths_by_definition():
    rng = random.Random(2)
    texts = {"x": ["abracadabra", "abra"], "y": ["banana bandana"]}
    order, counts = 2, Counter()
    for lang, sample in texts.items():
        for t in sample:
            raw = b"\0" * order + t.encode()
            for i in range(order, len(raw)):
                for k in range(order + 1):
                    counts[k, lang, int.from_bytes(raw[i - k : i + 1], "big")] += 1
    model = language_id.fit([(*key, n) for key, n in counts.items()])

    def bits(lang, context, byte):
        seen = {g & 255: n for (k, w, g), n in counts.items() if k == len(context) and w == lang and g >> 8 == int.from_bytes(context, "big")}
        total, kinds = sum(seen.values()), len(seen)
        if byte in seen:
            return -np.log2(seen[byte] / (total + kinds))
        rest = bits(lang, context[1:], byte) if context else 8
        return rest - (np.log2(kinds / (total + kinds)) if total else 0)

    for _ in range(40):
        raw = bytes(rng.choices(b"abrcdnz ", k=9))
        got = model.bits(np.frombuffer(raw, np.uint8), np.array([0])).sum(axis=0) / language_id.UNIT
        padded = b"\0" * order + raw
        for i, lang in enumerate(model.langs):
            want = sum(bits(lang, padded[j - order : j], padded[j]) for j in range(order, len(padded)))
            assert got[i] == pytest.approx(want, abs=0.01)


def test_quality_held_out(spark, sf):
    got = result("op5_quality_classifier", spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    held = [(got[r["doc_id"]], r["quality"]) for r in labels if got[r["doc_id"]]["held_out"]]
    assert np.mean([r["predicted"] == q for r, q in held]) > 0.93


def test_benchmark_items_are_found(spark, sf, texts):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = {(d, i) for d, t in texts.items() for i, b in items.items() if decontamination.fold(b) in decontamination.fold(t)}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op6_decontamination"](spark, sf).collect()}
    assert want and want <= got and {d for d, _ in got} == {d for d, _ in want}


def edit_distance_inside(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern):
        before, row = row, [i + 1]
        for j, t in enumerate(text):
            row.append(min(before[j] + (p != t), before[j + 1] + 1, row[j] + 1))
    return min(row)


def test_edited_items_within_the_budget():
    rng = random.Random(8)
    item = "".join(rng.choices("abcdefgh ", k=150))
    known = decontamination.index_items([(1, item)])
    pattern = decontamination.fold(item)
    for edits in [0, 3, 8, 12, 15, 25, 40] * 4:
        changed = list(item)
        for _ in range(edits):
            at = rng.randrange(len(changed))
            changed[at : at + 1] = rng.choice([[], ["z"], [changed[at], "q"]])
        text = "".join(rng.choices("ijklmnop ", k=30_000)) + "".join(changed) + "".join(rng.choices("ijklmnop ", k=200))
        least = edit_distance_inside(pattern, decontamination.fold(text)[29_500:])
        found = decontamination.search(text, known)
        assert bool(found) == (least <= int(len(pattern) * decontamination.EDIT_RATE))
        if found:
            assert found[0][3] == least


def test_licenses(spark, sf, texts):
    got = result("op9_license_scan", spark, sf)
    base = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    for doc, text in texts.items():
        words, places, labels = re.findall(WORD, text.translate(LOWER)), [], set()
        for phrase, label in base.items():
            parts = phrase.split()
            found = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
            places += found
            labels |= {label} if found else set()
        r = got[doc]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(words), len(places), ",".join(sorted(labels)))
        assert (r["first_word"], r["last_word"]) == ((min(places), max(places)) if places else (None, None))
        assert labels <= set(r["labels"].split(","))


def test_spans_with_changed_words(spark):
    from txnspark.llm import license_scan

    _, notice = license_scan.TEMPLATES[-2]
    words = notice.split()
    cases = {
        1: notice, 2: " ".join(words[:9] + ["new"] + words[9:]), 3: " ".join(words[:7] + words[8:]),
        4: " ".join(words[:8]), 5: " ".join(words[i] for i in np.random.default_rng(0).permutation(len(words))),
        6: "cc by all rights reserved cc by",
    }
    out = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(list(cases.items()), "doc_id long, text string")).collect()}
    assert [out[i]["labels"] for i in range(1, 6)] == ["mit", "mit", "mit", "", ""]
    assert (out[6]["n_base"], out[6]["first_word"], out[6]["last_word"]) == (3, 0, 5)


def test_rule_counts(spark, sf, texts):
    got = result("op10_quality_rules", spark, sf)
    for doc, text in texts.items():
        words = re.findall(SPACED, text)
        grams = list(zip(words, words[1:], words[2:], strict=False))
        count, covered = Counter(grams), set()
        for i, gram in enumerate(grams):
            covered |= {i, i + 1, i + 2} if count[gram] > 1 else set()
        lines = [x for x in text.split("\n") if re.search(SPACED, x)]
        symbols = len(re.findall(r"[#*$%&|<>]", text))
        want = (len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered))
        r = got[doc]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (r["base_failed"] and r["kept"])


def test_outliers_and_clean_texts(spark):
    got = result("op10_quality_rules", spark, "/root/testdata/sf0.01")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    judged = [(r["kept"], labels[d]) for d, r in got.items() if d in labels and not r["base_failed"]]
    assert np.mean([kept for kept, quality in judged if quality == 1]) > 0.99
    assert np.mean([kept for kept, quality in judged if quality == 0]) < 0.2


def test_shard_order(spark, sf):
    points = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    index = hilbert_shards.hilbert_index(points, 3)
    assert sorted(index) == list(range(512))
    assert (np.abs(np.diff(points[np.argsort(index)], axis=0)).sum(axis=1) == 1).all()
    rows = QUERIES["op2_hilbert_shards"](spark, sf).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 1
    for shard in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sizes[shard]))
    assert [r["hilbert"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))] == sorted(r["hilbert"] for r in rows)


def test_manifest_prunes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    shards = hilbert_shards.shards(docs, ["lang", "n_chars"], ["doc_id"], 16).cache()
    found = hilbert_shards.manifest(shards, ["lang", "n_chars"])
    left = {r["shard"] for r in hilbert_shards.prune(found, {"lang": ("fr", "fr"), "n_chars": (0, 2000)}).collect()}
    holders = {r["shard"] for r in shards.where("lang = 'fr' AND n_chars <= 2000").select("shard").distinct().collect()}
    assert holders <= left and len(left) < 16


def test_repair_costs_and_partitions(spark):
    rng, rows, want = random.Random(3), [], {}
    roles = ["system", "user", "assistant", "tool", "robot", None]
    for conv in range(40):
        own = rng.choices(roles, k=rng.randint(1, 5))
        want[conv] = chat_repair.cheapest(own)
        rows += [(conv, i, role, f"t{i}") for i, role in enumerate(own)]
    rows += [(99, i, rng.choice(roles), "hot") for i in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    results = []
    for n in (1, 9):
        out = chat_repair.repair(df, partitions=n).orderBy("conv_id", "turn").collect()
        results.append([tuple(r) for r in out])
        cost = Counter()
        for r in out:
            cost[r["conv_id"]] += r["cost"]
        assert {c: cost[c] for c in want} == want
        for conv in (*want, 99):
            text = "".join(r["fragment"] for r in out if r["conv_id"] == conv)
            turns = re.findall(r"<\|(system|user|assistant|tool)\|>\n", text)
            assert text.count("<|end|>\n") == len(turns) and turns[-1] == "assistant"
            state = chat_repair.START
            for role in turns:
                assert role in chat_repair.LEGAL[state]
                state = chat_repair.AFTER[role]
    assert results[0] == results[1]
