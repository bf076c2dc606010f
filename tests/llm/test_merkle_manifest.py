"""Merkle manifest against hashlib: trees, proofs, folds, and the states that are kept."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from txnspark.llm import merkle_manifest
from txnspark.llm import sha_midstate as sha

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, grp string, pos int, _part string, block string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, more=0):
    doc_id, source, lang, n_chars, text = row[:5]
    return h(*map(field, (doc_id, source, lang, n_chars if n_chars is None else n_chars + more, text)))


def levels(nodes, fan_out):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + fan_out]) for i in range(0, len(out[-1]), fan_out)])
    return out


def brute(rows, fan_out, tampered):
    """Sorted (doc_id, leaf, subroot, proof, folded) and the root."""
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, bytes.fromhex(leaf(r))))
    trees = {g: levels([leaf(r) for r in groups[g]], fan_out) for g in order}
    top = levels([trees[g][-1][0] for g in order], fan_out)
    out = []
    for at, g in enumerate(order):
        for i, row in enumerate(groups[g]):
            now, passed = leaf(row, int(tampered(row))), []
            for tree, place in ((trees[g], i), (top, at)):
                for level in tree[:-1]:
                    low = place - place % fan_out
                    run = list(level[low : low + fan_out])
                    passed += run[: place - low] + run[place - low + 1 :]
                    run[place - low] = now
                    now, place = h(*run), place // fan_out
            out.append((row[0], leaf(row), trees[g][-1][0], h(*passed), now))
    return sorted(out, key=str), top[-1][0]


def test_sha_states_go_on_where_they_were_kept():
    digests = np.random.default_rng(3).integers(0, 256, (9000, 32)).astype(np.uint8)
    words = sha.words_of(digests)
    assert (sha.bytes_of(words) == digests).all()
    kept = sha.absorb(sha.start(9000), words)
    kept = sha.words_of(np.frombuffer(sha.bytes_of(kept).tobytes(), np.uint8).reshape(-1, 32))
    blocks = np.arange(9000) % 3 + 1
    more = kept.copy()
    for n in (2, 3):
        more[:, blocks >= n] = sha.absorb(more[:, blocks >= n], words[:, blocks >= n])
    got = sha.bytes_of(sha.finish(more, blocks))
    for i in (*range(20), 8191, 8192, 8999):
        assert got[i].tobytes().hex() == h(digests[i].tobytes().hex() * int(blocks[i]))
    assert sha.bytes_of(sha.finish(sha.start(1), np.array([0]))).tobytes().hex() == h()


ROWS = [
    (i if i % 50 else None, f"s{i % 3}" if i % 7 else None, (None, "", "de", "é", "zz")[min(i % 11, 4)], i if i % 5 else None, f"tëxt {i % 40}" if i % 9 else None)
    for i in range(230)
] + [(7, "s", "de", 1, "same")] * 9 + [(8, None, "alone", None, "")]


def run(spark, rows, fan_out, height):
    df = spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], SCHEMA)
    changed = {"n_chars": F.col("n_chars") + 1}
    leaves = merkle_manifest.leaves(df, tampered=changed, where=F.col("doc_id") % 4 == 0)
    tree = merkle_manifest.build(leaves, fan_out, height)
    out = merkle_manifest.fold(tree, leaves).collect()
    got = [(r["key"], *(bytes(r[c]).hex() for c in ("digest", "subroot", "proof", "folded"))) for r in out]
    return sorted(got, key=str), tree, leaves


@pytest.mark.parametrize(("fan_out", "height"), [(2, 12), (2, 2), (3, 1)])
def test_equals_brute_force(spark, fan_out, height):
    got, tree, _ = run(spark, ROWS, fan_out, height)
    want, root = brute(ROWS, fan_out, lambda r: r[0] is not None and r[0] % 4 == 0)
    assert got == want and tree.root == root
    assert len(tree.groups) > 1 or height == 12


def test_one_leaf_and_no_row(spark):
    got, tree, _ = run(spark, [(1, None, None, None, None)], 2, 12)
    assert got == [(1, leaf((1, None, None, None, None)), tree.root, h(), tree.root)]
    empty = spark.createDataFrame([], SCHEMA)
    leaves = merkle_manifest.leaves(empty)
    assert merkle_manifest.build(leaves).root is None
    assert merkle_manifest.fold(merkle_manifest.build(leaves), leaves).count() == 0


def test_only_the_rows_handed_in_are_folded(spark):
    _, tree, leaves = run(spark, ROWS, 2, 3)
    some = leaves.where("key in (11, 201)").withColumn("given", F.col("digest"))
    out = merkle_manifest.fold(tree, some).collect()
    assert sorted(r["key"] for r in out) == [11, 201]
    assert {bytes(r["folded"]).hex() for r in out} == {tree.root}
