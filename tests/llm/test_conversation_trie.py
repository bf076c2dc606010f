"""Conversation trie against plain Python: every node of small tables, narrow and wide blocks."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from txnspark.llm import conversation_trie
from txnspark.llm.common import doc_crc

SCHEMA = "conv_id long, turn long, role string, text string, block int, key string, n_turns int, t1 int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, heads):
    """All nodes of the table, as tuples of COLUMNS; equal turns of one conversation are not tried here."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in own.items()}
    convs = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if heads else 0
        convs[c] = (own.get(c - c % 20, [])[:h] + ts[h:]) if heads else ts
    members = defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * words
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p))))
        up = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), up, len(m), kids.get(p, 0), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows():
    words = ("yes", "no", "tell me more", "", None, "stop it now")
    out = []
    for c in range(150):
        for i in range(0 if c % 37 == 5 else 1 + (c * 7) % 6):
            out.append((c, i if i else None, ("user", "assistant", None)[(c + i) % 3 if c % 11 == 0 else i % 2], words[(c // 3 * i) % 6]))
    # Long conversations that part late, one of them without the others' first turns.
    for c in (300, 301, 302, 303):
        out += [(c, i, "user", f"turn {i}" if i < 40 + c % 3 else f"own {c} {i}") for i in range(57 - c % 2)]
    # Many that are the same, and rows of no conversation.
    out += [(c, i, "user", "copy") for c in range(1000, 1100) for i in range(3)]
    return [*out, (None, 1, "user", "nobody's"), (None, None, None, None)]


@pytest.fixture(scope="module")
def talks(spark):
    return spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows()], SCHEMA).repartition(5)


def found(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


@pytest.mark.parametrize(("width", "limit", "small"), [(8, 1_000_000, 20_000), (3, 60, 0)])
def test_equals_brute_force(talks, width, limit, small, monkeypatch):
    monkeypatch.setattr(conversation_trie, "CHUNK", 7)
    placed = conversation_trie.turns(talks, limit)
    rebuilt = conversation_trie.with_shared_heads(placed, 20, (doc_crc("conv_id") % 4).cast("int"), 3, limit)
    assert found(conversation_trie.trie(rebuilt, width, limit, small)) == brute(rows(), True)


def test_own_turns_only(talks):
    plain = conversation_trie.with_root_rows(conversation_trie.turns(talks))
    assert found(conversation_trie.trie(plain, 4)) == brute(rows(), False)


def test_equal_turns_and_empty_tables(spark, talks):
    twice = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "tool", "b"), (2, 0, "user", "a")]
    df = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in twice], SCHEMA)
    placed = conversation_trie.with_root_rows(conversation_trie.turns(df))
    out = conversation_trie.trie(placed).collect()
    assert max(r["depth"] for r in out) == 3 and sum(r["n_leaves"] for r in out if r["depth"] == 0) in (1, 2)
    none = conversation_trie.with_root_rows(conversation_trie.turns(talks.limit(0)))
    assert conversation_trie.trie(none).count() == 0
    assert conversation_trie.with_shared_heads(conversation_trie.turns(talks.limit(0)), 20, F.lit(1), 3).count() == 0


def test_very_long_text_counts_its_words(spark):
    df = spark.createDataFrame([(c, 0, "user", "word " * 300_000, 1, "x", 2, 3) for c in (1, 2)], SCHEMA)
    placed = conversation_trie.with_root_rows(conversation_trie.turns(df))
    out = conversation_trie.trie(placed).where("depth = 1").collect()
    assert [(r["n_convs"], r["saved_tokens"], r["words"]) for r in out] == [(2, 300_000, 300_000)]
