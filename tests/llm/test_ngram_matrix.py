"""The token-group matrix: which groups it opens, how often its entries move, short and repeated texts."""

import random
import re

import pytest

from txnspark.llm import ngram_join


@pytest.fixture(scope="module")
def tokens(spark):
    rows = [
        (1, 100, list(range(1, 14))),
        (2, 100, [1, *range(100, 112)]),  # shares one early token with 1
        (3, 100, [2, 3, 4, *range(200, 210)]),  # three with 1
        (4, 2, [50, 51]),
        (5, 2, [50, 51]),  # overlaps with 4 in two tokens, which is all they need
        (6, 1, [60]),
        (7, 1, [60]),
        (8, 2, [50, 52]),
    ]
    return spark.createDataFrame(rows, "g long, n long, tokens array<long>")


def pairs(tokens):
    return ngram_join.group_pairs(tokens, tokens.selectExpr("g", "g AS id"), 90)


def test_one_chance_token_opens_no_groups(tokens):
    assert sorted((r["g"], r["h"]) for r in pairs(tokens).collect()) == [(1, 3), (4, 5), (6, 7)]


def test_entries_are_exchanged_by_token_alone(tokens):
    plan = pairs(tokens)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(token#\w+, \d+\), REPARTITION_BY_COL", plan)
    assert not re.search(r"hashpartitioning\(_?token#[^)]*\), ENSURE_REQUIREMENTS", plan)


def expected(rows, k, percent):
    """Smallest doc_id reachable, by comparing all pairs of sets."""
    sets = []
    for doc_id, text in rows:
        w = text.split()
        sets.append((doc_id, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())))
    least = {d: d for d, _ in rows}
    moved = True
    links = [(a, b) for a, x in sets for b, y in sets if x and y and 100 * len(x & y) >= percent * len(x | y)]
    while moved:
        moved = False
        for a, b in links:
            if least[b] < least[a]:
                least[a], moved = least[b], True
    return least


@pytest.mark.parametrize(("k", "percent", "few"), [(1, 50, 1_000_000), (2, 90, 0)])
def test_short_edited_and_repeated_texts(spark, monkeypatch, k, percent, few):
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", few)
    rng = random.Random(k * percent)
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 16))) for _ in range(60)]
    for t in texts[:40]:
        words = t.split()
        words[rng.randrange(len(words))] = rng.choice("abcxyz")
        texts.append(" ".join(words))
    rows = [(rng.randrange(90), t) for t in texts + texts[:20]] + [(3, texts[0]), (3, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similarity_classes(df, k, percent).collect()}
    assert got == expected(rows, k, percent)
