"""Items of few bytes: every passage within the edits they allow is found."""

import random

import pytest

from tests.llm.test_brute_force import edit_distance_inside
from txnspark.llm import decontamination


def spread(item, edits):
    """``item`` with so many letters replaced, evenly, so that the runs between are short."""
    out = list(item)
    for e in range(edits):
        out[(e + 1) * len(item) // (edits + 1)] = "0"
    return "".join(out)


@pytest.mark.parametrize("size", [10, 11, 15, 16, 19, 20, 21, 23, 24, 30, 31, 32, 39, 40, 81])
def test_spread_edits_are_found(size):
    item = "".join(random.Random(size).choice("abcdefghijklmnop") for _ in range(size))
    budget = int(size * decontamination.EDIT_RATE)
    known = decontamination.index_items([(1, item)])
    text = "zz " * 50 + spread(item, budget) + " zz" * 50
    ((_, start, length, edits),) = decontamination.search(text, known)
    assert (start, length, edits) == (150, size, budget)
    assert not decontamination.search("zz " * 50 + spread(item, budget + 2) + " zz" * 50, known)


def test_random_edits_are_found_as_by_brute_force():
    draw = random.Random(3)
    for _ in range(300):
        size = draw.randrange(10, 45)
        item = "".join(draw.choice("abcdefgh") for _ in range(size))
        passage = list(item)
        for _ in range(draw.randrange(0, size // 10 + 2)):
            at = draw.randrange(len(passage))
            passage[at : at + 1] = draw.choice(["", "x", passage[at] + "y"])
        text = "zz " * 5 + "".join(passage) + " zz" * 5
        least = edit_distance_inside(item.encode(), decontamination.fold(text))
        found = decontamination.search(text, decontamination.index_items([(1, item)]))
        assert bool(found) == (least <= size // 10), (item, text)


def test_items_that_allow_no_edit_are_whole_words():
    known = decontamination.index_items([(1, "nine byte"), (2, "one")])
    assert [i for i, *_ in decontamination.search("the nine byte one", known)] == [0, 1]
    assert not decontamination.search("the nine bytes alone", known)
