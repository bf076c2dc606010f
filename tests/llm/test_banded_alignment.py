"""Alignment inside a strip of diagonals, and texts that the earlier search was slow on."""

import random
import time

import pytest

from tests.llm.test_brute_force import edit_distance_inside
from txnspark.llm import decontamination


def edited(draw, item, edits):
    out = list(item)
    for _ in range(edits):
        at = draw.randrange(len(out))
        out[at : at + 1] = draw.choice(["", "x", out[at] + "y"])
    return "".join(out)


def test_alignment_on_all_diagonals_is_the_least_distance():
    draw = random.Random(11)
    for _ in range(200):
        item = "".join(draw.choice("abcd") for _ in range(draw.randrange(5, 60)))
        text = "".join(draw.choice("abcd") for _ in range(draw.randrange(0, 30))) + edited(draw, item, draw.randrange(9))
        text += "".join(draw.choice("abcd") for _ in range(draw.randrange(0, 30)))
        least = edit_distance_inside(item.encode(), text.encode())
        found = decontamination.align(item.encode(), text.encode(), -len(item), len(text), 12)
        assert (found[0] if found else None) == (least if least <= 12 else None)
        if found:
            assert edit_distance_inside(item.encode(), text.encode()[found[1] : found[2]]) == least


def test_a_band_leaves_out_other_diagonals():
    text = b"." * 40 + b"a passage of an item" + b"." * 40
    assert decontamination.align(b"a passage of an item", text, 39, 41, 2) == (0, 40, 60)
    assert decontamination.align(b"a passage of an item", text, 50, 60, 2) is None


@pytest.mark.parametrize("before", [0, decontamination.CHUNK - 100, decontamination.CHUNK + 5, 2 * decontamination.CHUNK - 2000])
def test_passages_across_chunks(before):
    draw = random.Random(before)
    item = "".join(draw.choice("abcdefghijklmnop") for _ in range(4000))
    text = "z" * before + edited(draw, item, 300) + "z" * 40_000
    ((_, start, _, edits),) = decontamination.search(text, decontamination.index_items([(1, item)]))
    assert abs(start - before) < 20
    assert 200 < edits <= 300


def test_repeated_phrases_take_little_time():
    for item in ("ab " * 100, "ab " * 50 + "ac " * 50, "ab ab ac " * 34):
        known = decontamination.index_items([(1, item)])
        begin = time.process_time()
        found = decontamination.search("ab " * 30_000, known)
        assert time.process_time() - begin < 5
        assert [f[0] for f in found] == ([0] if item == "ab " * 100 else [])


def test_an_item_longer_than_a_chunk():
    draw = random.Random(5)
    item = "".join(draw.choices("abcdefghijklmnop", k=1 << 17))
    known = decontamination.index_items([(1, item)])
    assert not decontamination.search("q" + item[: 1 << 16], known)
    text = "q" * 70_000 + item[:50_000] + "0" + item[50_000:]
    assert decontamination.search(text, known) == [(0, 70_000, len(item) + 1, 1)]
