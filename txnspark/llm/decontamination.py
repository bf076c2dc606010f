"""Benchmark decontamination by the q-gram lemma.

Texts are compared after folding: ASCII letters lower-cased, every run of other ASCII
characters one blank, other bytes kept. A passage of m bytes that equals an item up to
e edits shares at least m + 1 - q * (e + 1) of the item's q-grams with it, all inside
e + 1 neighbouring diagonals (text position minus item position). So shared q-grams are
counted in diagonal bands of width 2 * (e + 1) that overlap by half, which puts any
e + 1 neighbouring diagonals whole into one band. Bands that reach the bound are
candidates, neighbouring ones as one strip; an alignment of the item on the strip's
diagonals alone decides, with at most ``edit_rate`` edits per byte of the item. Every item has the largest q, up to 8,
that leaves a bound of one gram at least, so no passage within its edits is lost; there is
a gram table per q. Items of fewer than 16 bytes that allow no edit are found as whole words.

The item table is measured first. If it holds at most ``BROADCAST_BYTES``, its gram
table goes to every executor; otherwise it is cut into parts of that size and every
text meets every part, part by part, so that no task ever holds more. Either way texts
are read where they lie and never shuffled; only hits leave the tasks.

Defined results: null and empty texts have no hits; null or empty items, and items
that fold to nothing, match nothing; repeated documents are searched each for itself
and repeated items each give a hit; a text that holds an item several times gives one
row, with the best place (fewest edits, then the earliest start, then the shortest).
Texts of any length are read once, in chunks; one that repeats a phrase of an item over
and over gives one long strip, aligned as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnspark.llm.common import Batches, column, map_batches, record, row_key, without
from txnspark.sources.scratch import written

BROADCAST_BYTES = 8 << 20
Q = 8
EDIT_RATE = 0.1
#: Bytes of a text looked at together, and hits held at a time.
CHUNK = 1 << 16
HITS = 1 << 21
#: Bits of the filter that most grams of a text are checked against first.
FILTER_BITS = 22
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: One edit in a cell of the alignment, above the place where it began; a cell out of reach.
_EDIT, _FAR = 1 << 32, 1 << 60

_OTHER = re.compile(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_SPAN = "doc_id long, item_id long, start long, length long, edits long, item_length long"


def fold(text: str) -> bytes:
    """Lower-cased ASCII letters, digits and other bytes; one blank for the rest, none at the ends."""
    return _OTHER.sub(b" ", text.encode("utf-8", "surrogatepass").lower()).strip(b" ")


def qgrams(data: bytes, q: int = Q) -> np.ndarray:
    """The q bytes from each position on, as integers; q is at most 8."""
    raw = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = len(raw) - q + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(q if n > 0 else 0):
        out |= raw[i : i + n] << np.uint64(8 * i)
    return out


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams * _MULTIPLIER) >> np.uint64(64 - FILTER_BITS)


@dataclass
class Grams:
    """The sorted q-grams of the items that have this q, and their filter."""

    q: int
    grams: np.ndarray
    item: np.ndarray
    place: np.ndarray
    filter: np.ndarray


@dataclass
class Items:
    """Folded items with a gram table for each q, and what each item allows."""

    ids: np.ndarray
    texts: list[bytes]
    tables: list[Grams]
    short: list[int]
    size: np.ndarray
    budget: np.ndarray  # edits
    need: np.ndarray  # shared q-grams that a passage within the budget has at least
    longest: int


def index_grams(texts: list[bytes], numbers: np.ndarray, q: int) -> Grams:
    found = [qgrams(texts[i], q) for i in numbers]
    grams = np.concatenate(found)
    item = np.repeat(numbers, [len(g) for g in found])
    place = np.concatenate([np.arange(len(g)) for g in found])
    order = np.argsort(grams, kind="stable")
    sieve = np.zeros(1 << FILTER_BITS, bool)
    sieve[_slot(grams)] = True
    return Grams(q, grams[order], item[order], place[order], sieve)


def index_items(rows: list[tuple[int, str]], q: int = Q, edit_rate: float = EDIT_RATE) -> Items:
    """``q`` is the largest one; an item's own is at most its bytes by its edits plus one."""
    folded = [(i, t) for i, t in ((i, fold(t)) for i, t in rows if t) if t]
    texts = [t for _, t in folded]
    size = np.array([len(t) for t in texts], np.int64)
    budget = (size * edit_rate).astype(np.int64)
    whole = (budget == 0) & (size < 2 * q)
    own = np.where(whole, 0, np.clip(size // (budget + 1), 1, q))
    need = np.maximum(size + 1 - own * (budget + 1), 1)
    tables = [index_grams(texts, np.flatnonzero(own == n), n) for n in np.unique(own[~whole]).tolist()]
    longest = int((size + 2 * budget).max(initial=0)) + q
    return Items(np.array([i for i, _ in folded], np.int64), texts, tables, np.flatnonzero(whole).tolist(), size, budget, need, longest)


def align(item: bytes, data: bytes, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of ``item`` on the diagonals low to high, if within ``most``.

    One numpy row per byte of the item, one cell per diagonal that still holds at most so
    many edits. No edit is tried first, then four times as many each round, so a close
    passage keeps few cells alive. A cell is its edits and, below, where it began: the
    least one has the fewest edits, then the earliest start. Bytes past the end of the
    text differ from all others, which costs what leaving out the item's bytes costs.
    """
    pattern = np.frombuffer(item, np.uint8)
    m, n = len(pattern), len(data)
    low, high = max(low, -most), min(high, n - m + most)  # a passage begins and ends inside the text
    if low > high:
        return None
    wide = np.full(m + high - low, -1, np.int16)
    first, last = max(low, 0), min(m + high, n)
    wide[first - low : last - low] = np.frombuffer(data, np.uint8, max(last - first, 0), first if last > first else 0)
    start = np.arange(low, high + 1, dtype=np.int64)
    start[start < 0] = _FAR
    steps = np.arange(high - low + 1, dtype=np.int64) * _EDIT
    allowed = 0
    while True:
        found = _within(pattern, wide, start, steps, min(allowed, most))
        if found:
            edits, begin, diagonal = found
            return edits, begin, min(m + low + diagonal, n)
        if allowed >= most:
            return None
        allowed = max(4, 4 * allowed)


def _within(
    pattern: np.ndarray, wide: np.ndarray, start: np.ndarray, steps: np.ndarray, most: int
) -> tuple[int, int, int] | None:
    """(edits, start, diagonal counted from the band's first) of ``align`` with at most ``most`` edits."""
    live, at, width = start, 0, len(start)
    for i, byte in enumerate(pattern):
        if len(live) == 1 and live[0] // _EDIT == most:
            # No edit is left, so only equal bytes of this diagonal can follow.
            same = np.array_equal(wide[i + at : len(pattern) + at], pattern[i:])
            return (most, int(live[0] % _EDIT), at) if same else None
        left = max(at - 1, 0)
        right = min(at + len(live) + most, width)
        row = np.full(right - left, _FAR, np.int64)
        inside = slice(at - left, at - left + len(live))
        row[inside] = live + (wide[i + at : i + at + len(live)] != byte) * _EDIT
        # A byte of the item left out: from the next diagonal.
        from_next = live[1 - (at - left) :] + _EDIT
        row[: len(from_next)] = np.minimum(row[: len(from_next)], from_next)
        # Bytes of the text put in: from any diagonal before.
        own = steps[: len(row)]
        row = np.minimum.accumulate(row - own) + own
        alive = np.flatnonzero(row < (most + 1) * _EDIT)
        if not len(alive):
            return None
        live, at = row[alive[0] : alive[-1] + 1], left + int(alive[0])
    best = int(np.argmin(live))
    return int(live[best] // _EDIT), int(live[best] % _EDIT), at + best


def strips(data: bytes, items: Items) -> Iterator[tuple[int, int, int]]:
    """(item, first diagonal, last diagonal) of bands with enough shared q-grams, neighbours as one."""
    for table in items.tables:
        yield from strips_of(data, items, table)


def strips_of(data: bytes, items: Items, table: Grams) -> Iterator[tuple[int, int, int]]:
    """``strips`` of the items in one gram table.

    The text is read once, a chunk at a time. What a chunk leaves behind are the hits of
    bands that later bytes can still add to, so no chunk depends on the longest item.
    """
    width = (len(data) + items.longest) * 2
    pending = np.zeros(0, np.int64)
    for at in range(0, len(data), CHUNK):
        hits = _hits(data, at, items, table, width)
        if len(data) <= CHUNK and not _reached(hits, items, table, width):
            return
        pending = _distinct(np.concatenate([pending, hits]))
        if not len(pending):
            continue
        item, half = table.item[pending // width], pending % width
        done = min(at + CHUNK, len(data))
        yield from _qualified(item * width + half, items, width, at, done if done < len(data) else width)
        pending = pending[(half + 1) * (items.budget[item] + 1) > done]


def _distinct(numbers: np.ndarray) -> np.ndarray:
    numbers = np.sort(numbers)
    return numbers[np.concatenate([numbers[:1] == numbers[:1], numbers[1:] != numbers[:-1]])]


def _hits(data: bytes, at: int, items: Items, table: Grams, width: int) -> np.ndarray:
    """One number per entry of the gram table and half band that a gram of the chunk hits, with repeats."""
    grams = qgrams(data[at : at + CHUNK + table.q - 1], table.q)
    some = np.flatnonzero(table.filter[_slot(grams)])
    low = np.searchsorted(table.grams, grams[some], "left")
    many = np.searchsorted(table.grams, grams[some], "right") - low

    def numbered(count: np.ndarray, begin: np.ndarray, position: np.ndarray) -> np.ndarray:
        entry = np.arange(count.sum()) + np.repeat(begin - np.cumsum(count) + count, count)
        item = table.item[entry]
        diagonal = np.repeat(position, count) - table.place[entry]
        return entry * width + (diagonal + items.size[item]) // (items.budget[item] + 1) + 1

    upto = np.cumsum(many)
    if not len(many) or upto[-1] <= HITS:
        return numbered(many, low, some + at)
    # So many hits at a time that a text of one repeated phrase needs little memory.
    cuts = np.flatnonzero(np.diff(upto // HITS)) + 1
    parts = zip(np.split(many, cuts), np.split(low, cuts), np.split(some + at, cuts), strict=True)
    return np.concatenate([_distinct(numbered(*part)) for part in parts])


def _halves(own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Half bands in order, their hits, those with the next half's, and whether the half before is empty."""
    own = np.sort(own)
    first = np.flatnonzero(np.concatenate([own[:1] == own[:1], own[1:] != own[:-1]]))
    half, count = own[first], np.diff(first, append=len(own))
    follows = half[1:] == half[:-1] + 1
    total = count.copy()
    total[:-1] += np.where(follows, count[1:], 0)
    return half, count, total, np.concatenate([half[:1] == half[:1], ~follows])


def _reached(hits: np.ndarray, items: Items, table: Grams, width: int) -> bool:
    """Whether a band may reach its item's bound: repeats of a gram count here, so none is missed."""
    item = table.item[hits // width]
    half, _, total, _ = _halves(item * width + hits % width)
    return bool((total >= items.need[half // width]).any())


def _qualified(own: np.ndarray, items: Items, width: int, before: int, done: int) -> Iterator[tuple[int, int, int]]:
    """Strips of the bands (a half and the next one) whose places reach the bound of their item.

    A place of the item counts once in a half band, however often the text repeats its gram.
    Only bands that end with the bytes after ``before`` and up to ``done``.
    """
    half, count, total, alone = _halves(own)
    bands, total = np.concatenate([half, half[alone] - 1]), np.concatenate([total, count[alone]])
    bands = np.sort(bands[total >= items.need[bands // width]])
    end = (bands % width + 1) * (items.budget[bands // width] + 1)
    bands = bands[(end > before) & (end <= done)]
    for run in np.split(bands, np.flatnonzero(np.diff(bands) > 1) + 1) if len(bands) else []:
        item, first, last = int(run[0] // width), int(run[0] % width), int(run[-1] % width)
        reach, size = int(items.budget[item]) + 1, int(items.size[item])
        yield item, (first - 1) * reach - size, (last + 1) * reach - size - 1


def search(text: str, items: Items) -> list[tuple[int, int, int, int]]:
    """(item, start, length, edits) in the folded text, the best place of each item found."""
    data = fold(text)
    best: dict[int, tuple[int, int, int]] = {}
    for item, low, high in strips(data, items):
        most, known = int(items.budget[item]), best.get(item)
        if known:
            most = known[0] - (max(low, 0) >= known[1])  # a later place must have fewer edits
        found = align(items.texts[item], data, low, high, most) if most >= 0 else None
        if found:
            best[item] = min(best.get(item, found), found)
    for item in items.short:
        whole = re.search(rb"(?:^| )(" + re.escape(items.texts[item]) + rb")(?: |$)", data)
        if whole:
            best[item] = (0, whole.start(1), whole.end(1))
    return [(i, start, end - start, edits) for i, (edits, start, end) in sorted(best.items())]


def _search_part(docs: DataFrame, shared: Broadcast[Items]) -> DataFrame:
    names = [n for n in _SPAN.replace(",", "").split()[::2]]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def find(batches: Batches) -> Batches:
        known = shared.value
        for batch in batches:
            out = []
            for doc_id, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "text"), strict=True):
                if text.is_valid:
                    for i, start, length, edits in search(text.as_py(), known):
                        out.append((doc_id, int(known.ids[i]), start, length, edits, len(known.texts[i])))
            if out:
                yield record(schema, *map(list, zip(*out, strict=True)))

    return map_batches(docs, find, _SPAN)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    q: int = Q,
    edit_rate: float = EDIT_RATE,
    part_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """One row per (document, item found in it): where, how long, how many edits."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.where("text IS NOT NULL AND item_id IS NOT NULL").select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")
    )
    size = items.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    parts = -(-size // part_bytes) or 1
    spark = docs.sparkSession
    out = None
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text")
        index = index_items([(r["item_id"], r["text"]) for r in own.collect()], q, edit_rate)
        shared = spark.sparkContext.broadcast(index)  # at most ``part_bytes`` of item text
        found = _search_part(rows, shared)
        if parts > 1:
            found = written(found, "hits-of-a-part")
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without a hit, all columns kept."""
    keyed = docs.select(row_key().alias("doc_id"), "text")
    hits = written(contaminated(keyed, benchmark).select("doc_id"), "hits")
    return without(docs, hits, row_key())
