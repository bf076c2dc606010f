"""Packing by cutting-stock column generation.

Texts become token ids plus an end id and are cut every ``length`` ids. The pieces'
lengths are rounded up to a multiple of ``grain``, which leaves length/grain classes.
A linear program over packing patterns (how many pieces of each class a sequence
holds) is solved by column generation: a revised simplex keeps the basis, and a
knapsack recursion over the duals prices the next pattern. Pattern counts are rounded
down; what is left over is filled first-fit by decreasing class. Pieces are ranked
within their class and the rank alone tells pattern, sequence and slot.

Only the histogram (length/grain numbers) reaches the driver, whatever the size of
the table. Ranks come from the number that a piece has within its task plus what
earlier tasks have of its class, so a class with a third of all rows is no hot key.

Defined results: a null text is an empty one and still yields its end id; rows with
equal doc_id are separate documents; an empty table gives no pieces.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnspark.llm.common import Batches, column, filled, map_batches, record
from txnspark.llm.tokens import encoder
from txnspark.sources.scratch import written

PIECES = (
    "part int, row long, cls int, nth long, doc_id long, start long, length long, "
    "doc_tokens long, ids binary"
)


def best_pattern(duals: np.ndarray) -> tuple[float, np.ndarray]:
    """Knapsack over the duals: the most valuable pattern of total size len(duals)."""
    size = len(duals)
    value, last = np.zeros(size + 1), np.full(size + 1, -1)
    for room in range(1, size + 1):
        gains = value[room - 1 :: -1][:room] + duals[:room]
        c = int(np.argmax(gains))
        value[room], last[room] = value[room - 1], -1
        if gains[c] > value[room - 1] + 1e-12:
            value[room], last[room] = gains[c], c
    counts, room = np.zeros(size, np.int64), size
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            counts[last[room]] += 1
            room -= last[room] + 1
    return float(value[size]), counts


def solve(demand: np.ndarray, rounds: int = 4000, gap: float = 1e-4) -> list[tuple[np.ndarray, int]]:
    """Patterns with whole repeat counts that hold all of ``demand``.

    ``demand[c]`` pieces take c + 1 units each; a sequence has len(demand) units.
    ``rounds`` bounds the columns priced; a program cut short is still feasible.
    """
    size = len(demand)
    left = demand.astype(np.int64).copy()
    used = np.flatnonzero(left)
    chosen: list[tuple[np.ndarray, int]] = []
    if len(used):
        fill = size // (used + 1)
        columns = [np.where(np.arange(size) == c, f, 0) for c, f in zip(used, fill, strict=True)]
        inverse = np.diag(1.0 / fill)
        x = left[used] / fill
        duals = np.zeros(size)
        for _ in range(rounds):
            duals[used] = inverse.sum(axis=0)
            value, pattern = best_pattern(duals)
            if value <= 1 + gap:
                break
            move = inverse @ pattern[used]
            rows = np.flatnonzero(move > 1e-9)
            ratio = x[rows] / move[rows]
            out = rows[np.argmin(ratio)]
            step = x[out] / move[out]
            x -= step * move
            x[out] = step
            inverse[out] /= move[out]
            other = np.arange(len(used)) != out
            inverse[other] -= np.outer(move[other], inverse[out])
            columns[out] = pattern
        for pattern, times in zip(columns, np.floor(x + 1e-9).astype(np.int64), strict=True):
            need = pattern > 0
            times = min(times, (left[need] // pattern[need]).min())
            if times > 0:
                chosen.append((pattern, int(times)))
                left -= pattern * times
    while left.any():
        pattern, room = np.zeros(size, np.int64), size
        for c in np.flatnonzero(left)[::-1]:
            pattern[c] = min(left[c], room // (c + 1))
            room -= pattern[c] * (c + 1)
        need = pattern > 0
        times = int((left[need] // pattern[need]).min())
        chosen.append((pattern, times))
        left -= pattern * times
    return chosen


def slots(chosen: list[tuple[np.ndarray, int]]) -> dict[int, np.ndarray]:
    """Per class: rows of (first rank, first sequence, repeats) in ascending rank."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    rank: dict[int, int] = {}
    first = 0
    for pattern, times in chosen:
        for c in np.flatnonzero(pattern):
            c = int(c)
            out.setdefault(c, []).append((rank.get(c, 0), first, times))
            rank[c] = rank.get(c, 0) + int(pattern[c]) * times
        first += times
    return {c: np.array(v, np.int64) for c, v in out.items()}


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, length: int, grain: int) -> DataFrame:
    """Token pieces of every text, each with its class and its number within task and class."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    classes = -(-length // grain)
    end = struct.pack("<I", end_id)
    names = PIECES.replace(",", "").split()
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in zip(names[::2], names[1::2], strict=True)])

    def cut(batches: Batches) -> Batches:
        enc, part, row = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        seen = np.zeros(classes, np.int64)
        for batch in batches:
            numbers, out = column(batch, "doc_id").to_pylist(), []
            for number, ids in zip(numbers, enc.encode(filled(column(batch, "text"))), strict=True):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, length):
                    piece = ids[4 * start : 4 * (start + length)]
                    n = len(piece) // 4
                    c = (n - 1) // grain
                    out.append((part, row, c, int(seen[c]), number, start, n, total, piece))
                    seen[c] += 1
                    row += 1
            yield record(schema, *map(list, zip(*out, strict=True)))

    return map_batches(rows, cut, PIECES)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 1,
    length: int = 2048,
    grain: int = 8,
) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, ids) with sequence_id and offset."""
    cut = written(pieces(docs, tokenizer_path, end_id, length, grain), "pieces")
    meta = cut.select("part", "row", "cls", "nth", "length")
    counts = meta.groupBy("part", "cls").agg(F.count(F.lit(1)).alias("_n"))
    histogram = meta.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).collect()  # length/grain rows
    demand = np.zeros(-(-length // grain), np.int64)
    for r in histogram:
        demand[r["cls"]] = r["n"]
    where = slots(solve(demand))

    earlier = Window.partitionBy("cls").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "cls", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    ranked = meta.join(base, ["part", "cls"]).select(
        "part", "row", "cls", (F.col("nth") + F.col("_base")).alias("rank"), "length"
    )
    fields = [("part", pa.int32()), ("row", pa.int64()), ("sequence_id", pa.int64())]
    schema = pa.schema([*fields, ("slot", pa.int64()), ("length", pa.int64())])

    def place(batches: Batches) -> Batches:
        for batch in batches:
            cls, rank = (column(batch, n).to_numpy() for n in ("cls", "rank"))
            sequence, copy = np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int64)
            for c in np.unique(cls):
                at = np.flatnonzero(cls == c)
                table = where[int(c)]
                first, base_id, times = table[np.searchsorted(table[:, 0], rank[at], "right") - 1].T
                copy[at], instance = np.divmod(rank[at] - first, times)
                sequence[at] = base_id + instance
            slot = (length - cls.astype(np.int64)) * (length + 1) + copy
            yield record(schema, column(batch, "part"), column(batch, "row"), sequence, slot, column(batch, "length"))

    placed = map_batches(ranked, place, "part int, row long, sequence_id long, slot long, length long")
    # At most length/1 pieces share a sequence, so these windows stay small.
    inside = Window.partitionBy("sequence_id").orderBy("slot", "part", "row")
    offset = F.coalesce(F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spot = placed.select("part", "row", "sequence_id", offset.cast("long").alias("offset"))
    return cut.join(spot, ["part", "row"]).select(
        "doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"
    )


def crc32_of(ids: bytes) -> int:
    """What the query's ids_crc32 must equal for one piece."""
    return zlib.crc32(ids)
