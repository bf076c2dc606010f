"""Merkle manifest of a dataset: a tree whose parents keep the hash states before each child slot.

Every row is a leaf. Leaves of a group (a language) are put in order, and runs of
``fan_out`` consecutive nodes become their hash until one is left, the group's
subroot; the subroots are folded likewise into the root. A parent's hash reads its
children's digests as hexadecimal text, one block of SHA-256 each, so the state before
a slot is eight words. ``build`` stores them beside the digests. ``fold`` takes a
replaced leaf upwards: it resumes the state before the leaf's slot, absorbs the
replacement and the siblings to its right, and never reads those to its left.

At scale a group is cut into blocks of ``fan_out ** height`` consecutive leaves. One
task folds a block, blocks' tops are the leaves of the next storey, and a storey has
a few thousand times fewer rows than the one below it. Only leaves of 32 bytes with
their keys are exchanged, never the fields they stand for. A path from a block to the
root is made once per block and meets the block's leaves in its own exchange.

Defined results: null fields are written as ``-``; a null group comes first and is a
group like any other; null keys come first in their group; rows with equal keys are
ordered by their leaf, and equal rows are leaves of their own; an empty table has no
root and no rows; columns that are not named are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnspark.llm import sha_midstate as sha
from txnspark.llm.common import Batches, column, map_batches, record
from txnspark.operators import ordered
from txnspark.sources.scratch import written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Leaves that are folded in one go, in whole blocks.
LEAVES_AT_ONCE = 16_384
#: Bytes of blocks that wait for their leaves to be folded.
BYTES_AT_ONCE = 32 << 20

NODE = "grp string, pos long, digest binary"
BLOCK = "grp string, block long, n int, height int, digests binary, states binary"


def leaf(fields: Sequence[Column]) -> Column:
    """SHA-256 of the fields, each its byte count, a colon and itself, or ``-``."""
    parts = []
    for f in fields:
        text = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def group_of(by: str) -> Column:
    """A text that is never null and sorts as the group does, null first."""
    return F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit(""))


def leaves(
    docs: DataFrame,
    fields: Sequence[str] = FIELDS,
    by: str = "lang",
    key: str = "doc_id",
    tampered: dict[str, Column] | None = None,
    where: Column | None = None,
) -> DataFrame:
    """(grp, pos, key, digest, given): every row's leaf and its place in its group.

    ``given`` is the leaf after ``tampered`` replaced fields by expressions, where
    ``where`` holds. One range exchange of the leaves orders them; a group may span any
    number of tasks. What is counted afterwards is one row per group and task.
    """
    own = leaf([F.col(f) for f in fields])
    given = own
    if tampered:
        other = leaf([tampered.get(f, F.col(f)) for f in fields])
        given = F.when(F.coalesce(where, F.lit(False)), other).otherwise(own) if where is not None else other
    rows = docs.select(group_of(by).alias("grp"), F.col(key).cast("long").alias("key"), own.alias("digest"), given.alias("given"))
    # The last column tells equal rows apart, so that many of them need not meet in one task.
    rows = rows.withColumn("_same", F.monotonically_increasing_id())
    order = [F.col(c) for c in ("key", "digest", "_same")]
    parts = written(rows.repartitionByRange("grp", *order).withColumn("_part", F.spark_partition_id()), "leaves")
    sizes = parts.groupBy(F.col("grp").alias("_grp"), F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy("_grp").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_grp", "_p", F.coalesce(F.sum("_n").over(group), F.lit(0)).alias("_start"))
    same = (F.col("grp") == F.col("_grp")) & (F.col("_part") == F.col("_p"))
    here = F.row_number().over(Window.partitionBy("grp", "_part").orderBy(*order)) - 1
    placed = parts.withColumn("_here", here).join(ordered.broadcast_small(starts), same)
    return placed.select("grp", (F.col("_start") + F.col("_here")).alias("pos"), "key", "digest", "given")


# ------------------------------------------------------------------- blocks


@dataclass
class Levels:
    """Some whole blocks side by side: level 0 holds their leaves, the last one their tops."""

    sizes: np.ndarray  # nodes of each block on this level, and per level below
    digests: list[np.ndarray]  # per level (8, nodes)
    states: list[np.ndarray]  # per level but the last: the state before each node's slot
    counts: list[np.ndarray]  # per level: nodes of each block


def fold_blocks(digests: np.ndarray, sizes: np.ndarray, heights: np.ndarray, fan_out: int) -> Levels:
    """All levels of the blocks; block b is folded ``heights[b]`` times."""
    out = Levels(sizes, [digests], [], [sizes])
    for level in range(int(heights.max(initial=0))):
        nodes, count = out.digests[-1], out.counts[-1]
        on = heights > level
        ahead = np.where(on, -(-count // fan_out), count)
        block = np.repeat(np.arange(len(count)), count)
        place = np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count)
        first = np.cumsum(ahead) - ahead
        slot = np.where(on[block], place % fan_out, 0)
        parent = first[block] + np.where(on[block], place // fan_out, place)
        state, before = sha.start(int(ahead.sum())), sha.start(len(block))
        folds = on[block]
        for s in range(fan_out):
            child = np.flatnonzero(folds & (slot == s))
            before[:, child] = state[:, parent[child]]
            state[:, parent[child]] = sha.absorb(state[:, parent[child]], nodes[:, child])
        held = np.bincount(parent, minlength=state.shape[1])
        # A block that is finished hands its top on as it is.
        passed = np.flatnonzero(~folds)
        done = np.ones(state.shape[1], bool)
        done[parent[passed]] = False
        up = np.empty_like(state)
        up[:, parent[passed]] = nodes[:, passed]
        up[:, done] = sha.finish(state[:, done], held[done])
        out.digests.append(up)
        out.states.append(before)
        out.counts.append(ahead)
    return out


def _height(n: int, fan_out: int) -> int:
    levels = 0
    while n > 1:
        n, levels = -(-n // fan_out), levels + 1
    return levels


def _level_sizes(n: int, height: int, fan_out: int) -> list[int]:
    out = [n]
    for _ in range(height):
        out.append(-(-out[-1] // fan_out))
    return out


def _digest_array(values: pa.Array) -> np.ndarray:
    """(digests, 32) bytes of a binary column that holds digests one after the other."""
    raw = b"".join(values.to_pylist())
    return np.frombuffer(raw, np.uint8).reshape(-1, 32)


def _storey(nodes: DataFrame, fan_out: int, height: int) -> DataFrame:
    """Nodes (grp, pos, digest, blocks) folded block by block; the last digest is a block's top."""
    span = fan_out**height
    schema = pa.schema(
        [("grp", pa.string()), ("block", pa.int64()), ("n", pa.int32()), ("height", pa.int32())]
        + [("digests", pa.binary()), ("states", pa.binary())]
    )

    def done(rows: pa.Table) -> pa.RecordBatch:
        pos, blocks = rows["pos"].to_numpy(), rows["blocks"].to_numpy()
        first = np.flatnonzero(pos % span == 0)
        sizes = np.diff([*first, len(pos)])
        heights = np.array([height if blocks[f] > 1 else _height(int(n), fan_out) for f, n in zip(first, sizes, strict=True)])
        levels = fold_blocks(sha.words_of(_digest_array(rows["digest"].combine_chunks())), sizes, heights, fan_out)
        made: list[list[bytes]] = [[] for _ in first]
        kept: list[list[bytes]] = [[] for _ in first]
        for level, count in enumerate(levels.counts):
            ends = np.cumsum(count)
            raw = sha.bytes_of(levels.digests[level])
            states = sha.bytes_of(levels.states[level]) if level < len(levels.states) else None
            for b in np.flatnonzero(heights >= level).tolist():
                part = slice(ends[b] - count[b], ends[b])
                made[b].append(raw[part].tobytes())
                if level < heights[b]:
                    kept[b].append(states[part].tobytes())
        return record(
            schema, rows["grp"].combine_chunks().take(pa.array(first)), pos[first] // span, sizes, heights,
            [b"".join(m) for m in made], [b"".join(k) for k in kept],
        )

    def fold(batches: Batches) -> Batches:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            starts = np.flatnonzero(column(batch, "pos").to_numpy() % span == 0)
            if rows >= LEAVES_AT_ONCE and len(starts):
                held.append(batch.slice(0, int(starts[0])))
                yield done(pa.Table.from_batches(held))
                batch, held, rows = batch.slice(int(starts[0])), [], 0
            held.append(batch)
            rows += len(batch)
        if rows:
            yield done(pa.Table.from_batches(held))

    block = F.expr(f"pos div {span}")
    rows = nodes.withColumn("_block", block).repartition("grp", "_block").sortWithinPartitions("grp", "pos").drop("_block")
    return map_batches(rows, fold, BLOCK)


def _storeys(nodes: DataFrame, fan_out: int, height: int, name: str) -> list[DataFrame]:
    """Storeys of blocks, each a written table, until every group has one block."""
    span, out = fan_out**height, []
    while True:
        group = nodes.groupBy(F.col("grp").alias("_grp")).agg(F.expr(f"(max(pos) div {span}) + 1").alias("blocks"))
        most = group.agg(F.max("blocks")).first()[0]
        if most is None:
            return out
        several = ordered.broadcast_small(group.where("blocks > 1"))
        sized = nodes.join(several, F.col("grp") == F.col("_grp"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        out.append(written(_storey(sized.select("grp", "pos", "digest", "blocks"), fan_out, height), name))
        if most == 1:
            return out
        nodes = out[-1].select("grp", F.col("block").alias("pos"), F.substring("digests", -32, 32).alias("digest"))


@dataclass(frozen=True)
class Manifest:
    """Storeys of the groups' trees and of the tree over them, and the root in hexadecimal text."""

    groups: list[DataFrame]
    above: list[DataFrame]
    order: DataFrame | None  # (grp, pos, digest): subroots
    root: str | None
    fan_out: int
    height: int


def build(nodes: DataFrame, fan_out: int = 2, height: int = 12) -> Manifest:
    """The tree over ``leaves``. Blocks of fan_out ** height leaves are folded in one task each."""
    groups = _storeys(nodes.select("grp", "pos", "digest"), fan_out, height, "storey")
    if not groups:
        return Manifest([], [], None, None, fan_out, height)
    tops = groups[-1].select("grp", F.substring("digests", -32, 32).alias("digest"))
    order = written(ordered.numbered(tops, [F.col("grp")], "pos").withColumn("pos", F.col("pos") - 1), "subroots")
    above = _storeys(order.select(F.lit("").alias("grp"), "pos", "digest"), fan_out, height, "above")
    root = above[-1].select(F.lower(F.hex(F.substring("digests", -32, 32)))).first()[0]
    return Manifest(groups, above, order, root, fan_out, height)


# -------------------------------------------------------------------- paths

# A step of a path: the parent's children, the slot among them, the state before the
# slot, and the siblings in order, as bytes.
_STEP_HEAD = 2


def _steps(n: int, height: int, digests: bytes, states: bytes, place: int, fan_out: int) -> bytes:
    """Steps from one leaf of a block to the block's top."""
    out, at = [], 0
    for size in _level_sizes(n, height, fan_out)[:-1]:
        low = place - place % fan_out
        high = min(low + fan_out, size)
        own = 32 * (at + place)
        out += [bytes((high - low, place - low)), states[own : own + 32]]
        out += [digests[32 * (at + low) : own], digests[own + 32 : 32 * (at + high)]]
        at, place = at + size, place // fan_out
    return b"".join(out)


def _parsed(path: bytes) -> list[tuple[int, int, bytes, list[bytes]]]:
    """(children, slot, state, siblings) of every step."""
    out, at = [], 0
    while at < len(path):
        held, slot = path[at], path[at + 1]
        at += _STEP_HEAD
        state, rest = path[at : at + 32], path[at + 32 : at + 32 * held]
        out.append((held, slot, state, [rest[i : i + 32] for i in range(0, len(rest), 32)]))
        at += 32 * held
    return out


def _expanded(storey: DataFrame, paths: DataFrame, fan_out: int, height: int) -> DataFrame:
    """Paths (grp, block, path, subroot) of blocks as paths (grp, pos, path, subroot) of their leaves."""
    schema = pa.schema([("grp", pa.string()), ("pos", pa.int64()), ("path", pa.binary()), ("subroot", pa.binary())])
    span = fan_out**height
    joined = storey.join(paths.select(F.col("grp").alias("_g"), F.col("block").alias("_b"), "path", "subroot"),
                         (F.col("grp") == F.col("_g")) & (F.col("block") == F.col("_b")))

    def expand(batches: Batches) -> Batches:
        for batch in batches:
            for row in batch.to_pylist():
                n, h, parts = row["n"], row["height"], (row["digests"], row["states"])
                for low in range(0, n, 256):
                    places = range(low, min(low + 256, n))
                    paths = [_steps(n, h, *parts, i, fan_out) + row["path"] for i in places]
                    pos = [row["block"] * span + i for i in places]
                    yield record(schema, [row["grp"]] * len(pos), pos, paths, [row["subroot"]] * len(pos))

    fields = ["grp", "block", "n", "height", "digests", "states", "path", "subroot"]
    return map_batches(joined.select(*fields), expand, "grp string, pos long, path binary, subroot binary")


def block_paths(tree: Manifest) -> DataFrame:
    """(grp, block, path, subroot): the way from every block of leaves to the root."""
    here = tree.above[-1].select("grp", "block", F.lit(b"").alias("path"), F.lit(None).cast("binary").alias("subroot"))
    for storey in reversed(tree.above):
        down = _expanded(storey, here, tree.fan_out, tree.height)
        here = written(down.withColumnRenamed("pos", "block"), "paths")
    own = here.select(F.col("block").alias("_pos"), "path")
    named = tree.order.join(own, F.col("pos") == F.col("_pos"))
    here = named.select("grp", F.lit(0).cast("long").alias("block"), "path", F.col("digest").alias("subroot"))
    for storey in reversed(tree.groups[1:]):
        down = _expanded(storey, here, tree.fan_out, tree.height)
        here = written(down.withColumnRenamed("pos", "block"), "paths")
    return here


class _Lanes:
    """Leaves on their way up: the digest each one brings, and the hash of the siblings it passed."""

    def __init__(self, given: np.ndarray):
        self.now = given
        self.proof = sha.start(given.shape[1])
        self.passed = np.zeros(given.shape[1], np.int64)

    def step(self, lanes, held, slot, state, sibling) -> None:
        """One level: ``sibling(s, among)`` gives the digests in slot s of the parents of ``lanes[among]``."""
        up = sha.absorb(state, self.now[:, lanes])
        for s in range(int(held.max(initial=0))):
            among = np.flatnonzero((held > s) & (slot != s))
            if not len(among):
                continue
            other = sibling(s, among)
            self.proof[:, lanes[among]] = sha.absorb(self.proof[:, lanes[among]], other)
            self.passed[lanes[among]] += 1
            right = slot[among] < s
            up[:, among[right]] = sha.absorb(up[:, among[right]], other[:, right])
        self.now[:, lanes] = sha.finish(up, held)


def _climb(blocks: list[dict], owner: np.ndarray, place: np.ndarray, lanes: _Lanes, fan_out: int) -> None:
    """Leaves up to the tops of their blocks, then along the blocks' paths to the root, all lanes at once."""
    digests, states = (sha.words_of(_digest_array(pa.array([b[c] for b in blocks]))) for c in ("digests", "states"))
    held = np.array([[len(b[c]) // 32 for b in blocks] for c in ("digests", "states")])
    base, state_base = np.cumsum(held, 1) - held
    heights, size = (np.array([b[c] for b in blocks]) for c in ("height", "n"))
    for level in range(int(heights.max(initial=0))):
        on = heights > level
        every = np.flatnonzero(on[owner])
        block, here = owner[every], place[every]
        low = here - here % fan_out
        lanes.step(
            every, np.minimum(low + fan_out, size[block]) - low, here - low, states[:, state_base[block] + here],
            lambda s, a, at=base[block] + low: digests[:, at[a] + s],
        )
        place[every] = here // fan_out
        base, state_base = base + on * size, state_base + on * size
        size = np.where(on, -(-size // fan_out), size)
    steps = [_parsed(b["path"]) for b in blocks]
    for i in range(max(map(len, steps), default=0)):
        on = np.array([len(p) > i for p in steps])
        every = np.flatnonzero(on[owner])
        now = [p[i] for p in steps if len(p) > i]
        block = (np.cumsum(on) - 1)[owner[every]]
        children, slot = (np.array([n[j] for n in now]) for j in (0, 1))
        state = sha.words_of(_digest_array(pa.array([n[2] for n in now])))
        siblings = sha.words_of(_digest_array(pa.array([x for n in now for x in n[3]], pa.binary())))
        first = np.cumsum(children - 1) - (children - 1)
        lanes.step(
            every, children[block], slot[block], state[:, block],
            lambda s, a, b=block, f=first, x=slot, y=siblings: y[:, f[b[a]] + s - (s > x[b[a]])],
        )


def fold(tree: Manifest, given: DataFrame) -> DataFrame:
    """(key, pos, digest, subroot, proof, folded): rows of ``given`` (as ``leaves``) taken to the root.

    Only the rows handed in are folded, with the tree's states and right siblings;
    ``proof`` is the hash of all siblings passed, level by level, left to right.
    """
    span = tree.fan_out**tree.height
    if tree.root is None:
        none = [F.lit(None).cast("binary").alias(c) for c in ("subroot", "proof", "folded")]
        return given.where(F.lit(False)).select("key", "pos", "digest", *none)
    paths = block_paths(tree).select(F.col("grp").alias("_g"), F.col("block").alias("_b"), "path", "subroot")
    same = (F.col("grp") == F.col("_g")) & (F.col("block") == F.col("_b"))
    nothing = {c: F.lit(None).cast(t) for c, t in (("key", "long"), ("digest", "binary"), ("given", "binary"))}
    blocks = tree.groups[0].join(paths, same).withColumns(nothing).withColumn("pos", F.lit(None).cast("long"))
    fields = ["n", "height", "digests", "states", "path", "subroot"]
    none = {f.name: F.lit(None).cast(f.dataType) for f in blocks.schema if f.name in fields}
    rows = given.withColumn("block", F.expr(f"pos div {span}")).withColumns(none)
    names = ["grp", "block", "pos", "key", "digest", "given", *fields]
    both = blocks.select(*names).unionByName(rows.select(*names))
    # The block's own row comes before those of its leaves.
    both = both.repartition("grp", "block").sortWithinPartitions("grp", "block", F.col("pos").asc_nulls_first())
    out = [("key", pa.int64()), ("pos", pa.int64()), *((c, pa.binary()) for c in ("digest", "subroot", "proof", "folded"))]
    schema = pa.schema(out)
    fan_out = tree.fan_out

    def done(blocks: list[dict], held: list[tuple[int, pa.RecordBatch]]) -> pa.RecordBatch:
        rows = pa.Table.from_batches([part for _, part in held]).combine_chunks()
        owner = np.repeat([b for b, _ in held], [len(part) for _, part in held])
        lanes = _Lanes(sha.words_of(_digest_array(rows["given"].combine_chunks())))
        _climb(blocks, owner, rows["pos"].to_numpy() % span, lanes, fan_out)
        proof, folded = (sha.bytes_of(w) for w in (sha.finish(lanes.proof, lanes.passed), lanes.now))
        return record(
            schema, *(rows[c].combine_chunks() for c in ("key", "pos", "digest")),
            [blocks[b]["subroot"] for b in owner.tolist()], [r.tobytes() for r in proof], [r.tobytes() for r in folded],
        )

    def climb(batches: Batches) -> Batches:
        blocks: list[dict] = []
        held: list[tuple[int, pa.RecordBatch]] = []
        rows = size = 0
        for batch in batches:
            heads = np.flatnonzero(column(batch, "pos").is_null().to_numpy(zero_copy_only=False)).tolist()
            starts = set(heads)
            edges = [*([] if heads and heads[0] == 0 else [0]), *heads, len(batch)]
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                if low in starts:
                    if rows >= LEAVES_AT_ONCE or size > BYTES_AT_ONCE:
                        if rows:
                            yield done(blocks, held)
                        blocks, held, rows, size = [], [], 0, 0
                    blocks += batch.slice(low, 1).to_pylist()
                    size += sum(len(blocks[-1][c]) for c in ("digests", "states", "path"))
                    low += 1
                if low < high:
                    held.append((len(blocks) - 1, batch.slice(low, high - low).select(["key", "pos", "digest", "given"])))
                    rows += high - low
        if rows:
            yield done(blocks, held)

    kinds = "key long, pos long, digest binary, subroot binary, proof binary, folded binary"
    return map_batches(both, climb, kinds)
