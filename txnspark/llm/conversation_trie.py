"""Conversation prefix trie: ROLLUP over positional turn-id columns.

A node is a distinct sequence of first turns, from the textless root on. Its id is its
depth and the smallest conversation that begins with it. A row holds ``width`` turns of
one conversation as columns t1..tN; one ROLLUP over them aggregates the prefixes of all
depths together, and grouping_id tells the depth. A conversation of more turns goes on
in further rows, whose columns are grouped under the node that the row before ended in.
That node's key is a running total over the conversation (two sums of hashes of position
and turn), so no row has to meet another to know it, and one ROLLUP does all blocks.

What a node's subtree holds is a second ROLLUP over the same rows. Every node is
represented by its smallest conversation, so the nodes that a conversation represents
are the last ones on its way. Their values, added up from the end, are columns again,
and a node's total is the sum over its members. No level of the trie waits for another.

Only ids of 16 bytes and word counts are exchanged, never texts. Long conversations are
numbered in blocks by range (``operators.ordered``). Children find their parent with hot
parents apart. The checksum over a node's conversations has to see them one after the
other; they are put together to texts of thousands of numbers by all tasks first.

Defined results: a null role or text is empty; rows without a conversation number
belong to none and are left out; a null turn comes first; rows of one conversation with
equal turn are ordered by the hash of role and text, and equal rows stay separate turns;
an empty table has no node, not even a root; other columns are not read. Turns and
prefixes are told apart by 128-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnspark.llm.common import Batches, column, map_batches, record
from txnspark.operators import joins, ordered
from txnspark.operators.ordered import HOT_ROWS
from txnspark.sources.scratch import written

WORD = r"[^\x20\x09-\x0D]+"
TOTAL = "decimal(38,0)"
#: Conversation numbers in one text on their way to a node's checksum.
CHUNK = 4096
#: Nodes that are broadcast when children look for their parents.
BROADCAST_NODES = 20_000


def turns(conversations: DataFrame, limit: int = HOT_ROWS) -> DataFrame:
    """(conv_id, pos, n_turns, turn_id, words): every turn with its place, from 1, in its conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.unhex(F.md5(named.cast("binary"))).alias("turn_id"), F.regexp_count(text, F.lit(WORD)).alias("words"),
    )
    return _placed(rows, [F.col("turn").asc_nulls_first(), F.col("turn_id")], limit)


def _placed(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    one = (F.lit(1).cast("long"), "sum", True)
    out = ordered.running(rows, ["conv_id"], order, {"pos": one}, totals=True, limit=limit)
    return out.select("conv_id", "pos", F.col("total_pos").alias("n_turns"), "turn_id", "words")


def with_root_rows(placed: DataFrame) -> DataFrame:
    """One more row per conversation, at place 0, which stands for the root."""
    root = placed.where("pos = 1").withColumns({"pos": F.lit(0).cast("long"), "turn_id": F.lit(None).cast("binary"), "words": F.lit(0)})
    return placed.unionByName(root)


def with_shared_heads(placed: DataFrame, every: int, longest: Column, most: int, limit: int = HOT_ROWS) -> DataFrame:
    """Conversations whose first turns come from the one at the last multiple of ``every``.

    The first ``longest`` turns (at most ``most``) of that conversation, all if it has
    fewer and none if it does not exist, then the own turns after the first ``longest``.
    Rows as from ``with_root_rows``: a conversation left without turns keeps its root row.
    """
    first = placed.where((F.col("pos") <= most) & (F.col("conv_id") % every == 0))
    heads = first.groupBy(F.col("conv_id").alias("_base")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "turn_id", "words"))).alias("_head")
    )
    base = F.col("conv_id") - F.col("conv_id") % every
    starts = placed.where("pos = 1").select("conv_id", longest.alias("_h"), base.alias("_base")).join(heads, "_base")
    taken = starts.select("conv_id", F.inline(F.slice("_head", F.lit(1), F.col("_h"))))
    own = placed.where(F.col("pos") > longest).select("conv_id", "pos", "turn_id", "words")
    root = with_root_rows(placed).where("pos = 0").select("conv_id", "pos", "turn_id", "words")
    rows = root.withColumn("_part", F.lit(0)).unionByName(taken.withColumn("_part", F.lit(1)))
    rows = rows.unionByName(own.withColumn("_part", F.lit(2)))
    out = _placed(rows, [F.col("_part"), F.col("pos")], limit)
    return out.withColumns({"pos": F.col("pos") - 1, "n_turns": F.col("n_turns") - 1})


def _hashes(pos: Column, turn: Column) -> list[Column]:
    """Two numbers of a turn at a place; their sums over a prefix are the prefix's key."""
    made = [F.xxhash64(F.lit(seed), pos.cast("long"), turn) for seed in ("first", "second")]
    return [F.when(turn.isNotNull(), F.shiftright(h, 2)).otherwise(F.lit(0)).cast("long") for h in made]


def _blocks(placed: DataFrame, width: int, limit: int) -> DataFrame:
    """(conv_id, block, n_turns, t1..tN, p1, p2, s1, s2): rows of turns, the key before them, what they add."""
    at = F.greatest(F.col("pos") - 1, F.lit(0))
    hashes = dict(zip(("s1", "s2"), _hashes(F.col("pos"), F.col("turn_id")), strict=True))
    rows = placed.withColumns({"block": F.expr(f"greatest(pos - 1, 0) div {width}"), "_j": F.when(F.col("pos") > 0, at % width + 1), **hashes})
    turn = F.struct("turn_id", "words")
    blocks = rows.groupBy("conv_id", "block").agg(
        F.max("n_turns").alias("n_turns"),
        *[F.max(F.when(F.col("_j") == i, turn)).alias(f"t{i}") for i in range(1, width + 1)],
        *[F.sum(F.col(s).cast(TOTAL)).cast(TOTAL).alias(s) for s in hashes],
    )
    before = {f"p{i}": (F.col(f"s{i}"), "sum", False) for i in (1, 2)}
    nothing = {p: F.lit(0).cast(TOTAL) for p in before}
    long = ordered.running(blocks.where(F.col("n_turns") > width), ["conv_id"], [F.col("block")], before, limit=limit)
    typed = {p: F.col(p).cast(TOTAL) for p in before}
    return blocks.where(F.col("n_turns") <= width).withColumns(nothing).unionByName(long.withColumns(typed))


def _rolled(blocks: DataFrame, width: int, aggregates: str) -> DataFrame:
    """All prefixes of all blocks at once: ``level`` turns of a block, and the aggregates over its members."""
    names = ", ".join(f"t{i}" for i in range(1, width + 1))
    rolled = blocks.sparkSession.sql(
        f"SELECT block, p1, p2, {names}, {width} - bit_count(grouping_id()) AS level, {aggregates} "
        f"FROM {{rows}} GROUP BY block, p1, p2, ROLLUP({names})", rows=blocks,
    )
    last = F.get(F.array(*[F.col(f"t{i}") for i in range(1, width + 1)]), F.col("level").cast("int") - 1)
    # A level beyond a conversation's end is no prefix, and a block's level 0 is the node before it.
    real = F.when(F.col("level") > 0, last.isNotNull()).otherwise(F.col("block") == 0)
    return rolled.withColumn("_last", last).where(real)


def _key(depth: Column, one: Column, two: Column) -> Column:
    return F.concat_ws(":", *[c.cast("string") for c in (depth, one, two)])


def _nodes(blocks: DataFrame, width: int) -> DataFrame:
    """(depth, conv_id, n_convs, key, parent_key, turn_id, words) of every node."""
    rolled = _rolled(blocks, width, "count(*) AS n_convs, min(conv_id) AS conv_id")
    depth = (F.col("block") * width + F.col("level")).alias("depth")
    sums = {1: F.col("p1"), 2: F.col("p2")}
    for i in range(1, width + 1):
        inside = F.col("level") >= i
        for n, z in zip((1, 2), _hashes(F.col("block") * width + i, F.col(f"t{i}.turn_id")), strict=True):
            sums[n] = sums[n] + F.when(inside, z).otherwise(F.lit(0)).cast(TOTAL)
    # A sum of decimals is given more digits than it needs.
    sums = {n: s.cast(TOTAL) for n, s in sums.items()}
    own = _hashes(depth, F.col("_last.turn_id"))
    up = [(sums[n] - z.cast(TOTAL)).cast(TOTAL) for n, z in zip((1, 2), own, strict=True)]
    return rolled.select(
        depth, "conv_id", "n_convs", _key(depth, sums[1], sums[2]).alias("key"),
        F.when(depth > 0, _key(depth - 1, *up)).alias("parent_key"),
        F.col("_last.turn_id").alias("turn_id"), F.coalesce("_last.words", F.lit(0)).cast("long").alias("words"),
    )


def _subtrees(blocks: DataFrame, nodes: DataFrame, width: int, limit: int) -> DataFrame:
    """(depth, conv_id, n_leaves, saved_tokens) of every node: sums over its members' last nodes."""
    at = F.greatest(F.col("depth") - 1, F.lit(0))
    saved = (F.col("n_convs") - 1) * F.col("words")
    place = F.when(F.col("depth") > 0, at % width + 1).otherwise(F.lit(0))
    own = nodes.select("conv_id", F.expr(f"greatest(depth - 1, 0) div {width}").alias("block"), place.alias("_j"),
                       saved.alias("_saved"), (F.col("n_children") == 0).cast("long").alias("_leaf"))
    held = own.groupBy("conv_id", "block").agg(
        *[F.sum(F.when(F.col("_j") == i, F.col("_saved")).otherwise(0)).alias(f"v{i}") for i in range(1, width + 1)],
        F.max("_leaf").alias("_leaf"),
    )
    values = [f"v{i}" for i in range(1, width + 1)]
    rows = blocks.join(held, ["conv_id", "block"], "left").fillna(0, [*values, "_leaf"])
    rows = rows.withColumn("_all", sum((F.col(v) for v in values[1:]), F.col(values[0])))
    later = {"_later": (F.col("_all"), "sum", False), "_leaves": (F.col("_leaf"), "sum", True)}
    long = ordered.running(rows.where(F.col("n_turns") > width), ["conv_id"], [F.col("block").desc()], later, limit=limit)
    short = rows.where(F.col("n_turns") <= width).withColumns({"_later": F.lit(0).cast("long"), "_leaves": F.col("_leaf")})
    rows, total = short.unionByName(long), F.col("_later")
    sums = {}
    for i in range(width, 0, -1):
        total = total + F.col(f"v{i}")
        sums[f"u{i}"] = total
    sums["u0"] = total
    pick = ", ".join(f"sum(u{i}) AS u{i}" for i in range(width + 1))
    rolled = _rolled(rows.withColumns(sums), width, f"min(conv_id) AS conv_id, sum(_leaves) AS n_leaves, {pick}")
    chosen = F.get(F.array(*[F.col(f"u{i}") for i in range(width + 1)]), F.col("level").cast("int"))
    depth = (F.col("block") * width + F.col("level")).alias("depth")
    return rolled.select(depth, "conv_id", "n_leaves", chosen.alias("saved_tokens"))


def _changes(values: pa.Array) -> np.ndarray:
    """Places where a sorted column's value is not that of the row before."""
    if len(values) < 2:
        return np.zeros(min(len(values), 1), np.int64)
    new = pc.not_equal(values.slice(1), values.slice(0, len(values) - 1)).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def member_checksums(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of rows (key, conv_id): SHA-256 of the numbers, ascending, comma-joined."""
    cut = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    chunk = pa.schema([("key", pa.string()), ("first", pa.int64()), ("ids", pa.binary())])

    def pack(batches: Batches) -> Batches:
        for batch in batches:
            keys, ids = column(batch, "key"), column(batch, "conv_id")
            bounds = [*_changes(keys).tolist(), len(batch)]
            parts = [(low, min(low + CHUNK, high)) for a, high in zip(bounds[:-1], bounds[1:], strict=True) for low in range(a, high, CHUNK)]
            text = [",".join(map(str, ids.slice(a, b - a).to_pylist())).encode() for a, b in parts]
            first = pa.array([a for a, _ in parts], pa.int64())
            yield record(chunk, keys.take(first), ids.take(first), text)

    packed = map_batches(cut, pack, "key string, first long, ids binary")
    packed = packed.repartition("key").sortWithinPartitions("key", "first")
    out = pa.schema([("key", pa.string()), ("ends_sha256", pa.string())])

    def digest(batches: Batches) -> Batches:
        now, state = None, None
        for batch in batches:
            done = []
            for key, ids in zip(column(batch, "key").to_pylist(), column(batch, "ids").to_pylist(), strict=True):
                if key == now:
                    state.update(b"," + ids)
                    continue
                if state is not None:
                    done.append((now, state.hexdigest()))
                now, state = key, hashlib.sha256(ids)
            yield record(out, [k for k, _ in done], [d for _, d in done])
        if state is not None:
            yield record(out, [now], [state.hexdigest()])

    return map_batches(packed, digest, "key string, ends_sha256 string")


def trie(placed: DataFrame, width: int = 8, limit: int = HOT_ROWS, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """All nodes of conversations given as rows of ``with_root_rows`` or ``with_shared_heads``.

    Returns conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    (tokens that a cache keyed by prefixes does not have to read again), ends_sha256, and
    the turn_id and words of the node's last turn.
    """
    blocks = written(_blocks(placed, width, limit), "blocks")
    nodes = written(_nodes(blocks, width), "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    counted = nodes.join(children, "key", "left").fillna(0, ["n_children"])
    counted = written(counted, "counted")
    inside = _subtrees(blocks, counted, width, limit)
    last = F.expr(f"greatest(n_turns - 1, 0) div {width}")
    ended = [(F.col(f"p{i}") + F.col(f"s{i}")).cast(TOTAL) for i in (1, 2)]
    ends = blocks.where(F.col("block") == last).select(_key(F.col("n_turns"), *ended).alias("key"), "conv_id")
    nobody = F.lit(hashlib.sha256(b"").hexdigest())
    out = counted.join(inside, ["depth", "conv_id"]).join(member_checksums(ends), "key", "left")
    names = nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    none = F.lit(None).cast("long")
    out = joins.lookup(out, names, "parent_key", "parent_conv_id", none, limit, broadcast_nodes)
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", nobody).alias("ends_sha256"), "turn_id", "words",
    )
