"""N-gram Jaccard self-join by a token-group matrix.

Texts become sets of hashed word n-grams. Equal sets are one class. Similar classes
are partitioned into groups; the matrix stores, for every token, the groups whose
union of signature tokens holds it. Two groups can only hold linked members if they
share enough signature tokens, which the matrix tells by counting; only pairs of groups
that reach this bound are opened and their members compared by exact set overlap.

* Signature: a total order on tokens, rare ones first by counts over all documents. Of
  a set of n tokens the first n - ceil(t n) + s are kept, s being ``SHARED``. Sets of n and
  m tokens with similarity t or more overlap in a = ceil(t (n + m) / (1 + t)) tokens at
  least, so the first s tokens of the overlap (all, if a is less) are among the first
  n - a + s of the one and m - a + s of the other.
* Groups: classes that share two of four min-hashes with the most typical class of such a
  min-hash (the one with the most frequent tokens) are verified against it; connected
  components of these links are the groups. A cluster of thousands of near copies thus
  enters the matrix about once, and is never expanded into pairs.
* Matrix: an entry (token, group) keeps the best place any member has the token at, as
  (1 + t) (place - s + 1) - n, and the least n. Entries of two groups meet only if both
  places are early enough for the other's size, which bounds the overlap of every pair of
  members, and only groups that meet at min(s, a) tokens are opened: a chance token does not.
* Opening: of a pair of groups the smaller one's members are the queries, and the larger
  one's are compared in blocks of ``BLOCK`` members. Pairs inside a group are already
  connected and need no comparison.

The result is exact, up to collisions of 64-bit hashes: the smallest doc_id reachable by
links. Counts that order the tokens are kept per cell of a fixed table, so the only data
broadcast are that table and id lists below ``BROADCAST_IDS``.

Defined results: null texts and texts without words have no tokens, link with nothing
and are their own component; texts with fewer than k words are one token; rows with
equal doc_id are one document for reachability; a null doc_id has no component and
links nothing; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnspark.llm.common import Batches, as_array, column, filled, flat_words, lists_of, map_batches, record, row_key, without
from txnspark.llm.components import components
from txnspark.sources.scratch import written

CELL_BITS, CELL_BLOCK = 22, 1 << 16
MINHASHES = 4
#: Tokens of their signatures that two linked sets share at least, if they overlap in as many.
SHARED = 3
BLOCK = 64
#: Meetings of a query and a block that one key of the join has, about.
MEETINGS = 1 << 16
BROADCAST_IDS = 1_000_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * _ODD[3]
    x = (x ^ (x >> np.uint64(29))) * _ODD[4]
    return x ^ (x >> np.uint64(32))


def shingles(text: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word k-grams of a batch (repeats included) and how many each row has."""
    words, sizes = flat_words(pc.ascii_lower(filled(text)))
    names = words.dictionary.to_pylist()
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), np.uint64, len(names))
    word = hashed[words.indices.to_numpy()] if len(names) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    size = sizes[doc]
    # A text of fewer than k words is one run of all its words.
    take = np.where(size < k, at == 0, at <= size - k)
    out = mixed(np.minimum(size, k).astype(np.uint64))
    for j in range(k):
        moved = np.zeros_like(word)
        moved[: max(0, len(word) - j)] = word[j:]
        out = np.where(j < size, mixed(out * _ODD[0] + moved), out)
    return out[take], np.bincount(doc[take], minlength=len(sizes))


def token_counts(docs: DataFrame, k: int) -> np.ndarray:
    """How often the tokens of each cell occur, over all documents, up to 65,535."""
    schema = pa.schema([("block", pa.int32()), ("counts", pa.binary())])
    cells = 1 << CELL_BITS

    def partial(batches: Batches) -> Batches:
        counts = np.zeros(cells, np.uint32)
        for batch in batches:
            tokens, _ = shingles(column(batch, "text"), k)
            cell, n = np.unique((tokens >> np.uint64(64 - CELL_BITS)).astype(np.int32), return_counts=True)
            counts[cell] += n.astype(np.uint32)
        for i in range(cells // CELL_BLOCK):
            part = counts[i * CELL_BLOCK : (i + 1) * CELL_BLOCK]
            if part.any():
                yield record(schema, [i], [zlib.compress(part.astype("<u4").tobytes(), 1)])

    def total(batches: Batches) -> Batches:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, data in zip(column(batch, "block").to_pylist(), column(batch, "counts").to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64)
                sums[i] = sums[i] + part if i in sums else part
        for i, part in sums.items():
            yield record(schema, [i], [np.minimum(part, 65_535).astype("<u2").tobytes()])

    shape, blocks = "block int, counts binary", cells // CELL_BLOCK
    summed = map_batches(map_batches(docs.select("text"), partial, shape).repartition(blocks, "block"), total, shape)
    out = np.zeros((blocks, CELL_BLOCK), np.uint16)
    for row in summed.collect():  # two bytes per cell
        out[row["block"]] = np.frombuffer(row["counts"], "<u2")
    return out.ravel()


def signatures(docs: DataFrame, k: int, percent: int, order: np.ndarray) -> DataFrame:
    """(doc_id, n, f1, f2, typical, minhashes, tokens) of every document; n is the set's size."""
    shared = docs.sparkSession.sparkContext.broadcast(order)  # two bytes per cell
    shape = "doc_id long, n long, f1 long, f2 long, typical double, minhashes array<long>, tokens array<long>"
    names = [f.split()[0] for f in shape.split(", ")]

    def sign(batches: Batches) -> Batches:
        weight = shared.value
        for batch in batches:
            tokens, sizes = shingles(column(batch, "text"), k)
            ends = np.cumsum(sizes)
            n, lengths = (np.zeros(len(sizes), np.int64) for _ in range(2))
            typical = np.zeros(len(sizes))
            prints = np.zeros((2, len(sizes)), np.uint64)
            low, chosen = np.zeros((len(sizes), MINHASHES), np.uint64), []
            for i in np.flatnonzero(sizes):
                own = np.unique(tokens[ends[i] - sizes[i] : ends[i]])
                n[i] = len(own)
                seen = weight[(own >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
                rank = np.argsort(seen, kind="stable")
                lengths[i] = min(len(own), len(own) - (-(-len(own) * percent // 100)) + SHARED)
                chosen.append(own[rank[: lengths[i]]])
                typical[i] = np.log1p(seen).mean()
                prints[0, i] = mixed(own + _ODD[1]).sum(dtype=np.uint64)
                prints[1, i] = np.bitwise_xor.reduce(mixed(own + _ODD[2]))
                low[i] = [(own * m).min() for m in _ODD[:MINHASHES]]
            flat = np.concatenate([*chosen, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "doc_id"), as_array(n), as_array(prints[0].view(np.int64)),
                    as_array(prints[1].view(np.int64)), as_array(typical),
                    lists_of(pa.array(low.ravel().view(np.int64)), np.full(len(sizes), MINHASHES)),
                    lists_of(pa.array(flat), lengths),
                ],
                names=names,
            )

    return map_batches(docs, sign, shape)


def sets_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """``ids`` (an id and other long columns) with the tokens, found where the texts lie if few."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    wanted = docs.join(F.broadcast(ids) if few else ids, docs["doc_id"] == ids["id"])
    names = ids.columns
    schema = pa.schema([*[(c, pa.int64()) for c in names], ("tokens", pa.list_(pa.int64()))])

    def collect(batches: Batches) -> Batches:
        for batch in batches:
            tokens, sizes = shingles(column(batch, "text"), k)
            ends = np.cumsum(sizes)
            own = [np.unique(tokens[e - s : e]) for e, s in zip(ends, sizes, strict=True)]
            flat = np.concatenate([*own, np.zeros(0, np.uint64)]).view(np.int64)
            yield record(schema, *[column(batch, c) for c in names], lists_of(pa.array(flat), np.array([len(o) for o in own])))

    shape = ", ".join(f"{c} long" for c in names)
    return written(map_batches(wanted.select(*names, "text"), collect, f"{shape}, tokens array<long>"), "sets")


def similar(a: str, b: str, percent: int) -> F.Column:
    """Whether two token arrays are similar enough, exactly."""
    both = F.size(F.array_intersect(a, b))
    return 100 * both >= percent * (F.size(a) + F.size(b) - both)


def pivot_links(classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Verified links (a, b) of classes to the least class of shared min-hashes."""
    keys = classes.select("id", "n", "typical", F.posexplode("minhashes").alias("j", "key"))
    first = F.min(F.struct((-F.col("typical")).alias("t"), "id"))["id"]
    pivots = keys.groupBy("j", "key").agg(first.alias("pivot"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    # As a table of its own it leaves Spark free to split a key that many classes share.
    pivots = written(pivots.drop("_n"), "pivots")
    pairs = keys.join(pivots, ["j", "key"]).where("id <> pivot").groupBy("id", "n", "pivot").agg(F.count(F.lit(1)).alias("_shared"))
    other = classes.select(F.col("id").alias("pivot"), F.col("n").alias("_n2"))
    fits = (100 * F.least("n", "_n2") >= percent * F.greatest("n", "_n2")) & (F.col("_shared") > 1)
    pairs = written(pairs.join(other, "pivot").where(fits).select("id", "pivot"), "pairs")
    sets = sets_of(docs, pairs.select("id").union(pairs.select("pivot")).distinct(), k)
    one = pairs.join(sets, "id")
    two = sets.select(F.col("id").alias("pivot"), F.col("tokens").alias("_other"))
    found = one.join(two, "pivot").where(similar("tokens", "_other", percent))
    return written(found.select(F.col("id").alias("a"), F.col("pivot").alias("b")), "pivot-links")


def group_pairs(tokens: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs of groups (g, h) whose matrix entries leave room for a link, with their sizes."""
    entries = tokens.select("g", "n", F.posexplode("tokens").alias("place", "token"))
    spent = (100 + percent) * (F.col("place") - (SHARED - 1)) - 100 * F.col("n")
    # Dealt out by token alone they are where both the grouping and the join want them: they move once.
    entries = entries.select("token", "g", spent.alias("spent"), "n").repartition("token")
    matrix = entries.groupBy("token", "g").agg(F.min("spent").alias("spent"), F.min("n").alias("low"))
    theirs = matrix.select("token", *[F.col(c).alias(f"_{c}") for c in ("g", "spent", "low")])
    room = (F.col("spent") <= -percent * F.col("_low")) & (F.col("_spent") <= -percent * F.col("low"))
    met = matrix.join(theirs, "token").where((F.col("g") < F.col("_g")) & room)
    # Smaller sets overlap in fewer tokens, and then share all of these.
    least = F.least(F.lit(SHARED), F.ceil(percent * (F.col("low") + F.col("_low")) / (100 + percent)))
    shared = met.groupBy("g", F.col("_g").alias("h")).agg(F.count(F.lit(1)).alias("shared"), F.min(least).alias("least"))
    pairs = shared.where("shared >= least").select("g", "h")
    sizes = members.groupBy("g").agg(F.count(F.lit(1)).alias("size"))
    ours = sizes.select("g", F.col("size").alias("g_size"))
    return pairs.join(ours, "g").join(sizes.select(F.col("g").alias("h"), F.col("size").alias("h_size")), "h")


def open_groups(pairs: DataFrame, members: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between groups: members of the smaller group against blocks of the larger."""
    swap = F.col("g_size") > F.col("h_size")
    asked = pairs.select(
        F.when(swap, F.col("h")).otherwise(F.col("g")).alias("small"),
        F.when(swap, F.col("g")).otherwise(F.col("h")).alias("large"),
        F.greatest("g_size", "h_size").alias("size"), F.least("g_size", "h_size").alias("asking"),
    )
    asked = written(asked, "opened")
    of = members.select("g", "id")
    needed = of.join(asked.select(F.explode(F.array("small", "large")).alias("g")).distinct(), "g", "left_semi")
    held = sets_of(docs, needed.select("id", "g").distinct(), k)
    # A group that many others ask for is dealt out: each part of the queries meets all its blocks.
    wide = asked.groupBy("large").agg(F.max("size").alias("size"), F.sum("asking").alias("asking"))
    meetings = F.ceil(F.col("size") / BLOCK) * F.col("asking")
    wide = wide.select("large", "size", F.least(F.col("asking"), F.ceil(meetings / MEETINGS)).cast("int").alias("parts"))
    number = F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / BLOCK)).alias("block")
    blocks = held.join(wide, held["g"] == wide["large"]).select("large", "parts", number, F.struct("id", "tokens").alias("_m"))
    blocks = blocks.groupBy("large", "parts", "block").agg(F.collect_list("_m").alias("block_members"))  # about BLOCK members
    blocks = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    part = F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part")
    queries = asked.select("small", "large").join(wide.select("large", "parts"), "large").join(held, F.col("small") == F.col("g"))
    met = queries.select("large", part, F.col("id").alias("a"), F.col("tokens").alias("_q")).join(blocks, ["large", "part"])
    hit = F.filter("block_members", lambda m: similar_to(m["tokens"], F.col("_q"), percent))
    # One link of a query into a block's group is enough: its members are connected.
    return met.select("a", F.get(hit, F.lit(0))["id"].alias("b")).where("b IS NOT NULL")


def similar_to(a: F.Column, b: F.Column, percent: int) -> F.Column:
    """``similar`` for columns, the sizes compared first."""
    fits = 100 * F.least(F.size(a), F.size(b)) >= percent * F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    return F.when(fits, 100 * both >= percent * (F.size(a) + F.size(b) - both)).otherwise(False)


def signed_row() -> F.Column:
    """A hash of a document's number and its set's fingerprint."""
    return F.xxhash64("doc_id", "f1", "f2", "n")


def grouped_tokens(some: DataFrame, others: DataFrame, first: DataFrame, members: DataFrame) -> DataFrame:
    """(g, n, tokens) of the rows of ``some`` that stand for their class; repeated rows stay.

    The rows that stand for none (``others``) and the groups of linked classes (``first``) are
    looked up where the tokens lie if few; else tokens move to the table of members.
    """
    if max(t.limit(BROADCAST_IDS + 1).count() for t in (others, first)) > BROADCAST_IDS:
        return some.select(F.col("doc_id").alias("id"), "f1", "f2", "n", "tokens").join(members, ["id", "f1", "f2", "n"])
    own = some.withColumn("row", signed_row()).join(F.broadcast(others), "row", "left_anti")
    label = F.broadcast(first.select(F.col("id").alias("doc_id"), "label"))
    return own.join(label, "doc_id", "left").select(F.coalesce("label", "doc_id").alias("g"), "n", "tokens")


def similarity_classes(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = token_counts(rows, k)
    signed = written(signatures(rows, k, percent, order), "signatures")
    some = signed.where("n > 0 AND doc_id IS NOT NULL")
    key = ["f1", "f2", "n"]
    classes = some.groupBy(*key).agg(
        F.min("doc_id").alias("id"), F.any_value("typical").alias("typical"),
        F.any_value("minhashes").alias("minhashes"),
    )
    classes = written(classes, "classes")
    known = rows.where("doc_id IS NOT NULL")
    # Rows that another one stands for. Rows of one number are one document: their classes hang together.
    others = some.join(classes.select(*key, "id"), key).where("doc_id <> id")
    others = written(others.select(F.col("doc_id").alias("a"), F.col("id").alias("b"), signed_row().alias("row")), "others")
    pivots = pivot_links(classes, known, k, percent)
    first = components(pivots)
    # Only linked classes have a label: few enough, they are looked up where the tokens lie.
    few = first.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    members = classes.join(F.broadcast(first) if few else first, "id", "left")
    members = written(members.select("id", *key, F.coalesce("label", "id").alias("g")), "members")
    tokens = grouped_tokens(some, others.select("row").distinct(), first, members)
    opened = open_groups(group_pairs(tokens, members, percent), members, known, k, percent)
    links = written(opened, "opened-links")
    final = components(pivots.unionByName(links).unionByName(others.select("a", "b")))
    mine = final.select(F.col("id").alias("doc_id"), "label")
    own = signed.select("doc_id", F.col("n").alias("n_shingles"))
    return own.join(mine, "doc_id", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("label", "doc_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """One row of those that repeat doc_id and text; rows without words stay as they are.

    Of repeated rows that differ in other columns the one with the least hash stays.
    """
    key = F.when(F.col("text").cast("string").rlike(r"\S"), row_key())
    keyed = docs.withColumn("__key", key)
    repeated = keyed.where("__key IS NOT NULL").groupBy("__key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("__key")
    repeated = written(repeated, "repeated")
    if repeated.isEmpty():
        return docs
    few = repeated.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    several = keyed.join(F.broadcast(repeated) if few else repeated, "__key", "left_semi")
    own = [F.col(f"`{c}`") for c in docs.columns]
    # Map columns cannot be hashed; the others order the rows.
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    # Two texts that only share a hash are two rows.
    same = ["__key", F.col("doc_id").alias("__id"), F.md5(F.col("text").cast("binary")).alias("__text")]
    one = several.groupBy(*same).agg(F.min_by(F.struct(*own), F.xxhash64(*plain)).alias("__row")).select("__row.*")
    return without(docs, repeated, key).unionByName(written(one, "first-rows"))


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The first row of each component of ``docs``; every row is linked by its own text.

    First is the smallest doc_id, null ids last, ties by a hash of the row. Rows that repeat
    doc_id and text are one; rows that share only doc_id, or have none, are told apart by text.
    """
    docs = without_repeats(docs)
    keyed = docs.select(row_key().alias("doc_id"), "text")
    classes = written(similarity_classes(keyed, k, percent), "similarity-classes")
    named = docs.select(row_key().alias("doc_id"), F.col("doc_id").cast("long").alias("_id"))
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("doc_id").alias("key"))
    first = classes.join(named, "doc_id").groupBy("component_id").agg(F.min(order)["key"].alias("doc_id"))
    rest = classes.join(first, "doc_id", "left_anti").select("doc_id")
    return without(docs, written(rest, "rest"), row_key())
