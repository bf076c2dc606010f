"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts up to ``order`` bytes. A byte after a
context costs -log2 n/(T+D) bits if the language has seen it there (n: its count,
T: all counts, D: distinct bytes); else the escape costs -log2 D/(T+D) bits and the
next shorter context is asked; a context never seen costs nothing; below the empty
context every byte costs 8 bits. Counts are frozen after training, so the length of
a text is an exact sum over its bytes, in fixed-point bits, whatever the batches.

All languages share one sorted key table per context length, so a byte is looked up
once for all of them. Key tables are learnt from about ``train_rows`` rows per
language (chosen by a hash of doc_id) and hold at most ``max_contexts`` keys per
length, the most frequent ones; that bounds what is sent to the executors.

Defined results: null text, or one without a letter, is ``und`` with score 0; rows
are scored one by one, so repeated rows get equal results; no training rows at all
make every text ``und``; other columns pass through, and those with the names of the
result columns are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnspark.llm.common import Batches, as_array, bytes_of, column, filled, map_batches, record
from txnspark.sources.scratch import written

UNKNOWN = "und"
#: Parts of a bit in the fixed-point lengths.
UNIT = 1 << 16
#: Bytes scored at a time.
CHUNK = 1 << 18


def grams(raw: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` bytes that end at each byte, newest lowest; zeros before a text's start."""
    out = raw.astype(np.uint64)
    starts = starts[starts < len(raw)]
    for back in range(1, size):
        moved = np.zeros(len(raw), np.uint64)
        moved[back:] = raw[: len(raw) - back] if back < len(raw) else 0
        for step in range(min(back, len(raw))):
            moved[np.minimum(starts + step, len(raw) - 1)[starts + step < len(raw)]] = 0
        out |= moved << np.uint64(8 * back)
    return out


@dataclass
class Model:
    """Key tables per context length with costs and escapes for every language."""

    langs: list[str]
    keys: list[np.ndarray]  # keys[k]: sorted grams of k + 1 bytes
    cost: list[np.ndarray]  # cost[k][i, lang]: bits of the gram's last byte
    escape: list[np.ndarray]  # escape[k][i, lang]: of the context keys[k - 1][i]

    @property
    def order(self) -> int:
        return len(self.keys) - 1

    def bits(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Fixed-point bits of each byte in each language."""
        gram = grams(raw, starts, self.order + 1)
        out = np.zeros((len(raw), len(self.langs)), np.int64)
        rest = np.arange(len(raw))
        for k in range(self.order, -1, -1):
            key = gram[rest] & np.uint64((1 << 8 * (k + 1)) - 1)
            at = np.searchsorted(self.keys[k], key)
            at[at == len(self.keys[k])] = 0
            known = self.keys[k][at] == key
            out[rest[known]] += self.cost[k][at[known]]
            rest = rest[~known]
            if not len(rest):
                break
            if k:
                context = key[~known] >> np.uint64(8)
                at = np.searchsorted(self.keys[k - 1], context)
                at[at == len(self.keys[k - 1])] = 0
                seen = self.keys[k - 1][at] == context
                out[rest[seen]] += self.escape[k][at[seen]]
            else:
                out[rest] += self.escape[0][0] + 8 * UNIT
        return out


def fit(counts: list[tuple[int, str, int, int]]) -> Model:
    """``counts``: (k, lang, gram of k + 1 bytes, times seen)."""
    langs = sorted({c[1] for c in counts})
    at = {lang: i for i, lang in enumerate(langs)}
    order = max((c[0] for c in counts), default=0)
    keys, cost, escape = [], [], []
    for k in range(order + 1):
        own = [c for c in counts if c[0] == k]
        gram = np.array([c[2] for c in own], np.uint64)
        # Zero is the context before a text's first byte, which no count names.
        key = np.unique(np.append(gram, np.uint64(0)))
        where = np.searchsorted(key, gram)
        n = np.zeros((len(key), len(langs)))
        np.add.at(n, (where, [at[c[1]] for c in own]), [c[3] for c in own])
        parents = keys[k - 1] if k else np.zeros(1, np.uint64)
        context = key >> np.uint64(8) if k else np.zeros(len(key), np.uint64)
        up = np.searchsorted(parents, context)
        total, kinds = np.zeros((len(parents), len(langs))), np.zeros((len(parents), len(langs)))
        np.add.at(total, up, n)
        np.add.at(kinds, up, n > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            leave = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0)
            stay = -np.log2(n / (total + kinds)[up])
        leave = np.rint(leave * UNIT).astype(np.int64)
        if k:
            shorter = cost[k - 1][np.searchsorted(keys[k - 1], key & np.uint64((1 << 8 * k) - 1))]
        else:
            shorter = np.full((len(key), len(langs)), 8 * UNIT, np.int64)
        direct = np.rint(np.where(n > 0, stay, 0) * UNIT).astype(np.int64)
        keys.append(key)
        cost.append(np.where(n > 0, direct, leave[up] + shorter))
        escape.append(leave)
    return Model(langs, keys, cost, escape)


def train(
    labelled: DataFrame, order: int = 3, train_rows: int = 1000, max_contexts: int = 1_000_000
) -> Model:
    """Learn from rows of (doc_id, text, lang); rows without text or lang teach nothing."""
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select(
        F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"),
        F.pmod(F.xxhash64(F.lit("ppm"), "doc_id"), F.lit(1 << 30)).alias("_draw"),
    )
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([], [], [], [])
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1, train_rows / n) * (1 << 30)))])
    taken = rows.where(F.col("_draw") < F.element_at(share, F.col("lang"))).drop("_draw")
    schema = pa.schema([("k", pa.int32()), ("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def count(batches: Batches) -> Batches:
        for batch in batches:
            lang = column(batch, "lang").dictionary_encode()
            codes = lang.indices.to_numpy()
            raw, bounds = bytes_of(column(batch, "text"))
            whose = np.repeat(codes, np.diff(bounds))
            longest = grams(raw, bounds[:-1], order + 1)
            for k in range(order + 1):
                gram = longest & np.uint64((1 << 8 * (k + 1)) - 1)
                for code, name in enumerate(lang.dictionary.to_pylist()):
                    key, n = np.unique(gram[whose == code], return_counts=True)
                    yield record(schema, np.full(len(key), k, np.int32), [name] * len(key), key.astype(np.int64), n)

    counted = map_batches(taken, count, "k int, lang string, gram long, n long")
    counted = counted.groupBy("k", "lang", "gram").agg(F.sum("n").alias("n"))
    found = counted.groupBy("k", "gram").agg(F.sum("n").alias("_all"), F.collect_list(F.struct("lang", "n")).alias("each"))
    found = written(found, "grams")
    rows_of = []
    for k in range(order + 1):
        # Longer contexts than the bound allows are pruned by frequency, ties by key.
        level = found.where(F.col("k") == k).orderBy(F.desc("_all"), "gram").limit(max_contexts)
        frame = level.selectExpr("gram", "inline(each)").toArrow()
        gram, n = frame["gram"].to_numpy(), frame["n"].to_numpy()
        names = frame["lang"].to_pylist()
        rows_of += [(k, name, int(g), int(c)) for g, name, c in zip(gram, names, n, strict=True)]
    return fit(closed(rows_of))


def closed(counts: list[tuple[int, str, int, int]]) -> list[tuple[int, str, int, int]]:
    """Drop grams whose context or shorter form was pruned, so that every chain ends in the tables."""
    kept: list[tuple[int, str, int, int]] = []
    shorter: set[int] = set()
    for k in range(max((c[0] for c in counts), default=-1) + 1):
        level = [
            c for c in counts
            if c[0] == k and (not k or (c[2] & ((1 << 8 * k) - 1) in shorter and c[2] >> 8 in shorter))
        ]
        shorter = {0, *(c[2] for c in level)}
        kept += level
    return kept


def identify(docs: DataFrame, model: Model, sharpness: float = 16.0) -> DataFrame:
    """``docs`` with lang_pred, score and bits_per_byte (of the best language).

    ``score`` is the softmax of minus bits per byte times ``sharpness``: how far the
    best language is ahead, on a scale that does not depend on the text's length.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # at most order * max_contexts keys
    docs = docs.drop("lang_pred", "score", "bits_per_byte")
    names = [f.name for f in docs.schema]
    added = {"lang_pred": pa.string(), "score": pa.float64(), "bits_per_byte": pa.float64()}
    own = "lang_pred string, score double, bits_per_byte double"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), own])

    def score(batches: Batches) -> Batches:
        m = shared.value
        for batch in batches:
            text = column(batch, "text")
            raw, bounds = bytes_of(text)
            total = np.zeros((len(text), max(1, len(m.langs))), np.int64)
            for at in range(0, len(raw) if m.langs else 0, CHUNK):
                lead = min(at, m.order)
                part = raw[at - lead : at + CHUNK]
                first = np.searchsorted(bounds, at, "right") - 1
                last = np.searchsorted(bounds, at + len(part) - lead, "left")
                starts = bounds[first:last] - (at - lead)
                bits = m.bits(part, starts[starts >= 0])[lead:]
                edges = np.maximum(bounds[first:last] - at, 0)
                full = np.diff(np.append(edges, len(bits))) > 0
                total[np.arange(first, last)[full]] += np.add.reduceat(bits, edges[full], axis=0)
            letters = pc.match_substring_regex(filled(text), r"\p{L}").to_numpy(zero_copy_only=False)
            known = letters & bool(m.langs)
            rate = total / UNIT / np.maximum(np.diff(bounds), 1)[:, None]
            best = rate.argmin(axis=1)
            low = rate[np.arange(len(rate)), best]
            p = 1 / np.exp((low[:, None] - rate) * sharpness).sum(axis=1)
            langs = pa.array([*m.langs, UNKNOWN])
            pred = langs.take(pa.array(np.where(known, best, len(m.langs))))
            rest = [column(batch, n) for n in names]
            made = [pred, as_array(np.where(known, p, 0.0)), as_array(np.where(known, low, 0.0))]
            yield pa.RecordBatch.from_arrays([*rest, *made], names=[*names, *added])

    return map_batches(docs, score, schema)


def reject(identified: DataFrame, max_bits: float = 6.0) -> F.Column:
    """Texts without a letter, or that no learnt language codes better than noise."""
    return (F.col("lang_pred") == UNKNOWN) | (F.col("bits_per_byte") > max_bits)


def keep(docs: DataFrame) -> DataFrame:
    """``docs`` that are not rejected, with the predicted language in ``lang``.

    Learns from the languages that the rows state. If none does, there is nothing to
    tell languages apart by; texts without a letter go all the same, and the other rows
    stay as they are.
    """
    model = train(docs.select("doc_id", "text", "lang"))
    if not model.langs:
        return docs.where(F.col("text").cast("string").rlike(r"\p{L}"))
    rows = docs.withColumnsRenamed({c: f"__in_{c}" for c in docs.columns if c != "text"})
    found = identify(rows, model)
    found = found.where(~reject(found))
    own = [F.col("lang_pred" if c == "lang" else "text" if c == "text" else f"`__in_{c}`").alias(c) for c in docs.columns]
    return found.select(*own)
