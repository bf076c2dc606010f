"""Quality classifier: random-indexing word vectors, pooled per document, a two-layer network.

Random indexing: every word bucket has a fixed sparse ternary index vector; a word's
vector is the sum of the index vectors of the words around it, over all documents.
Words are hashed into ``buckets`` buckets, so the matrix has a fixed size however
large the vocabulary is. A document is pooled into the mean and the spread of its
words' vectors and a few logarithms of its counts. A network with one hidden layer
is trained on a bounded sample of labelled rows (``fit_rows``), by numpy on the
driver; a temperature fitted on rows that the network did not see calibrates its
probabilities.

Defined results: null and empty texts pool to zeros and get the score of that;
repeated rows get equal scores; if no labelled row is left to learn from, every
score is 0.5; other columns are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnspark.llm.common import Batches, column, flat_words, lists_of, map_batches, record
from txnspark.sources.scratch import written

BUCKETS, WIDTH, NONZERO, WINDOW = 1 << 13, 32, 4, 2
#: Buckets in one summed block of the matrix.
BLOCK = 1 << 10
EXTRA = 6


def index_vectors(buckets: int = BUCKETS, width: int = WIDTH, nonzero: int = NONZERO) -> np.ndarray:
    """Sparse ternary vectors that depend on the bucket alone: (buckets, nonzero) signed places."""
    rng = np.random.default_rng(20240229)
    place = np.argsort(rng.random((buckets, width)), axis=1)[:, :nonzero]
    return (place * 2 + (rng.random((buckets, nonzero)) < 0.5)).astype(np.int64)


def bucket_of(words: pa.DictionaryArray, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of each word: crc32 of its lower-cased letters, signs kept."""
    names = pc.utf8_lower(words.dictionary).to_pylist()
    hashed = np.fromiter((zlib.crc32(w.encode()) % buckets for w in names), np.int64, len(names))
    return hashed[words.indices.to_numpy()]


def context_sums(docs: DataFrame) -> np.ndarray:
    """Word vectors of all buckets: sums over the neighbours within WINDOW words, all documents.

    Each task adds up its own matrix and emits it in blocks; tasks that sum a block
    hold one block, however many partial sums arrive.
    """
    schema = pa.schema([("block", pa.int32()), ("sums", pa.binary())])
    blocks = BUCKETS // BLOCK

    def partial(batches: Batches) -> Batches:
        places = index_vectors()
        sums = np.zeros(BUCKETS * WIDTH, np.int64)
        for batch in batches:
            words, sizes = flat_words(column(batch, "text"))
            bucket = bucket_of(words)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            for step in range(1, WINDOW + 1):
                same = doc[step:] == doc[:-step]
                left, right = bucket[:-step][same], bucket[step:][same]
                for a, b in ((left, right), (right, left)):
                    for j in range(NONZERO):
                        signed = places[b, j]
                        flat = a * WIDTH + (signed >> 1)
                        sums += np.bincount(flat, 1 - 2 * (signed & 1), len(sums)).astype(np.int64)
        for i in range(blocks):
            part = sums[i * BLOCK * WIDTH : (i + 1) * BLOCK * WIDTH]
            if part.any():
                yield record(schema, [i], [zlib.compress(part.astype("<i8").tobytes(), 1)])

    def total(batches: Batches) -> Batches:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, data in zip(column(batch, "block").to_pylist(), column(batch, "sums").to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(data), "<i8")
                sums[i] = sums[i] + part if i in sums else part
        for i, part in sums.items():
            yield record(schema, [i], [part.tobytes()])

    shape = "block int, sums binary"
    parts = map_batches(docs.select(F.col("text").cast("string").alias("text")), partial, shape)
    summed = map_batches(parts.repartition(blocks, "block"), total, shape)
    out = np.zeros((blocks, BLOCK * WIDTH), np.int64)
    for row in summed.collect():  # BUCKETS * WIDTH numbers in all
        out[row["block"]] = np.frombuffer(row["sums"], "<i8")
    return out.reshape(BUCKETS, WIDTH)


def vectors(sums: np.ndarray) -> np.ndarray:
    """Unit word vectors; a bucket without neighbours is zero."""
    damped = np.sign(sums) * np.sqrt(np.abs(sums))
    norm = np.sqrt((damped * damped).sum(axis=1, keepdims=True))
    return (damped / np.maximum(norm, 1e-9)).astype(np.float32)


def pooled(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """doc_id with ``features``: mean and spread of its word vectors, and count logarithms."""
    shared = docs.sparkSession.sparkContext.broadcast(table)  # BUCKETS * WIDTH floats
    schema = pa.schema([("doc_id", pa.int64()), ("features", pa.list_(pa.float32()))])

    def pool(batches: Batches) -> Batches:
        vec = shared.value
        for batch in batches:
            words, sizes = flat_words(column(batch, "text"))
            bucket = bucket_of(words)
            letters = pc.count_substring_regex(words.dictionary, r"\p{L}").to_numpy()
            upper = pc.count_substring_regex(words.dictionary, r"\p{Lu}").to_numpy()
            length = pc.utf8_length(words.dictionary).to_numpy()
            word_facts = np.stack([length, length - letters, upper, letters == 0], axis=1)
            at = words.indices.to_numpy()
            ends = np.cumsum(sizes)
            out = np.zeros((len(sizes), 2 * WIDTH + EXTRA), np.float32)
            for i in np.flatnonzero(sizes):
                own = slice(ends[i] - sizes[i], ends[i])
                counts = np.bincount(bucket[own], minlength=0)
                kinds = np.flatnonzero(counts)
                weight = counts[kinds][:, None] / sizes[i]
                v = vec[kinds].astype(np.float64)
                mean = (v * weight).sum(axis=0)
                spread = np.sqrt(np.maximum((v * v * weight).sum(axis=0) - mean * mean, 0))
                facts = word_facts[at[own]].sum(axis=0) / sizes[i]
                out[i] = [*mean, *spread, np.log1p(sizes[i]), len(kinds) / sizes[i], *facts]
            flat = pa.array(out.ravel())
            yield record(schema, column(batch, "doc_id"), lists_of(flat, np.full(len(sizes), out.shape[1])))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, pool, "doc_id long, features array<float>")


@dataclass
class Network:
    """Standardised features, one hidden layer, a temperature on the logit."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit_network(
    x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-4
) -> Network:
    """Adam on the mean log loss; every fifth row is set aside for the temperature."""
    rng = np.random.default_rng(7)
    aside = np.arange(len(y)) % 5 == 4
    fx, fy = x[~aside], y[~aside]
    net = Network(
        fx.mean(axis=0), fx.std(axis=0) + 1e-6,
        rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden),
        rng.normal(0, np.sqrt(1 / hidden), hidden), 0.0,
    )
    z = (fx - net.mean) / net.scale
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(fy))
        for at in range(0, len(order), 256):
            rows = order[at : at + 256]
            xb, yb = z[rows], fy[rows]
            pre = xb @ params[0] + params[1]
            h = np.maximum(pre, 0)
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30)))
            g = (p - yb) / len(rows)
            gh = np.outer(g, params[2]) * (pre > 0)
            grads = [xb.T @ gh + decay * params[0], gh.sum(axis=0), h.T @ g + decay * params[2], g.sum(keepdims=True)]
            t += 1
            for i, grad in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * grad
                second[i] = 0.999 * second[i] + 0.001 * grad * grad
                step = first[i] / (1 - 0.9**t) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
                params[i] = params[i] - rate * step
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    if aside.any():
        logit, held = net.logits(x[aside]), y[aside]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 81))
        loss = [np.mean(np.logaddexp(0, logit / t) - held * logit / t) for t in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def fit(features: DataFrame, labels: DataFrame, fit_rows: int = 20_000) -> Network | None:
    """Train on about ``fit_rows`` labelled rows, chosen by a hash of doc_id, in its order."""
    own = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL")
    own = own.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    n = own.count()
    draw = F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 30))
    own = own.where(draw < int(min(1, fit_rows / max(n, 1)) * (1 << 30)))
    rows = features.join(own, "doc_id").orderBy(F.xxhash64(F.lit("order"), "doc_id"), "doc_id", "features").toArrow()
    if not rows.num_rows:
        return None
    x = np.array(rows["features"].combine_chunks().flatten().to_numpy(), np.float64).reshape(rows.num_rows, -1)
    return fit_network(x, rows["quality"].to_numpy().astype(np.float64))


def score(features: DataFrame, net: Network | None) -> DataFrame:
    """doc_id and score, the calibrated probability of label 1."""
    if net is None:
        return features.select("doc_id", F.lit(0.5).alias("score"))
    shared = features.sparkSession.sparkContext.broadcast(net)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def apply(batches: Batches) -> Batches:
        for batch in batches:
            flat = column(batch, "features").flatten().to_numpy().astype(np.float64)
            yield record(schema, column(batch, "doc_id"), shared.value.probability(flat.reshape(batch.num_rows, -1)))

    return map_batches(features, apply, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000) -> DataFrame:
    """(doc_id, score) of every document, learnt from ``labels`` (doc_id, quality)."""
    features = written(pooled(docs, vectors(context_sums(docs))), "pooled")
    return score(features, fit(features, labels, fit_rows))
