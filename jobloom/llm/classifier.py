"""Quality classifier on random-indexing word vectors.

Words are hashed into a fixed number of buckets.  Each bucket has a sparse
index vector of a few +1 and -1 entries; the context vector of a bucket is the
sum of the index vectors of the words that stand beside it, over the whole
corpus.  Each task sums its own rows, and sums of a bounded number of tasks
are added at a time.  A document pools the vectors of its words (mean and
spread), and a two-layer network gives the probability, whose temperature is
set on rows that the network did not learn from.

The network learns from at most ``sample_rows`` labelled rows, chosen by a
hash of their id; the vectors come from all documents.

Edge cases: a null or empty text pools to zeros and is scored like any other;
labels that are null or whose document is missing are left out; with one
class or none to learn from, the score is that class's share (0.5 for none);
equal texts get equal scores; an empty table gives an empty result.
"""

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from jobloom.llm.common import small_batches
from jobloom.runtime import settle

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
BUCKETS, DIMS, ENTRIES, REACH = 1 << 14, 64, 4, 2
ROWS_PER_BLOCK = 256
FAN_IN = 64
CHUNK = 1 << 16
FEATURES = 2 * (DIMS + 2) + 1


def buckets(text: str) -> np.ndarray:
    words = WORD.findall(text.encode())
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % BUCKETS


def index_vectors(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries of every bucket's index vector."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, DIMS, (BUCKETS, ENTRIES)), rng.choice([-1.0, 1.0], (BUCKETS, ENTRIES))


def add_contexts(total: np.ndarray, ids: np.ndarray, text: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    """Add index vectors of neighbours, and word counts, to ``total`` (buckets x dims + 1)."""
    width = DIMS + 1
    for step in range(1, REACH + 1):
        beside = np.flatnonzero(text[step:] == text[:-step])
        for a, b in ((ids[beside], ids[beside + step]), (ids[beside + step], ids[beside])):
            cell = (a[:, None] * width + places[b]).ravel()
            total += np.bincount(cell, signs[b].ravel(), BUCKETS * width)
    total += np.bincount(ids * width + DIMS, minlength=BUCKETS * width)


def _partials(batches):
    places, signs = index_vectors()
    width = DIMS + 1
    total = np.zeros(BUCKETS * width)
    held, number = [], 0

    def flush():
        nonlocal held
        if held:
            ids = np.concatenate([x for _, x in held])
            text = np.repeat([k for k, _ in held], [len(x) for _, x in held])
            add_contexts(total, ids, text, places, signs)
        held = []

    size = 0
    for batch in batches:
        for t in batch.iloc[:, 0].fillna(""):
            ids = buckets(t)
            for at in range(0, len(ids), 4 * CHUNK):  # pieces overlap by nothing: a few neighbours of millions part
                held.append((number, ids[at:at + 4 * CHUNK]))
                size += len(held[-1][1])
                if size >= 4 * CHUNK:
                    flush()
                    size = 0
            number += 1
    flush()
    part = TaskContext.get().partitionId()
    table = total.reshape(-1, ROWS_PER_BLOCK * width)
    used = np.flatnonzero(table.any(axis=1))
    yield pd.DataFrame({"block": used, "part": part, "sums": [zlib.compress(table[k].astype("<f8").tobytes(), 1) for k in used]})


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(zlib.decompress(s), "<f8") for s in pdf["sums"])
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "part": [pdf["part"].iloc[0] // FAN_IN], "sums": [zlib.compress(total.tobytes(), 1)]})


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Context vectors of all buckets over all documents, of unit length, with log count and share beside them.

    The result has a fixed size.  Sums are whole numbers, so their order does
    not matter.
    """
    small_batches(docs.sparkSession)
    schema = "block long, part long, sums binary"
    sums = docs.select(F.col(text)).mapInPandas(_partials, schema)
    for _ in range(max(1, math.ceil(math.log(max(2, docs.rdd.getNumPartitions()), FAN_IN)))):
        sums = sums.groupBy("block", F.floor(F.col("part") / FAN_IN)).applyInPandas(_add, schema)
    total = np.zeros((BUCKETS // ROWS_PER_BLOCK, ROWS_PER_BLOCK * (DIMS + 1)))
    for row in settle(sums, "vectors").collect():  # BUCKETS / ROWS_PER_BLOCK rows
        total[row["block"]] += np.frombuffer(zlib.decompress(row["sums"]), "<f8")
    total = total.reshape(BUCKETS, DIMS + 1)
    vectors, count = total[:, :DIMS], total[:, DIMS]
    vectors = vectors - np.outer(count, vectors.sum(axis=0) / max(1.0, count.sum()))
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)
    return np.c_[vectors, np.log1p(count) / 10, np.divide(length[:, 0], np.sqrt(count), out=np.zeros(BUCKETS), where=count > 0) / 10].astype(np.float32)


def pool(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the vectors of each text's words, and its log length."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    half = DIMS + 2
    for k, t in enumerate(texts):
        ids = buckets(t)
        n = len(ids)
        if not n:
            continue
        once, times = np.unique(ids, return_counts=True)
        mean, square = np.zeros(half), np.zeros(half)
        for at in range(0, len(once), CHUNK):
            v, w = vectors[once[at:at + CHUNK]], times[at:at + CHUNK] / n
            mean += w @ v
            square += w @ (v * v)
        out[k, :half] = mean
        out[k, half:2 * half] = np.sqrt(np.maximum(0, square - mean * mean))
        out[k, -1] = math.log1p(n) / 10
    return out


@dataclass
class Network:
    """Two layers over standardised inputs; probability at ``temperature``."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum(0, (x - self.centre) / self.scale @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def constant(p: float) -> Network:
    z = np.zeros(FEATURES)
    return Network(z, z + 1, np.zeros((FEATURES, 1)), np.zeros(1), np.zeros(1), math.log((p + 1e-9) / (1 - p + 1e-9)), 1.0)


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, rate: float = 0.003, decay: float = 1e-4, seed: int = 5) -> Network:
    """Adam on the log loss; every fifth row is kept out to set the temperature."""
    if len(y) < 10 or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    x = x.astype(np.float64)
    aside = np.arange(len(y)) % 5 == 4
    if y[~aside].min() == y[~aside].max():
        aside[:] = False
    centre, scale = x[~aside].mean(axis=0), x[~aside].std(axis=0) + 1e-3
    own, goal = (x[~aside] - centre) / scale, y[~aside].astype(np.float64)
    p = [rng.normal(0, math.sqrt(2 / FEATURES), (FEATURES, hidden)), np.zeros(hidden), rng.normal(0, math.sqrt(1 / hidden), hidden), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(goal))
        for at in range(0, len(order), 128):
            rows = order[at:at + 128]
            a, z = own[rows], own[rows] @ p[0] + p[1]
            h = np.maximum(0, z)
            out = 1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -30, 30)))
            d = (out - goal[rows]) / len(rows)
            dh = np.outer(d, p[2]) * (z > 0)
            grads = [a.T @ dh + decay * p[0], dh.sum(axis=0), h.T @ d + decay * p[2], np.array([d.sum()])]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] -= rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
    net = Network(centre, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    check = aside if aside.any() else ~aside
    logits, truth = net.logits(x[check]), y[check]
    loss = lambda k: np.logaddexp(0, -logits / k * (2 * truth - 1)).mean()
    net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, held_out_fold: int = 1) -> tuple[np.ndarray, Network]:
    """Vectors from ``docs(doc_id, text)``, network from ``labels(doc_id, quality)`` outside the held-out fold."""
    vectors = word_vectors(docs)
    spark = docs.sparkSession
    known = labels.filter(F.col("quality").isNotNull() & (fold(F.col("doc_id")) != held_out_fold)).select("doc_id", "quality")
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    shared = spark.sparkContext.broadcast(vectors)

    @F.pandas_udf("binary")
    def pooled(texts: pd.Series) -> pd.Series:
        return pd.Series([row.tobytes() for row in pool(texts.fillna("").tolist(), shared.value)], dtype=object)

    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "quality", F.xxhash64("doc_id").alias("h"), pooled("text").alias("x")).toPandas()  # at most sample_rows
    rows = rows.sort_values(["h", "doc_id", "quality", "x"])
    x = np.array([np.frombuffer(b, np.float32) for b in rows["x"]], np.float32).reshape(len(rows), FEATURES)
    return vectors, train(x, rows["quality"].to_numpy(int))


def scored(docs: DataFrame, vectors: np.ndarray, network: Network, text: str = "text", name: str = "score") -> DataFrame:
    """Add the calibrated probability that a text is of good quality."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        vectors, network = shared.value
        return pd.Series(network.probability(pool(texts.fillna("").tolist(), vectors)), dtype=float)

    return docs.withColumn(name, run(F.col(text)))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, **how) -> DataFrame:
    """The rows scored at ``least`` or more, with all their columns."""
    model = fit(docs.select("doc_id", "text"), labels, **how)
    return scored(docs, *model, name="_score").filter(F.col("_score") >= least).drop("_score")
