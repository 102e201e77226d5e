"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network in numpy.

Tokens are runs of letters, digits or signs, by hash in a fixed number of slots; markers stand before words in capitals
and after words that repeat the one before. Each slot has a sparse random index vector; a slot's word vector is the sum
of the index vectors found within two tokens of it anywhere in the corpus, brought to unit length. The corpus pass
leaves slots x dims numbers however large the corpus is; tasks add theirs up block by block. A document is the mean and
the spread of its tokens' word vectors. The network is trained on a bounded sample of labelled documents; a held-back
fifth of it sets the temperature that calibrates its probabilities.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS, DIMS, NONZERO, WINDOW = 1 << 14, 64, 4, 2
CAPITALS, AGAIN, BREAK = 0, 1, 2  # markers; BREAK parts documents and has no vector
BLOCK = 512
_TOKEN = re.compile(r"[^\W\d_]+|[\d_]+|[^\w\s]+")
_CAPS = 1 << 20


class _Slots(dict):
    """Token to slot, with a bit for words in capitals."""

    def __missing__(self, token: str) -> int:
        slot = 3 + zlib.crc32(token.lower().encode("utf-8", "surrogatepass")) % (SLOTS - 3)
        if len(token) > 1 and token.isupper():
            slot |= _CAPS
        if len(token) <= 40:
            if len(self) >= 500_000:
                self.clear()
            self[token] = slot
        return slot


_slots = _Slots()


def tokens(text: str | None) -> np.ndarray:
    """Slots of the tokens of a whole text, markers included."""
    found = _TOKEN.findall(text or "")
    raw = np.fromiter(map(_slots.__getitem__, found), np.int64, len(found))
    words = raw & (_CAPS - 1)
    after = np.flatnonzero(words[1:] == words[:-1]) + 2
    # a word is followed by signs more often than by itself: those two apart count as well
    apart = np.flatnonzero(words[2:] == words[:-2]) + 3
    before = np.flatnonzero(raw & _CAPS)
    return np.insert(words, np.r_[before, after, apart], np.r_[np.full(len(before), CAPITALS), np.full(len(after) + len(apart), AGAIN)])


def index_vectors(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero components of each slot's index vector."""
    rng = np.random.default_rng(seed)
    places, signs = rng.integers(0, DIMS, (SLOTS, NONZERO)), rng.choice([-1.0, 1.0], (SLOTS, NONZERO))
    signs[BREAK] = 0
    return places, signs


def _summed(rows: DataFrame, *keys: str) -> DataFrame:
    """Vectors (binary, float64) added up by block and keys, as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                now = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                part = np.frombuffer(batch.column(2)[i].as_py())
                if now == key:
                    total += part
                    continue
                if key is not None:
                    yield _row(*key, total)
                key, total = now, part.copy()
        if key is not None:
            yield _row(*key, total)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "block int, part int, sums binary")


def _row(block: int, part: int, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([sums.tobytes()], pa.binary())], names=["block", "part", "sums"])


def word_vectors(docs: DataFrame, seed: int = 11) -> np.ndarray:
    """slots x dims, from all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors(seed)
        sums, gap = np.zeros(SLOTS * DIMS), np.full(WINDOW, BREAK)

        def add(parts: list) -> None:
            ids = np.concatenate(parts)
            for k in range(1, WINDOW + 1):
                for a, b in ((ids[:-k], ids[k:]), (ids[k:], ids[:-k])):
                    sums[:] += np.bincount((a[:, None] * DIMS + places[b]).reshape(-1), signs[b].reshape(-1), SLOTS * DIMS)

        kept, size = [], 0
        for batch in batches:
            for text in batch.column(0):
                ids = tokens(text.as_py())
                for at in range(0, max(1, len(ids)), 1 << 18):  # neighbours across a cut count too
                    kept += [ids[max(0, at - WINDOW) : at + (1 << 18)], gap]
                    size += len(kept[-2])
                    if size > 1 << 17:
                        add(kept)
                        kept, size = [], 0
        if kept:
            add(kept)
        part = TaskContext.get().partitionId() % 16
        for block in range(SLOTS // BLOCK):
            yield _row(block, part, sums[block * BLOCK * DIMS : (block + 1) * BLOCK * DIMS])

    each = docs.select(F.col("text").cast("string").alias("text")).where("text is not null").mapInArrow(run, "block int, part int, sums binary")
    out = np.zeros((SLOTS // BLOCK, BLOCK * DIMS))
    for row in _summed(_summed(each, "block", "part").withColumn("part", F.lit(0)), "block", "part").collect():  # slots x dims numbers
        out[row["block"]] = np.frombuffer(row["sums"])
    vectors = out.reshape(SLOTS, DIMS)
    vectors[BREAK] = 0
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors of a text; zeros for no tokens."""
    if not len(ids):
        return np.zeros(2 * DIMS, np.float32)
    total, squares = np.zeros(DIMS), np.zeros(DIMS)
    for at in range(0, len(ids), 1 << 15):
        x = vectors[ids[at : at + (1 << 15)]]
        total += x.sum(axis=0)
        squares += np.einsum("ij,ij->j", x, x)
    mean = total / len(ids)
    return np.r_[mean, np.sqrt(np.maximum(squares / len(ids) - mean**2, 0))].astype(np.float32)


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]  # weights and biases of the two layers
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return (np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2)[:, 0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-3, seed: int = 3) -> Network:
    """Adam on cross-entropy over four fifths of the rows; the last fifth sets the temperature."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held, used = order[: len(x) // 5], order[len(x) // 5 :]
    net = Network(x.mean(axis=0), x.std(axis=0) + 1e-6, [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), (hidden, 1)), np.zeros(1)], 1.0)
    scaled = (x - net.mean) / net.scale
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.layers]
    step = 0
    for _ in range(epochs):
        rng.shuffle(used)
        for at in range(0, len(used), 128):
            rows = used[at : at + 128]
            w1, b1, w2, b2 = net.layers
            inner = np.tanh(scaled[rows] @ w1 + b1)
            wrong = (1 / (1 + np.exp(-np.clip(inner @ w2 + b2, -30, 30))) - y[rows, None]) / len(rows)
            back = wrong @ w2.T * (1 - inner**2)
            step += 1
            for i, g in enumerate((scaled[rows].T @ back + decay * w1, back.sum(axis=0), inner.T @ wrong + decay * w2, wrong.sum(axis=0))):
                m, v = moments[i]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                net.layers[i] = net.layers[i] - rate * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    if len(held):
        raw, truth = net.logits(x[held]), y[held]
        loss = lambda t: np.logaddexp(0, -np.where(truth > 0.5, raw, -raw) / t).mean()
        net.temperature = min(np.geomspace(0.25, 8, 61), key=loss)
    return net


@dataclass
class Model:
    vectors: np.ndarray
    network: Network | None  # None: nothing to learn from
    prior: float


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, seed: int = 3) -> Model:
    """documents (doc_id, text), labels (doc_id, quality). Word vectors come from all documents; the network from about
    max_rows labelled ones, drawn by hash of doc_id, which is what the driver gets. Null labels don't count; of several
    for a document the mean decides."""
    spark = docs.sparkSession
    vectors = word_vectors(docs, seed)
    marked = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("id_")).agg((F.avg("quality") >= 0.5).cast("double").alias("label_"))
    share = min(1.0, max_rows / max(1, marked.count()))
    drawn = marked.where(F.pmod(F.xxhash64(F.lit(seed), "id_"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sent = spark.sparkContext.broadcast(vectors)  # slots x dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [pooled(tokens(t.as_py()), sent.value).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["label", "x"])

    # about max_rows rows of two numbers: small whatever the corpus is
    chosen = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), F.col("id") == F.col("id_")).select("label_", "text")
    rows = sorted(chosen.mapInArrow(run, "label double, x binary").collect(), key=lambda r: (r["label"], r["x"]))
    y = np.array([r["label"] for r in rows])
    prior = float(y.mean()) if len(y) else 0.5
    if len(set(y)) < 2:
        return Model(vectors, None, prior)
    return Model(vectors, fit(np.frombuffer(b"".join(r["x"] for r in rows), np.float32).reshape(len(rows), -1).astype(np.float64), y), prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """documents (doc_id, text) as doc_id, score: the calibrated probability of label 1. Null and empty texts are scored
    as texts without tokens; without labels of both kinds to learn from, every score is their mean."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            x = np.array([pooled(tokens(t.as_py()), model.vectors) for t in batch.column(1)]).reshape(-1, 2 * DIMS)
            p = model.network.probability(x.astype(np.float64)) if model.network else np.full(len(x), model.prior)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
