"""Quality: random-indexing word vectors pooled per document, then a two-layer numpy network with calibrated probabilities.

Each token has a sparse random index vector, given by its hash; a token's word vector is the sum of the index vectors of
its neighbours over the whole corpus. Tokens are hashed into BUCKETS, so the vectors are a table of fixed size, summed in
blocks. A document is pooled over all its tokens: mean and spread of their vectors, and how alike neighbours are. The
network's temperature is fitted on labelled rows that its weights didn't see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatefold.llm.labelled import adam, sample, sigmoid
from gatefold.llm.toxicity import scored
from gatefold.llm.words import Words, pieces

#: Labelled documents that the network is fitted on, at most.
MOST_LABELLED = 20_000
BUCKETS, DIM, BLOCK = 1 << 15, 32, 512
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 48, 40, 128, 0.003, 1e-4, 5
CUT = 0.3


def _index(h: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Two (position, sign) pairs of each token's index vector, from bits that the bucket doesn't use."""
    out = []
    for k in (20, 32):
        x = h >> np.uint64(k)
        out.append(((x & np.uint64(DIM - 1)).astype(np.int64), np.where(x & np.uint64(DIM), 1.0, -1.0)))
    return out


def _bucket(w: Words) -> np.ndarray:
    return (w.hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


def _joins(w: Words) -> np.ndarray:
    """Whether each token and the next are of one text."""
    same = np.ones(max(0, len(w) - 1), bool)
    at = w.bounds[1:-1] - 1
    same[at[(at >= 0) & (at < len(same))]] = False
    return same


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """BUCKETS x DIM unit vectors from all documents. Tasks send blocks of sums; those of a block are added as they arrive."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS * DIM, np.int64)
        for batch in batches:
            for _, texts in pieces(batch, "text", 1 << 20):
                w = Words(texts, symbols=True)
                same = _joins(w)
                bucket = _bucket(w)
                left, right = bucket[:-1][same], bucket[1:][same]
                for place, sign in _index(w.hashes):
                    for own, at, s in ((left, place[1:][same], sign[1:][same]), (right, place[:-1][same], sign[:-1][same])):
                        total += np.bincount(own * DIM + at, s, BUCKETS * DIM).astype(np.int64)
        blocks = total.reshape(-1, BLOCK * DIM)
        some = np.flatnonzero(blocks.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([blocks[k].tobytes() for k in some], pa.binary())], ["block", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(sums, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["block", "sums"])

    parts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "block int, sums binary")
    table = np.zeros((BUCKETS // BLOCK, BLOCK * DIM))
    for row in parts.repartition(BUCKETS // BLOCK, "block").mapInArrow(add, "block int, sums binary").toArrow().to_pylist():
        table[row["block"]] = np.frombuffer(row["sums"], np.int64)
    table = table.reshape(BUCKETS, DIM)
    return (table / np.maximum(1e-9, np.linalg.norm(table, axis=1, keepdims=True))).astype(np.float32)


def pooled(vectors: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """For each text: mean and spread of its tokens' vectors, mean likeness of neighbours; zeros without tokens."""
    w = Words(texts, symbols=True)
    out = np.zeros((len(texts), 2 * DIM + 1), np.float32)
    n = np.diff(w.bounds)
    filled = np.flatnonzero(n)
    if not len(filled):
        return out
    own, starts = vectors[_bucket(w)], w.bounds[:-1][filled]
    size = n[filled, None]
    mean = np.add.reduceat(own, starts, dtype=np.float64) / size
    out[filled, :DIM] = mean
    out[filled, DIM : 2 * DIM] = np.sqrt(np.maximum(0, np.add.reduceat(own * own, starts, dtype=np.float64) / size - mean * mean))
    alike = np.zeros(len(w))
    alike[:-1] = np.einsum("ij,ij->i", own[:-1], own[1:]) * _joins(w)
    out[filled, 2 * DIM] = np.add.reduceat(alike, starts) / np.maximum(1, size[:, 0] - 1)
    return out


@dataclass
class Model:
    vectors: np.ndarray
    layers: list[np.ndarray]
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        mean, spread, w1, b1, w2, b2 = self.layers
        return (np.maximum(0, (x - mean) / spread @ w1 + b1) @ w2 + b2)[:, 0]

    def score(self, texts: list[bytes]) -> np.ndarray:
        return sigmoid(self.logits(pooled(self.vectors, texts)) / self.temperature)


def train(vectors: np.ndarray, x: np.ndarray, y: np.ndarray) -> Model:
    """Four fifths fit the weights, the rest the temperature. Without both labels the score is their rate."""
    d = x.shape[1]
    mean, spread = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(d), np.ones(d))
    rate = (float(y.sum()) + 0.5) / (len(y) + 1)
    rng = np.random.default_rng(SEED)
    w1, b1 = rng.normal(0, (2 / d) ** 0.5, (d, HIDDEN)), np.zeros(HIDDEN)
    w2, b2 = np.zeros((HIDDEN, 1)), np.array([np.log(rate / (1 - rate))])
    model = Model(vectors, [mean, spread, w1, b1, w2, b2], 1.0)
    if not len(y) or y.min() == y.max():
        return model
    order = rng.permutation(len(y))
    taught, kept = order[len(y) // 5 :], order[: len(y) // 5]
    z = (x - mean) / spread
    moves = [adam(p.shape, RATE, DECAY if p.ndim > 1 else 0) for p in (w1, b1, w2, b2)]
    for _ in range(EPOCHS):
        taught = rng.permutation(taught)
        for i in range(0, len(taught), BATCH):
            k = taught[i : i + BATCH]
            h = np.maximum(0, z[k] @ w1 + b1)
            error = (sigmoid((h @ w2 + b2)[:, 0]) - y[k])[:, None] / len(k)
            back = error @ w2.T * (h > 0)
            for p, g, move in zip((w1, b1, w2, b2), (z[k].T @ back, back.sum(0), h.T @ error, error.sum(0)), moves, strict=True):
                move(p, g)
    if len(kept):
        logit = model.logits(x[kept])
        losses = {t: float(np.logaddexp(0, np.where(y[kept] == 1, -logit, logit) / t).mean()) for t in np.geomspace(0.25, 8, 41)}
        model.temperature = float(min(losses, key=losses.get))
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_LABELLED) -> Model:
    """Word vectors from all documents; the network from at most ``most`` labelled ones, of which only pooled vectors are collected."""
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, "text", 1 << 20):
                x = pooled(shared.value, texts)
                yield pa.RecordBatch.from_arrays([part.column(2), pa.array([r.tobytes() for r in x], pa.binary())], ["label", "x"])

    table = sample(docs, labels, label, most).mapInArrow(pool, "label int, x binary").toArrow()
    rows = sorted(zip(table.column("x").to_pylist(), table.column("label").to_pylist(), strict=True))
    x = np.array([np.frombuffer(r, np.float32) for r, _ in rows], np.float64).reshape(-1, 2 * DIM + 1)
    return train(vectors, x, np.array([y for _, y in rows], np.int64))


def classified(docs: DataFrame, labels: DataFrame, **names: str) -> DataFrame:
    """doc_id, held_out, score, predicted, as for toxicity, with this model and its cut."""
    return scored(docs, fit(docs, labels), cut=CUT, **names)
