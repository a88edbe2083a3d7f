"""What the classifiers share: which rows may teach, the bounded sample of them, and the columns of a scored table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: str = "doc_id") -> Column:
    """True for ids whose CRC-32, as text, is divisible by FOLDS; these labels are never learnt from. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """text and label of the rows of at most ``most`` labels, the first in the order of a hash of their ids.

    Only rows outside the held-out fold, with an id and a label, are taken; the chosen ids are at most ``most`` rows, so
    they are broadcast. An id that documents share gives a row for each; who collects the rows bounds them again."""
    chosen = labels.filter(~held_out(doc_id) & F.col(doc_id).isNotNull() & F.col(label).isNotNull()).select(F.col(doc_id).alias("labelled"), F.col(label).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("labelled"), "labelled", "label").limit(most)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled")).select("doc_id", "text", "label")


def adam(shape: tuple[int, ...], rate: float, decay: float = 0.0):
    """A function that moves parameters in place by their gradient."""
    m, v, t = np.zeros(shape), np.zeros(shape), 0

    def step(x: np.ndarray, grad: np.ndarray) -> None:
        nonlocal t
        t += 1
        m[...] = 0.9 * m + 0.1 * grad
        v[...] = 0.999 * v + 0.001 * grad * grad
        x -= rate * (m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) + decay * x)

    return step


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))
