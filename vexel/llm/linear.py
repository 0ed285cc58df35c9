"""Logistic regression on bounded samples, and the choice of such samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-4, steps: int = 300, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam. x: standardised rows. With one class only, the bias says so."""
    w, b = np.zeros(x.shape[1]), 0.0
    weight = np.ones(len(y)) if weight is None else weight
    weight = weight / max(weight.sum(), 1e-12)
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        e = (sigmoid(x @ w.astype(x.dtype) + b) - y) * weight
        g = np.append(e.astype(x.dtype) @ x + l2 * w, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def fold(column: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 5."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(5))


def sampled(labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, label int): for each of the labels 0 and 1 the `per_class` ids that come first by a hash; contradictory
    labels of an id count as 1. Bounded, so it may be broadcast."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    own = [known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(per_class) for c in (0, 1)]
    return own[0].unionByName(own[1])
