"""Bounded samples of labelled documents, and a small optimiser, for the two classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def sample_labels(labels: DataFrame, label: str, max_labels: int, doc_id: str = "doc_id") -> dict[int, int]:
    """At most ``max_labels`` labels, picked by the least hash of the id; of repeated ids the least label counts."""
    rows = (labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("y")).dropna()
            .groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_labels).collect())
    return {r["id"]: r["y"] for r in rows}


def pick(batch: pa.RecordBatch, known: dict, doc_id: str = "doc_id") -> tuple[pa.RecordBatch, np.ndarray]:
    """The rows of a batch that have a label, and their labels."""
    ids = batch[doc_id].to_pylist()
    rows = [i for i, x in enumerate(ids) if x in known]
    return batch.take(pa.array(rows, pa.int64())), np.array([known[ids[i]] for i in rows], np.int64)


def descend(gradient, start: np.ndarray, steps: int = 400, rate: float = 0.1) -> np.ndarray:
    """Adam over a full-batch gradient."""
    x, m, v = start.astype(float).copy(), np.zeros(len(start)), np.zeros(len(start))
    for t in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return x


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
