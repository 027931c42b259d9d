"""Quality by Bradley-Terry ranking: a document's score is learnt from preferences between pairs of documents.

Each preference says that a document labelled 1 beats one labelled 0. The chance of that is the logistic function of the difference of
their scores, and scores are linear in features of the text: shares of upper case, symbols, digits, repeated and distinct words
and the like, each also as its square root. A quantile of the fitted scores that parts the labels with the fewest errors is the threshold;
the reported score is the logistic function of the distance to it, and 0.3 exactly there.

Fitted on at most ``max_labels`` labelled documents and ``max_pairs`` preferences; every whole text is scored.

Defined results: null and empty texts have all features zero and are scored like any other; rows without label or id take no part in
fitting; without labels of both kinds all documents score the share of label 1 (0.5 without any). Every row is scored by itself and
carries its other columns along.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import find_words, pieces, slices, text_bytes
from .labelled import descend, pick, sample_labels, sigmoid

THRESHOLD = 0.3


class QualityModel(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    constant: float | None  # the score of all documents where nothing could be learnt


def _bytes(which):
    table = np.zeros(256, bool)
    table[list(which)] = True
    return table


SETS = [_bytes(range(65, 91)), _bytes(range(48, 58)), _bytes(range(128, 256)), _bytes(b" "), _bytes(b"\n"), _bytes(b"."), _bytes(b","),
        _bytes(b"!?"), _bytes(b"|"), _bytes(b"#$%&*@^~=+<>/\\_"), _bytes(b"\"'()[]{}-:;"), _bytes([*range(0, 9), *range(14, 32), 127])]


def text_features(texts) -> np.ndarray:
    """A row of numbers for each text."""
    data, at = text_bytes(texts)
    size = np.diff(at)
    words = find_words(texts)
    n_words = words.count
    shares = np.zeros((len(size), len(SETS) + 1))
    for i, j in pieces(at):
        own, edge = data[at[i]:at[j]], at[i:j + 1] - at[i]
        for k, table in enumerate(SETS):
            total = np.concatenate([[0], np.cumsum(table[own])])
            shares[i:j, k] = np.diff(total[edge])
        # upper-case letters of two bytes, U+00C0 to U+00DE
        wide = np.zeros(len(own), bool)
        wide[1:] = (own[:-1] == 0xC3) & (own[1:] >= 0x80) & (own[1:] <= 0x9E)
        total = np.concatenate([[0], np.cumsum(wide)])
        shares[i:j, -1] = np.diff(total[edge])
    shares[:, 0] += shares[:, -1]
    shares = shares[:, :-1] / np.maximum(size, 1)[:, None]
    doc, per = words.doc, np.maximum(n_words, 1)
    again = np.zeros(len(doc), bool)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((words.hash, doc))
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (words.hash[order][1:] != words.hash[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    repeated = np.bincount(doc, again, len(size)) / per
    distinct = np.bincount(doc[order], fresh, len(size)) / per
    length = np.minimum(size / per, 40) / 40
    x = np.column_stack([shares, repeated, 1 - distinct, length, np.log1p(n_words) / 15])
    return np.concatenate([x, np.sqrt(np.maximum(x, 0))], axis=1)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", doc_id: str = "doc_id",
                max_labels: int = 20_000, max_pairs: int = 60_000, seed: int = 7) -> QualityModel:
    known = sample_labels(labels, label, max_labels)
    share = sum(known.values()) / len(known) if known else 0.5
    constant = QualityModel(np.zeros(0), np.zeros(0), np.zeros(0), 0.0, share)
    if not 0 < share < 1:
        return constant
    shared = docs.sparkSession.sparkContext.broadcast(known)  # at most max_labels ids
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def features(batches):
        for whole in batches:
            for batch in slices(whole):
                batch, y = pick(batch, shared.value)
                yield pa.RecordBatch.from_pydict({"id": batch["doc_id"], "y": pa.array(y), "x": pa.array(list(text_features(batch["text"])), pa.list_(pa.float64()))})

    rows = own.mapInArrow(features, "id long, y long, x array<double>").collect()  # a row per sampled document
    rows.sort(key=lambda r: (r["id"], r["x"]))
    y = np.array([r["y"] for r in rows])
    if not 0 < y.sum() < len(y):
        return constant
    x = np.array([r["x"] for r in rows])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = (x - mean) / scale
    rng, good, bad = np.random.default_rng(seed), np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    # every labelled document is in a preference, the rest are drawn
    n = max(max_pairs, len(rows))
    win = np.concatenate([good, rng.choice(good, n - len(good))])
    lose = np.concatenate([bad, rng.choice(bad, n - len(bad))])
    rng.shuffle(lose)
    ahead = x[win] - x[lose]
    weights = descend(lambda w: -(ahead * sigmoid(-(ahead @ w))[:, None]).mean(axis=0) + 1e-4 * w, np.zeros(x.shape[1]), steps=300, rate=0.05)
    s = x @ weights
    order = np.argsort(s, kind="stable")
    # errors when the lowest k are judged 0, each label weighing alike; the middle of the best quantiles
    errors = np.concatenate([[0], np.cumsum(np.where(y[order] == 1, 1 / y.sum(), -1 / (len(y) - y.sum())))])
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    low, high = s[order][max(best[0] - 1, 0)], s[order][min(best[-1], len(s) - 1)]
    return QualityModel(mean, scale, weights, float((low + high) / 2), None)


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text", name: str = "quality_score") -> DataFrame:
    """The documents with a double ``name``, in place of any such column: 0 to 1, 0.3 at the threshold."""
    docs = docs.drop(name)
    schema = T.StructType([*docs.schema, T.StructField(name, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for whole in batches:
            for batch in slices(whole, text):
                if m.constant is not None:
                    score = np.full(batch.num_rows, m.constant)
                else:
                    x = (text_features(batch[text]) - m.mean) / m.scale
                    score = sigmoid(x @ m.weights - m.cut + np.log(THRESHOLD / (1 - THRESHOLD)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)
