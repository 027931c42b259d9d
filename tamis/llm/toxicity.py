"""Toxicity by multiple-instance learning: sentences are scored, noisy-or makes them the document's score.

Labels are known for documents only. A sentence is the bag of its words' features (the lower-cased word and its first
4, 5 and 6 bytes); it offends with p = sigmoid(bias + weights of its features), and a document is toxic unless
no sentence offends: 1 - exp(-base) * prod(1 - p). The document likelihood trains weights, bias and base together, so that the
sentences to blame are found on the way. Sentences without any learned feature do not offend; thus length alone
makes no document toxic.

Fitted on at most ``max_labels`` labelled documents, with at most ``max_features`` features chosen by how much more often
toxic documents hold them; scoring reads every whole text.

Defined results: null and empty texts score the base rate; rows without label or id take no part in fitting; without
labels of both kinds all documents score the share of label 1 (0.5 without any). Every row is scored by itself, repeated
or not, and carries its other columns along.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import U64, chain, class_table, find_words, slices, text_bytes, word_hashes
from .labelled import descend, pick, sample_labels, sigmoid

LETTERS = class_table(bytes(x for x in range(128) if not chr(x).isalnum()))
STOP = np.zeros(256, bool)
STOP[list(b".!?\n")] = True
PREFIXES = (4, 5, 6)
FIELDS = [T.StructField("score", T.DoubleType()),
          T.StructField("sentences", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                                                               T.StructField("score", T.DoubleType())])))]


class ToxicityModel(NamedTuple):
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float
    base: float  # -log of the chance that a document without offending sentences is not toxic


class _Instances:
    """Feature hashes of the words of a column: the document, sentence and kinds of each."""

    def __init__(self, texts):
        self.sentence, self.kinds, self._seen = [], [[] for _ in PREFIXES], 0
        words = find_words(texts, LETTERS, lower=True, extra=self._piece)
        self.n_docs, self.doc = len(words.first) - 1, words.doc
        self.sentence = np.concatenate(self.sentence) if self.sentence else np.zeros(0, np.int64)
        self.kinds = [words.hash, *(np.concatenate(k) if k else np.zeros(0, U64) for k in self.kinds)]

    def _piece(self, data, start, end, first):
        stops = np.cumsum(STOP[data])
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.sentence.append((stops[start] if len(start) else np.zeros(0, np.int64)) + doc + self._seen)
        self._seen += int(stops[-1] if len(stops) else 0) + len(first)
        for k, out in zip(PREFIXES, self.kinds):
            out.append(chain(word_hashes(data, start, np.minimum(end - start, k)), U64(k)))

    def matches(self, features):
        """(document, sentence, feature index) of each word and kind that is a feature, once per sentence."""
        rows = []
        for h in self.kinds:
            at = np.minimum(np.searchsorted(features, h), max(len(features) - 1, 0))
            hit = np.flatnonzero(features[at] == h) if len(features) else np.zeros(0, np.int64)
            rows.append(np.stack([self.doc[hit], self.sentence[hit], at[hit]], axis=1))
        return np.unique(np.concatenate(rows), axis=0)


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", doc_id: str = "doc_id",
                 max_labels: int = 20_000, max_features: int = 4096) -> ToxicityModel:
    spark = docs.sparkSession
    known = sample_labels(labels, label, max_labels)
    share = sum(known.values()) / len(known) if known else 0.5
    constant = ToxicityModel(np.zeros(0, U64), np.zeros(0), 0.0, float(-np.log1p(-min(share, 0.999))))
    positive = sum(known.values())
    if not 0 < positive < len(known):
        return constant
    shared = spark.sparkContext.broadcast(known)  # at most max_labels ids
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def counts(batches):
        for whole in batches:
            for batch in slices(whole):
                batch, y = pick(batch, shared.value)
                x = _Instances(batch["text"])
                pairs = np.stack([np.tile(x.doc, len(x.kinds)).astype(U64), np.concatenate(x.kinds)])
                pairs = pairs[:, np.lexsort(pairs)]
                once = np.ones(pairs.shape[1], bool)
                once[1:] = (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)
                of = y[pairs[0, once].astype(np.int64)]
                found, at = np.unique(pairs[1, once], return_inverse=True)
                yield pa.RecordBatch.from_pydict({
                    "feature": pa.array(found.view(np.int64)), "pos": pa.array(np.bincount(at, of, len(found)).astype(np.int64)),
                    "neg": pa.array(np.bincount(at, 1 - of, len(found)).astype(np.int64))})

    lift = (F.log((F.col("pos") + 0.5) / positive) - F.log((F.col("neg") + 0.5) / (len(known) - positive)))
    chosen = (own.mapInArrow(counts, "feature long, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
              .filter(F.col("pos") >= 3).withColumn("gain", F.col("pos") * lift).filter(lift > 1.4)
              .orderBy(F.desc("gain"), "feature").limit(max_features).select("feature").collect())
    features = np.sort(np.array([r[0] for r in chosen], np.int64).view(U64))

    def bags(batches):
        for whole in batches:
            for batch in slices(whole):
                batch, y = pick(batch, shared.value)
                found = _Instances(batch["text"]).matches(features)
                cut = np.searchsorted(found[:, 0], np.arange(len(y) + 1))
                yield pa.RecordBatch.from_pydict({
                    "y": pa.array(y), "sentence": pa.array([found[i:j, 1] for i, j in zip(cut, cut[1:])], pa.list_(pa.int64())),
                    "feature": pa.array([found[i:j, 2] for i, j in zip(cut, cut[1:])], pa.list_(pa.int64()))})

    rows = own.mapInArrow(bags, "y long, sentence array<long>, feature array<long>").collect()  # a row per sampled document
    if not rows:
        return constant
    y = np.array([r["y"] for r in rows])
    doc = np.repeat(np.arange(len(rows)), [len(r["sentence"]) for r in rows])
    sentence = np.array([s for r in rows for s in r["sentence"]], np.int64)
    feature = np.array([f for r in rows for f in r["feature"]], np.int64)
    instance, at = np.unique(np.stack([doc, sentence], axis=1), axis=0, return_inverse=True) if len(doc) else (np.zeros((0, 2), int), doc)
    at, owner, n = at.ravel(), instance[:, 0], len(features)

    def gradient(x):
        w, bias, base = x[:n], x[n], np.log1p(np.exp(x[n + 1]))
        z = bias + np.bincount(at, w[feature], len(owner))
        total = base + np.bincount(owner, np.logaddexp(0, z), len(y))
        pull = np.where(y == 1, -1 / np.expm1(np.clip(total, 1e-9, 40)), 1.0) / len(y)
        dz = pull[owner] * sigmoid(z)
        return np.concatenate([np.bincount(feature, dz[at], n) + 1e-5 * w, [dz.sum()], [pull.sum() * sigmoid(x[n + 1])]])

    x = descend(gradient, np.concatenate([np.zeros(n), [-4.0, -4.0]]))
    return ToxicityModel(features, x[:n], float(x[n]), float(np.log1p(np.exp(x[n + 1]))))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", offending: float = 0.5, name: str = "toxicity") -> DataFrame:
    """The documents with a struct ``name``, in place of any such column: score, and sentences (start, end, score; code points, end exclusive)
    that offend with a chance of ``offending`` or more."""
    docs = docs.drop(name)
    schema = T.StructType([*docs.schema, T.StructField(name, T.StructType(FIELDS))])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most max_features numbers

    def run(batches):
        m = shared.value
        for whole in batches:
            for batch in slices(whole, text):
                x = _Instances(batch[text])
                found = x.matches(m.features)
                _, head, at = np.unique(found[:, 1], return_index=True, return_inverse=True) if len(found) else (0, np.zeros(0, int), np.zeros(0, int))
                z = m.bias + np.bincount(at.ravel(), m.weights[found[:, 2]], len(head))
                doc = found[head, 0]
                score = -np.expm1(-(m.base + np.bincount(doc, np.logaddexp(0, z), x.n_docs)))
                places = [[] for _ in range(x.n_docs)]
                if (blame := np.flatnonzero(sigmoid(z) >= offending)).size:
                    data, text_at = text_bytes(batch[text])
                    first = np.searchsorted(x.doc, np.arange(x.n_docs + 1))
                    for k in blame:
                        d, s = doc[k], found[head[k], 1]
                        own = data[text_at[d]:text_at[d + 1]]
                        stops = np.concatenate([[0], np.flatnonzero(STOP[own]) + 1, [len(own)]])
                        # sentence numbers of a document count its stops, from that of its first word
                        lead = _stops_before_first_word(own)
                        n = int(s - x.sentence[first[d]]) + lead
                        begin, end = stops[n], stops[min(n + 1, len(stops) - 1)]
                        chars = np.cumsum((own[:end] & 0xC0) != 0x80)
                        places[d].append({"start": int(chars[begin - 1]) if begin else 0, "end": int(chars[end - 1]), "score": float(sigmoid(z[k]))})
                fields = [pa.array(np.clip(score, 0.0, 1.0)), pa.array(places, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(fields, ["score", "sentences"])], [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def _stops_before_first_word(data):
    inside = np.flatnonzero(LETTERS[data])
    return int(STOP[data[:inside[0]]].sum()) if len(inside) else 0
