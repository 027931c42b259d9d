"""Substring deduplication through difference-cover anchors.

A word goes when a window of ``window`` words that covers it occurs earlier too: in a smaller doc_id, or further ahead in
the same document. Of each document only the anchors are compared with the corpus: hashes of the short window
at positions p with p mod 13 in {0, 1, 3, 9}. Every difference modulo 13 is a difference of two of these, so any two
occurrences of a long window hold an anchor at the same place of it. Anchors that occur once rule windows out;
around the others the long windows are compared in full (128-bit hashes), and the earliest occurrence stays.

Documents are dealt into batches of a few MB by a hash. A batch sends each bucket of the hash space one blob of its distinct
hashes and gets a bit per hash back, so a passage that a third of all documents share is one entry per batch, and no pair
of documents is ever made. Batches are dealt once; the later steps reuse that exchange.

Defined results: null and empty texts have no words; rows of the same doc_id count as separate texts in the order of
their content; a null doc_id precedes all others; an empty table gives an empty result. Windows are judged on the input.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import U64, chain, find_words, in_batches, mix, sorted_docs, spans_to_mask, text_bytes, text_size

PERIOD, COVER = 13, (0, 1, 3, 9)
IS_COVER = np.isin(np.arange(PERIOD), COVER)
BUCKET_BYTES = 16 << 20  # of text per bucket: its hashes are a few MB
BLOB = "batch long, bucket long, blob binary"
NO_ID = np.iinfo(np.int64).min
ENTRY = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i8"), ("at", "<i4")])


def _rows(rows, names=("batch", "bucket", "blob")):
    kinds = [pa.int64(), pa.int64(), pa.binary()]
    return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(names, kinds))})


def _by_bucket(sorted_hashes, n_buckets):
    """(bucket, begin, end) of each bucket that sorted 64-bit hashes fall into; buckets are equal ranges."""
    own = (sorted_hashes >> U64(32)) * U64(n_buckets) >> U64(32)
    at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    return zip(own[at].tolist(), at.tolist(), np.append(at, len(own))[1:].tolist())


def _sequence(words, at, length, seed):
    h = mix(words[at] + U64(seed))
    for k in range(1, length):
        h = chain(h, words[at + k])
    return h


class _Batch:
    """The words of a batch, its anchors and windows."""

    def __init__(self, table, window):
        self.table = sorted_docs(table)
        self.words = find_words(self.table["text"])
        self.doc, n = self.words.doc, self.words.count
        self.at = np.arange(len(self.doc)) - self.words.first[self.doc]
        self.left = n[self.doc] - self.at
        self.window, short = window, window - PERIOD + 1
        self.anchors = np.flatnonzero(IS_COVER[self.at % PERIOD] & (self.left >= short) & (n[self.doc] >= window))
        self.hashes, self.which, self.counts = np.unique(
            _sequence(self.words.hash, self.anchors, short, 1), return_inverse=True, return_counts=True)

    def candidates(self, repeated):
        """Windows that hold a repeated anchor."""
        at = self.anchors[(repeated | (self.counts > 1))[self.which]]
        begin = np.maximum(at - PERIOD + 1, self.words.first[self.doc[at]])
        return np.flatnonzero(spans_to_mask(len(self.doc), begin, at + 1) & (self.left >= self.window))

    def distinct(self, at):
        """Windows at these positions by content: (index of each one's content, first position of each content, hashes)."""
        a, b = _sequence(self.words.hash, at, self.window, 2), _sequence(self.words.hash, at, self.window, 3)
        order = np.lexsort((b, a))  # stable: positions ascend within a content
        new = np.ones(len(order), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        first = order[new]
        return which, at[first], a[first], b[first]


def _bits(blobs):
    return np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8)[4:], count=int.from_bytes(b[:4], "little")) for b in blobs]).astype(bool) if blobs else np.zeros(0, bool)


def _pack(bits):
    return len(bits).to_bytes(4, "little") + np.packbits(bits).tobytes()


def repeated_windows(docs: DataFrame, window: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): each text without the words of windows that occur earlier."""
    if window < PERIOD:
        raise ValueError(f"the window must have {PERIOD} words or more")
    size = text_size(docs, text)
    n_buckets = max(1, size // BUCKET_BYTES)
    dealt = in_batches(docs, size, doc_id, text)

    def anchors(key, table):
        batch = _Batch(table, window)
        return _rows([(key[0].as_py(), k, batch.hashes[i:j].tobytes()) for k, i, j in _by_bucket(batch.hashes, n_buckets)])

    def repeated(key, table):
        blobs = [np.frombuffer(x, "<u8") for x in table["blob"].to_pylist()]
        every = np.concatenate(blobs)
        order = np.argsort(every, kind="stable")
        same = every[order][1:] == every[order][:-1]
        again = np.zeros(len(every), bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        cut = np.cumsum([0, *map(len, blobs)])
        return _rows([(b, key[0].as_py(), _pack(again[i:j])) for b, i, j in zip(table["batch"].to_pylist(), cut, cut[1:])])

    def windows(key, table, replies):
        if not table.num_rows:
            return _rows([])
        batch, number = _Batch(table, window), key[0].as_py()
        at = batch.candidates(_bits(replies.sort_by("bucket")["blob"].to_pylist()))
        _, first, a, b = batch.distinct(at)
        mask = np.zeros(len(batch.doc), bool)
        mask[at] = True
        entries = np.empty(len(first), ENTRY)
        ids = batch.table["doc_id"].fill_null(NO_ID).combine_chunks().to_numpy()
        entries["a"], entries["b"], entries["doc"], entries["at"] = a, b, ids[batch.doc[first]], batch.at[first]
        # the candidates themselves go along, to a bucket of their own, for the last step
        return _rows([(number, -1 - number, _pack(mask)), *((number, k, entries[i:j].tobytes()) for k, i, j in _by_bucket(a, n_buckets))])

    def earliest(key, table):
        if key[0].as_py() < 0:
            return table.select(["batch", "bucket", "blob"])
        blobs = [np.frombuffer(x, ENTRY) for x in table["blob"].to_pylist()]
        every = np.concatenate(blobs)
        source = np.repeat(table["batch"].to_numpy(), [len(x) for x in blobs])
        order = np.lexsort((source, every["at"], every["doc"], every["b"], every["a"]))
        a, b = every["a"][order], every["b"][order]
        leads = np.ones(len(order), bool)
        leads[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        wins = np.zeros(len(order), bool)
        wins[order] = leads
        cut = np.cumsum([0, *map(len, blobs)])
        return _rows([(s, key[0].as_py(), _pack(wins[i:j])) for s, i, j in zip(table["batch"].to_pylist(), cut, cut[1:])])

    def keep(key, table, replies):
        if not table.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()),
                             "n_removed": pa.array([], pa.int64()), "kept_text": pa.array([], pa.string())})
        table = sorted_docs(table)
        words = find_words(table["text"])
        gone = np.zeros(len(words.hash), bool)
        replies = replies.sort_by("bucket")
        blobs = replies["blob"].to_pylist()
        if blobs and (mask := _bits(blobs[:1])).any():
            batch = _Batch(table, window)
            at = np.flatnonzero(mask)
            which, first, _, _ = batch.distinct(at)
            stays = np.zeros(len(mask), bool)
            stays[first[_bits(blobs[1:])]] = True
            bad = at[~stays[at]]
            gone = spans_to_mask(len(mask), bad, bad + window)
        data, at = text_bytes(table["text"])
        n_removed, kept = np.zeros(len(words.count), np.int64), []
        for d, (i, j) in enumerate(zip(words.first, words.first[1:])):
            parts = data[at[d]:at[d + 1]].tobytes().split()  # the same words: bytes split at ASCII white space
            n_removed[d] = int(gone[i:j].sum())
            kept.append(b" ".join(itertools.compress(parts, (~gone[i:j]).tolist()) if n_removed[d] else parts))
        return pa.table({"doc_id": table["doc_id"].combine_chunks(), "n_words": pa.array(words.count.astype(np.int64)), "n_removed": pa.array(n_removed),
                         "kept_text": pa.array(kept, pa.binary()).cast(pa.string())})

    of_batch = dealt.groupBy("batch")
    hits = of_batch.applyInArrow(anchors, BLOB).groupBy("bucket").applyInArrow(repeated, BLOB)
    winners = of_batch.cogroup(hits.groupBy("batch")).applyInArrow(windows, BLOB).groupBy("bucket").applyInArrow(earliest, BLOB)
    return of_batch.cogroup(winners.groupBy("batch")).applyInArrow(keep, "doc_id long, n_words long, n_removed long, kept_text string")
