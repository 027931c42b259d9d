"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned against every training text.

Words are runs of letters, digits and non-ASCII characters after lower-casing A-Z. Every ``window`` consecutive words of
an item make an entry of the set; an item of fewer words is one entry. A hit of the hash set is verified on
the words themselves. The set is broadcast only after its entries have been counted (``max_entries``); a
larger benchmark is matched by a shuffled join on the hash instead, with the same result.

Defined results: null or empty texts have no words and no hits; items without words match nothing; repeated
items and repeated documents are judged row by row; a null item_id marks words but is not listed; an empty
benchmark leaves all documents clean. Other columns are carried along untouched, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import U64, chain, class_table, find_words, slices, spans_to_mask, text_bytes

#: Fixed by the contract: the words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
WORD = class_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
          T.StructField("items", T.ArrayType(T.StringType())), T.StructField("clean_text", T.StringType())]


class _Kept:
    """The bytes and bounds of the words of a slice, piece by piece."""

    def __init__(self):
        self.data, self.start, self.end, self.bytes = [], [], [], 0

    def __call__(self, data, start, end, first):
        self.data.append(data)
        self.start.append(start + self.bytes)
        self.end.append(end + self.bytes)
        self.bytes += len(data)

    def close(self):
        glue = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
        self.start, self.end = glue(self.start), glue(self.end)
        self.data = np.concatenate(self.data).tobytes() if self.data else b""
        return self

    def words(self, i, j):
        return b" ".join(self.data[s:e] for s, e in zip(self.start[i:j], self.end[i:j]))


def _windows(words, lengths):
    """(length, hashes of the sequences of that many words from each position, positions that have so many)."""
    left = words.first[1:].repeat(words.count) - np.arange(len(words.hash))
    at, h = np.arange(len(left)), words.hash
    for k in range(1, max(lengths, default=0) + 1):
        if k > 1:
            go = left[at] >= k
            at, h = at[go], h[go]
            h = chain(h, words.hash[at + k - 1])
        if k in lengths:
            yield k, h, at


def benchmark_windows(items: DataFrame, window: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(hash, length, words, item_id) of every window of the items."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                kept = _Kept()
                words = find_words(batch["text"], WORD, lower=True, extra=kept)
                kept.close()
                ids, counts, doc = batch["item_id"].to_pylist(), words.count, words.doc
                for k, h, at in _windows(words, {*np.minimum(counts[counts > 0], window).tolist()}):
                    own = np.minimum(counts[doc[at]], window) == k
                    yield pa.RecordBatch.from_pydict({
                        "hash": pa.array(h[own].view(np.int64)), "length": pa.array(np.full(int(own.sum()), k, np.int32)),
                        "words": pa.array([kept.words(i, i + k) for i in at[own]], pa.binary()),
                        "item_id": pa.array([ids[doc[i]] for i in at[own]], pa.string())})

    return (items.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).cast("string").alias("text"))
            .mapInArrow(run, "hash long, length int, words binary, item_id string"))


def _assemble(texts, words, kept, begin, length, items, with_text):
    """Columns of the result from verified hits: word ranges and the ids found there (parallel lists)."""
    n_docs = len(words.first) - 1
    begin = np.asarray(begin, np.int64)
    hit = spans_to_mask(len(words.hash), begin, begin + np.asarray(length, np.int64))
    n_hit = np.add.reduceat(np.append(hit, False).astype(np.int64), words.first[:-1]) if n_docs else np.zeros(0, np.int64)
    n_hit[words.count == 0] = 0
    found = defaultdict(set)
    doc = words.doc
    for i, ids in zip(begin, items):
        found[doc[i]].update(x for x in ids if x is not None)
    out = [pa.array(words.count.astype(np.int64)), pa.array(n_hit),
           pa.array([sorted(found.get(d, ())) for d in range(n_docs)], pa.list_(pa.string()))]
    if with_text:
        clean = texts.to_pylist()
        data, at = text_bytes(texts)
        for d in np.flatnonzero(n_hit):
            i, j = words.first[d], words.first[d + 1]
            own, parts, pos = data[at[d]:at[d + 1]].tobytes(), [], 0
            runs = np.flatnonzero(np.diff(np.concatenate([[0], hit[i:j], [0]])))
            for a, b in zip(runs[::2], runs[1::2]):
                parts.append(own[pos:kept.start[i + a] - at[d]])
                pos = kept.end[i + b - 1] - at[d]
            clean[d] = b"".join([*parts, own[pos:]]).decode("utf-8", "replace")
        out.append(pa.array(clean, pa.string()))
    else:
        out.append(pa.nulls(n_docs, pa.string()))
    return out


def find_contamination(docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text", item_id: str = "item_id",
                       item_text: str = "text", with_text: bool = True, max_entries: int = 1_000_000, name: str = "contamination") -> DataFrame:
    """The documents with a struct ``name``: n_words, n_hit (words inside an occurrence), items (ids with
    an occurrence, sorted) and clean_text (the text without those words; null unless ``with_text``). A column of
    that name is replaced."""
    entries = benchmark_windows(items, window, item_id, item_text)
    added = name
    schema = T.StructType([f for f in docs.schema if f.name != added] + [T.StructField(added, T.StructType(FIELDS))])
    docs = docs.drop(added)
    if entries.count() > max_entries:
        return _by_join(docs, entries, text, with_text, schema, added)
    sets: dict = defaultdict(lambda: defaultdict(lambda: defaultdict(set)))
    for r in entries.collect():
        sets[r["length"]][r["hash"]][bytes(r["words"])].add(r["item_id"])
    packed = {k: (np.sort(np.array([*v], np.int64)), {h: dict(w) for h, w in v.items()}) for k, v in sets.items()}
    shared = docs.sparkSession.sparkContext.broadcast(packed)

    def run(batches):
        known = shared.value
        for whole in batches:
            for batch in slices(whole, text):
                kept = _Kept()
                words = find_words(batch[text], WORD, lower=True, extra=kept)
                kept.close()
                begin, length, items_of = [], [], []
                for k, h, at in _windows(words, set(known)):
                    hashes, by_hash = known[k]
                    h = h.view(np.int64)
                    near = hashes[np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)] == h
                    for x, i in zip(h[near].tolist(), at[near].tolist()):
                        if ids := by_hash[x].get(kept.words(i, i + k)):  # verified on the words
                            begin.append(i), length.append(k), items_of.append(ids)
                out = _assemble(batch[text], words, kept, begin, length, items_of, with_text)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(out, [f.name for f in FIELDS])],
                                                 [*batch.schema.names, added])

    return docs.mapInArrow(run, schema)


#: Bits of the filter that a window passes before it is shuffled: 16 MB, whatever the size of the benchmark.
FILTER_BITS = 1 << 27
BITMAP = 32_768  # fixed value: bits of one of Spark's bitmaps


def _filter_bits(entries) -> np.ndarray:
    """A bit for each hash of the benchmark's windows; at most FILTER_BITS reach the driver."""
    bit = F.pmod("hash", F.lit(FILTER_BITS))
    rows = (entries.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / BITMAP).cast("int").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.col("bit") % BITMAP).alias("bits")).collect())
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows:
        out[r["bucket"] * BITMAP // 8:(r["bucket"] + 1) * BITMAP // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _unlike(name: str, columns) -> str:
    taken = {c.lower() for c in columns}
    while name in taken:
        name = "_" + name
    return name


def _by_join(docs, entries, text, with_text, schema, added):
    """The same for a benchmark too large to broadcast: windows whose hash passes a filter meet entries by a shuffled join.

    What is hit depends on the text alone, so hits are handed back by its SHA-256: equal texts share theirs, and no other column takes part.
    """
    lengths = {r[0] for r in entries.select("length").distinct().collect()}  # at most ``window`` values
    bits = docs.sparkSession.sparkContext.broadcast(_filter_bits(entries))
    key, found = _unlike("__text_key", docs.columns), _unlike("__hits", docs.columns)
    keyed = docs.withColumn(key, F.sha2(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary"), 256))

    def windows(batches):
        for whole in batches:
            for batch in slices(whole):
                words = find_words(batch["text"], WORD, lower=True)
                for k, h, at in _windows(words, lengths):
                    place = (h & np.uint64(FILTER_BITS - 1)).astype(np.int64)
                    keep = np.flatnonzero(bits.value[place >> 3] >> (place & 7).astype(np.uint8) & 1)
                    h, at = h[keep], at[keep]
                    doc = words.doc[at]
                    yield pa.RecordBatch.from_pydict({
                        "hash": pa.array(h.view(np.int64)), "length": pa.array(np.full(len(at), k, np.int32)),
                        "row": batch["key"].take(pa.array(doc)), "at": pa.array((at - words.first[doc]).astype(np.int32))})

    where = keyed.select(F.col(key).alias("key"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(windows, "hash long, length int, row string, at int")
    hits = (where.join(entries, ["hash", "length"]).groupBy("row")
            .agg(F.collect_set(F.struct("at", "length", "words", "item_id")).alias(found)))  # bounded by one document
    joined = keyed.join(hits.withColumnRenamed("row", key), key, "left").select(*[F.col(f"`{c}`") for c in docs.columns], found)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text):
                kept = _Kept()
                words = find_words(batch[text], WORD, lower=True, extra=kept)
                kept.close()
                begin, length, items_of = [], [], []
                for d, hits_of in enumerate(batch[found].to_pylist()):
                    for x in hits_of or ():
                        i = int(words.first[d]) + x["at"]
                        if kept.words(i, i + x["length"]) == x["words"]:
                            begin.append(i), length.append(x["length"]), items_of.append([x["item_id"]])
                out = _assemble(batch[text], words, kept, begin, length, items_of, with_text)
                names = [n for n in batch.schema.names if n != found]
                yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.StructArray.from_arrays(out, [f.name for f in FIELDS])],
                                                 [*names, added])

    return joined.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text", max_share: float = 0.5, **options) -> DataFrame:
    """The documents without benchmark passages: hit words are cut out of the text, and a document goes as a whole
    when more than ``max_share`` of its words are hit. Clean documents stay as they are."""
    found = find_contamination(docs, items, window, text, with_text=True, name="__contamination", **options)
    c = F.col("__contamination")
    return (found.filter((c["n_hit"] == 0) | (c["n_hit"] <= max_share * c["n_words"]))
            .withColumn(text, c["clean_text"]).select(*docs.columns))
