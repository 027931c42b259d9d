"""Token files: ids in ascending doc_id order, compressed shard by shard with a Re-Pair grammar.

Re-Pair replaces a frequent pair of neighbouring ids by a new symbol (a nonterminal), again and again. Here a round counts
all pairs of a shard and replaces, from the most frequent on, every pair whose members are not yet taken as the other side of a
pair, so that no two occurrences overlap; of a run of one id every other pair is one. Rounds go on until no pair occurs LEAST times.
No pair crosses a document's end, so each document is a range of symbols.

The format is a Parquet folder with a row per shard: part and shard (ascending in doc_id), start_in_part and n_ids,
base (the first nonterminal), rules (two symbols each), rule_lengths (ids that a rule expands to), width (bytes of a
symbol), symbols, and per document doc_ids, doc_at (its first symbol) and doc_tokens (its ids). A document is decoded by
itself from its range (``decode_document``), and part of one from the lengths of its symbols (``decode_range``). Spark's commit of the folder is the commit of the files.

Defined results: null and empty texts are the end id alone; a null doc_id sorts first and stays null; repeated doc_ids are rows of
their own, in the order of their texts; an empty table gives a folder without shards.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import partitions, shared_folder, shuffles_dropped, slices
from .tokens import encoder, read_tokenizer

SHARD_IDS = 1 << 20
LEAST = 8  # a rule must occur so often
PER_ROUND = 4096
NO_ID = np.iinfo(np.int64).min
FORMAT = ("part int, shard int, start_in_part long, n_ids long, base long, width int, rules binary, rule_lengths binary, "
          "symbols binary, doc_ids binary, doc_at binary, doc_tokens binary")


def _runs(sorted_keys):
    first = np.ones(len(sorted_keys), bool)
    first[1:] = sorted_keys[1:] != sorted_keys[:-1]
    at = np.flatnonzero(first)
    return sorted_keys[at], np.diff(np.append(at, len(sorted_keys)))


def compress(ids: np.ndarray, last: np.ndarray, base: int):
    """(symbols, last, rules): ``last`` marks where documents end, rule k is what symbol base + k stands for."""
    symbols, rules = ids.astype(np.uint32), [np.zeros((0, 2), np.uint32)]
    top = base
    while True:
        small = top + PER_ROUND <= 1 << 16
        kind, shift = (np.uint32, 16) if small else (np.uint64, 32)
        pairs = (symbols[:-1].astype(kind) << kind(shift)) | symbols[1:].astype(kind)
        free = ~last[:-1]
        found, counts = _runs(np.sort(pairs[free]))
        keep = np.flatnonzero(counts >= LEAST)
        keep = keep[np.lexsort((found[keep], -counts[keep]))][:PER_ROUND]
        left, right, chosen = set(), set(), []
        for key in found[keep].tolist():
            a, b = key >> shift, key & ((1 << shift) - 1)
            if a not in right and b not in left and (a != b or a not in left):
                left.add(a), right.add(b), chosen.append(key)
        if not chosen:
            break
        keys = np.sort(np.array(chosen, kind))
        lefts, rights = np.zeros(top, bool), np.zeros(top, bool)
        lefts[list(left)], rights[list(right)] = True, True
        maybe = np.flatnonzero(free & lefts[symbols[:-1]] & rights[symbols[1:]])
        rank = np.minimum(np.searchsorted(keys, pairs[maybe]), len(keys) - 1)
        hit = keys[rank] == pairs[maybe]
        at, rank = maybe[hit], rank[hit]
        # only pairs of equal ids touch: of neighbours every other one is replaced
        run = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + 1]))
        even = (np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0
        at, rank = at[even], rank[even]
        symbols[at] = (top + rank).astype(np.uint32)
        last[at] = last[at + 1]
        stays = np.ones(len(symbols), bool)
        stays[at + 1] = False
        symbols, last = symbols[stays], last[stays]
        rules.append(np.stack([keys >> kind(shift), keys & kind((1 << shift) - 1)], axis=1).astype(np.uint32))
        top += len(keys)
    return symbols, last, np.concatenate(rules)


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for."""
    symbols = symbols.astype(np.uint32)
    while len(at := np.flatnonzero(symbols >= base)):
        rule = rules[symbols[at] - base]
        size = np.ones(len(symbols), np.int64)
        size[at] = 2
        place = (np.cumsum(size) - size)[at]
        symbols = np.repeat(symbols, size)
        symbols[place], symbols[place + 1] = rule[:, 0], rule[:, 1]
    return symbols


def _rule_lengths(rules, base):
    lengths = np.ones(len(rules), np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        lengths[k] = (lengths[a - base] if a >= base else 1) + (lengths[b - base] if b >= base else 1)
    return lengths.astype("<u4")


def _shard(part, number, start, docs, rows, base):
    ids = np.concatenate(rows)
    sizes = np.array([len(r) for r in rows], np.int64)
    last = np.zeros(len(ids), bool)
    last[np.cumsum(sizes) - 1] = True
    symbols, last, rules = compress(ids, last, base)
    at = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    width = 2 if base + len(rules) <= 1 << 16 else 4
    return {"part": part, "shard": number, "start_in_part": start, "n_ids": len(ids), "base": base, "width": width,
            "rules": rules.astype("<u4").tobytes(), "rule_lengths": _rule_lengths(rules, base).tobytes(),
            "symbols": symbols.astype(f"<u{width}").tobytes(), "doc_ids": np.array(docs, "<i8").tobytes(),
            "doc_at": at.astype("<u4").tobytes(), "doc_tokens": sizes.astype("<u4").tobytes()}


def _arrays(shard: dict):
    return (np.frombuffer(shard["symbols"], f"<u{shard['width']}"), np.frombuffer(shard["rules"], "<u4").reshape(-1, 2),
            np.frombuffer(shard["doc_ids"], "<i8"), np.frombuffer(shard["doc_at"], "<u4"), np.frombuffer(shard["doc_tokens"], "<u4"))


def decode_document(shard: dict, k: int) -> np.ndarray:
    """The ids of the k-th document of a shard, from its own range of symbols only."""
    symbols, rules, _, at, _ = _arrays(shard)
    end = at[k + 1] if k + 1 < len(at) else len(symbols)
    return expand(symbols[at[k]:end], rules, shard["base"])


def decode_range(shard: dict, k: int, first: int, end: int) -> np.ndarray:
    """Ids ``first`` to ``end`` (exclusive) of the k-th document of a shard: only the symbols that reach into them are expanded."""
    symbols, rules, _, at, _ = _arrays(shard)
    own = symbols[at[k]:at[k + 1] if k + 1 < len(at) else len(symbols)].astype(np.int64)
    lengths = np.append(np.frombuffer(shard["rule_lengths"], "<u4"), 1).astype(np.int64)
    until = np.cumsum(lengths[np.where(own >= shard["base"], own - shard["base"], len(rules))])
    first, end = max(first, 0), min(end, int(until[-1]) if len(until) else 0)
    if first >= end:
        return np.zeros(0, np.uint32)
    i, j = np.searchsorted(until, first, side="right"), np.searchsorted(until, end, side="left") + 1
    before = int(until[i - 1]) if i else 0
    return expand(own[i:j], rules, shard["base"])[first - before:end - before]


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None, doc_id: str = "doc_id",
                      text: str = "text", shard_ids: int = SHARD_IDS) -> str:
    """Write all texts to ``path`` (a new folder in the shared one if not given) and return it."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/tamis-llm/tokens-{uuid.uuid4().hex}"
    content = spark.sparkContext.broadcast(read_tokenizer(tokenizer))  # one vocabulary
    base = max(Tokenizer.from_str(content.value).get_vocab_size(with_added_tokens=True), end_id + 1)
    end = np.array([end_id], np.uint32)
    schema = None

    def run(batches):
        from pyspark import TaskContext

        encode, part = encoder(content.value).encode_column, TaskContext.get().partitionId()
        docs_of, rows, size, start, number = [], [], 0, 0, 0

        def flush():
            row = _shard(part, number, start, docs_of, rows, base)
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for whole in batches:
            for batch in slices(whole):
                for d, ids in zip(batch["doc_id"].to_pylist(), encode(batch["text"])):
                    docs_of.append(NO_ID if d is None else d), rows.append(np.concatenate([ids, end]))
                    size += len(ids) + 1
                    if size >= shard_ids:
                        yield flush()
                        docs_of, rows, start, size, number = [], [], start + size, 0, number + 1
        if rows:
            yield flush()

    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in (f.split() for f in FORMAT.split(", "))])
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    with shuffles_dropped(spark):
        (own.repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
         .mapInArrow(run, FORMAT).write.parquet(path))
    return path


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """A row per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and ids (little-endian
    unsigned 32-bit; null unless ``with_ids``)."""
    files = spark.read.schema(FORMAT).parquet(path)

    def run(batches):
        for batch in batches:
            for shard in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                symbols, rules, docs, _, tokens = _arrays(shard)
                ids = expand(symbols, rules, shard["base"]).astype("<u4")
                edge = np.concatenate([[0], np.cumsum(tokens, dtype=np.int64)])
                data = memoryview(ids.tobytes())
                own = [data[4 * i:4 * j] for i, j in zip(edge, edge[1:])]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(docs, mask=docs == NO_ID), "part": pa.array(np.full(len(docs), shard["part"], np.int32)),
                    "at": pa.array(edge[:-1] + shard["start_in_part"]), "n_tokens": pa.array(tokens.astype(np.int64)),
                    "ids_crc32": pa.array([zlib.crc32(x) for x in own], pa.int64()),
                    "ids": pa.array([bytes(x) for x in own] if with_ids else [None] * len(own), pa.binary())})

    # a row per written partition, so both the window and the broadcast stay small
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    decoded = files.mapInArrow(run, "doc_id long, part int, at long, n_tokens long, ids_crc32 long, ids binary")
    return (decoded.join(F.broadcast(before), "part")
            .select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "ids"))
