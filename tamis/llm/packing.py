"""Packing into fixed windows by minimum bin slack.

A document is its ids and an end id. Whole windows are cut off its head; what remains is shorter than a window. The remainders of a
shard are a multiset of lengths: the longest one left opens a window, a subset-sum dynamic programme over a bitset (one Python
integer per length) finds the multiset of remaining lengths that comes closest to the room, and walking its steps back
gives the counts. A multiset found is used as often as the counts allow. Shards hold some 16,000 documents by a hash, whatever the
size of the input, so only their last windows have slack worth naming.

Defined results: null and empty texts are the end id alone; repeated rows are packed one by one; a null doc_id stays null; an
empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import partitions, slices
from .tokens import encoder, read_tokenizer

SHARD_DOCS = 1 << 14
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def fill(room: int, counts: dict[int, int]) -> dict[int, int]:
    """The multiset of lengths, each used at most counts[length] times, whose sum is the largest that fits into ``room``."""
    steps, reach, all_bits = [], 1, (1 << (room + 1)) - 1
    for length in sorted((x for x, c in counts.items() if c and x <= room), reverse=True):
        steps.append((length, reach))
        left, take = min(counts[length], room // length), 1
        while left:  # 1, 2, 4, ... copies at a time make every count up to the limit
            take = min(take, left)
            reach |= (reach << (take * length)) & all_bits
            left, take = left - take, take * 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        n = 0
        while not before >> (at - n * length) & 1:
            n += 1
        if n:
            used[length] = n
            at -= n * length
    return used


def pack_lengths(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a window, how many such windows), until all of the multiset is packed."""
    counts, plan = {x: c for x, c in counts.items() if c}, []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        used = fill(capacity - longest, counts)
        counts[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(counts[x] // n for x, n in used.items())
        plan.append(([x for x in sorted(used, reverse=True) for _ in range(used[x])], times))
        for x, n in used.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
    return plan


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, doc_id: str = "doc_id", text: str = "text",
         with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (little-endian
    unsigned 32-bit; null unless ``with_ids``). ``tokenizer`` is the path of the vocabulary file."""
    spark = docs.sparkSession
    content = spark.sparkContext.broadcast(read_tokenizer(tokenizer))  # one vocabulary
    wide = 4 * capacity

    def cut(batches):
        encode, end = encoder(content.value).encode_column, np.array([end_id], np.uint32)
        for whole in batches:
            for batch in slices(whole):
                rows = [np.concatenate([ids, end]).astype("<u4").tobytes() for ids in encode(batch["text"])]
                parts = [[r[i:i + wide] for i in range(0, len(r), wide)] for r in rows]
                out = {"doc_id": batch["doc_id"], "doc_tokens": pa.array([len(r) // 4 for r in rows], pa.int64()),
                       "crcs": pa.array([[zlib.crc32(p) for p in ps] for ps in parts], pa.list_(pa.int64())),
                       "ids": pa.array(rows if with_ids else [None] * len(rows), pa.binary())}
                yield pa.RecordBatch.from_pydict(out)

    def place(key, table):
        shard, table = key[0].as_py(), table.combine_chunks()
        ids, tokens, crcs = table["doc_id"].to_pylist(), table["doc_tokens"].to_pylist(), table["crcs"].to_pylist()
        own = table["ids"].to_pylist()
        by_length, rows, used = defaultdict(list), [], 0
        # pop() takes from the end: the same rows give the same windows, in whatever order they come
        for k in sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0, crcs[k]), reverse=True):
            if rest := tokens[k] % capacity:
                by_length[rest].append(k)
        for k in range(len(ids)):
            for j in range(tokens[k] // capacity):
                rows.append((k, j * capacity, capacity, crcs[k][j], used, 0))
                used += 1
        for lengths, times in pack_lengths({x: len(ks) for x, ks in by_length.items()}, capacity):
            for _ in range(times):
                offset = 0
                for x in lengths:
                    k = by_length[x].pop()
                    rows.append((k, tokens[k] - x, x, crcs[k][-1], used, offset))
                    offset += x
                used += 1
        at, start, length, crc, seq, offset = zip(*rows) if rows else ((),) * 6
        return pa.table({
            "doc_id": pa.array([ids[k] for k in at], pa.int64()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()),
            "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array([tokens[k] for k in at], pa.int64()),
            "sequence_id": pa.array([(shard << 32) + s for s in seq], pa.int64()), "offset": pa.array(offset, pa.int64()),
            "ids": pa.array([own[k] and own[k][4 * s:4 * (s + n)] for k, s, n in zip(at, start, length)], pa.binary())})

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    shards = max(1, -(-own.count() // SHARD_DOCS))
    lengths = own.mapInArrow(cut, "doc_id long, doc_tokens long, crcs array<long>, ids binary")
    return (lengths.withColumn("shard", F.pmod(F.xxhash64("doc_id", "doc_tokens", "crcs"), F.lit(shards)))
            .repartition(min(shards, partitions(spark)), "shard").groupBy("shard").applyInArrow(place, PIECES))
