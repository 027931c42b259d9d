"""What the operators share: intermediates in the shared folder, words as numpy arrays, batches of documents.

Words are found in the bytes of an Arrow column, a few hundred thousand at a time, and told apart by a
64-bit hash (one to one for words of up to eight bytes). Separators are ASCII, so bytes and code points
give the same words.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

U64 = np.uint64
ASCII_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: A task works on about so many bytes of text at once; a longer document is a piece of its own.
PIECE_BYTES = 1 << 20
BATCH_BYTES = 4 << 20


# --- intermediates -------------------------------------------------------------

def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a session within one process may do without."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    named = tempfile.mkdtemp(prefix="tamis-llm-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Within it, an action's shuffle files go when the action ends, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of the shared folder that nobody has written to yet."""
    return f"{shared_folder(spark)}/tamis-llm/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove an intermediate that was written here and is read no more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialise(df: DataFrame, name: str, path: str | None = None, row_group: int | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back: it survives lost executors and cuts the lineage. ``row_group``: so many bytes are
    held at once, for rows of large blobs, which are packed tighter."""
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    options = {} if row_group is None else {"parquet.block.size": row_group, "compression": "zstd"}
    with shuffles_dropped(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- words ---------------------------------------------------------------------

class Words(NamedTuple):
    """Words of some documents, in order. ``first``: the index of each document's first word, and the end."""
    first: np.ndarray
    hash: np.ndarray

    @property
    def count(self):
        return np.diff(self.first)

    @property
    def doc(self):
        return np.repeat(np.arange(len(self.first) - 1), self.count)


def class_table(excluded: bytes) -> np.ndarray:
    """For each byte, whether it belongs to words."""
    table = np.ones(256, bool)
    table[list(excluded)] = False
    return table


NOT_SPACE = class_table(ASCII_SPACE)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x):
    """A one-to-one scramble of 64-bit numbers."""
    x = x ^ (x >> U64(31))
    x *= U64(0x7FB5D329728EA185)
    x ^= x >> U64(27)
    x *= U64(0x81DADEF4BC2DD44D)
    x ^= x >> U64(33)
    return x


def chain(h, x):
    """The hash of a sequence from that of its head and its next member."""
    return mix(h * U64(0x9E3779B97F4A7C15) + x)


def text_bytes(texts) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each text begins (and the end); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], texts.type)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[at[0]:at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def pieces(at: np.ndarray, size: int = PIECE_BYTES):
    """Ranges of whole documents of about ``size`` bytes."""
    begin, n = 0, len(at) - 1
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + size, side="right")) - 1)
        yield begin, min(end, n)
        begin = min(end, n)


def word_bounds(data, at, inside):
    """First byte and end of each word, and the index of each document's first word."""
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    heads, tails = at[:-1][at[:-1] < len(data)], at[1:][at[1:] > 0] - 1
    starts[heads] = inside[heads]
    ends[tails] = inside[tails]
    start = np.flatnonzero(starts)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, at)


def word_hashes(data, start, length):
    """64-bit hashes of byte ranges, eight bytes at a step."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    h = mix(length.astype(U64) * U64(0xD6E8FEB86659FD93))
    at, left, alive = start, length, None
    while len(at):
        keep = np.minimum(left, 8).astype(U64) * U64(8)
        part = eights[at] & (~U64(0) >> (U64(64) - keep))
        if alive is None:
            h = mix(h + part)
            alive = np.flatnonzero(left > 8)
        else:
            h[alive] = chain(h[alive], part)
            alive = alive[left > 8]
        go = left > 8
        at, left = at[go] + 8, left[go] - 8
    return h


def find_words(texts, table=NOT_SPACE, lower=False, extra=None) -> Words:
    """The words of a string column. ``extra``: called with (bytes, starts, ends, firsts) of each piece."""
    data, at = text_bytes(texts)
    firsts, hashes, total = [np.zeros(1, np.int64)], [], 0
    for i, j in pieces(at):
        own, own_at = data[at[i]:at[j]], at[i:j + 1] - at[i]
        if lower:
            own = LOWER[own]
        start, end, first = word_bounds(own, own_at, table[own])
        hashes.append(word_hashes(own, start, end - start))
        firsts.append(first[1:] + total)
        total += len(start)
        if extra is not None:
            extra(own, start, end, first)
    return Words(np.concatenate(firsts), np.concatenate(hashes) if hashes else np.zeros(0, U64))


def spans_to_mask(n, begin, end):
    """Which of n positions lie in any range [begin, end)."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, begin, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change[:-1]) > 0


# --- batches of documents -------------------------------------------------------

def text_size(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0


def in_batches(docs: DataFrame, size: int, doc_id: str = "doc_id", text: str = "text", batch_bytes: int = BATCH_BYTES,
               **more) -> DataFrame:
    """(batch, doc_id, text) and ``more`` columns, dealt by batch. A document's batch depends on its id and text alone, so that a
    repeated task sees the same batches; one batch holds about ``batch_bytes`` at any size of the input."""
    n = max(1, -(-size // batch_bytes))
    return (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *[c.alias(k) for k, c in more.items()])
            .select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).alias("batch"), "doc_id", "text", *more)
            .repartition(partitions(docs.sparkSession), "batch"))


def sorted_docs(table: pa.Table) -> pa.Table:
    """A batch in ascending (doc_id, text) order, null ids first."""
    ids = table["doc_id"].fill_null(np.iinfo(np.int64).min).combine_chunks()
    order = np.argsort(ids.to_numpy(), kind="stable")
    ids = ids.to_numpy()[order]
    if (ids[1:] == ids[:-1]).any():  # ties: by text, so that the order is the same each time
        texts = table["text"].to_pylist()
        order = np.array(sorted(range(len(order)), key=lambda k: (table["doc_id"][k].as_py() or 0, texts[k] or "", texts[k] is None)))
        order = order[np.argsort(table["doc_id"].fill_null(np.iinfo(np.int64).min).combine_chunks().to_numpy()[order], kind="stable")]
    return table.take(pa.array(order))


def slices(batch: pa.RecordBatch, column: str = "text", size: int = BATCH_BYTES):
    """A record batch in slices of about ``size`` bytes of text."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(lengths)])
    for i, j in pieces(at, size):
        yield batch.slice(i, j - i)
