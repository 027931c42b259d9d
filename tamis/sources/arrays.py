"""Large files that hold one JSON array of objects (or objects one after the other), split over tasks.

Spark parses such a file in one task. Here it is read as text that ends at closing braces, so Spark splits it anywhere, whatever its lines. Two
passes over the splits: the first sums up each split, without knowing what comes before it: how many quotes it has, and how many levels it opens less
those it closes, once for a start outside of a string and once for one inside. The summaries, a row per split, combined in order, tell
where each split begins: in a string or not, and how deep. The second pass then finds the ends of the array's elements in each split. Elements that
reach over a border are put together from the pieces of the splits they touch. Elements parse in the JVM, each in its own row.

Escapes never hold a brace, so none reaches over a cut. What is no object (a number between elements, text behind the array) stays with the element
that follows, or by itself, and does not parse: it fails the read or is kept in ``_corrupt_record``.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .files import CORRUPT

_ESCAPE = re.compile(r"\\.", re.S)
SUMMARY = "file string, block long, quotes long, out_depth long, in_depth long, first string"
PIECE = "file string, block long, kind int, text string"
HEAD, WHOLE, TAIL, THROUGH = range(4)  # up to the first end in a split, between two, after the last, and a split without any


def _levels(text: str) -> int:
    return text.count("{") + text.count("[") - text.count("}") - text.count("]")


def _outside(fragment: str) -> tuple[int, int, int]:
    """(quotes, levels opened less closed if it begins outside of a string, the same if inside) of text before a closing brace."""
    if "\\" in fragment:
        fragment = _ESCAPE.sub("", fragment)
    parts = fragment.split('"')
    quotes = len(parts) - 1
    out, inner = _levels("".join(parts[::2])), _levels("".join(parts[1::2]))
    return quotes, out - (quotes % 2 == 0), inner - (quotes % 2 == 1)  # the brace counts if it is outside


def _fragments(batches) -> Iterator[tuple[str, int, str]]:
    for batch in batches:
        yield from zip(batch["file"].to_pylist(), batch["block"].to_pylist(), batch["value"].to_pylist())


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, state = None, [0, 0, 0, None]

    def done():
        return pa.RecordBatch.from_pydict({"file": [now[0]], "block": pa.array([now[1]], pa.int64()), "quotes": pa.array([state[0]], pa.int64()),
                                           "out_depth": pa.array([state[1]], pa.int64()), "in_depth": pa.array([state[2]], pa.int64()),
                                           "first": pa.array([state[3]], pa.string())})

    for file, block, text in _fragments(batches):
        if (file, block) != now:
            if now:
                yield done()
            now, state = (file, block), [0, 0, 0, None]
        quotes, out, inner = _outside(text)
        odd = state[0] % 2
        state[0] += quotes
        state[1] += inner if odd else out
        state[2] += out if odd else inner
        if state[3] is None:
            state[3] = (text.lstrip("﻿ \t\r\n") or "}")[0]  # an empty one stands before a brace
    if now:
        yield done()


def _starts(rows) -> dict[tuple[str, int], tuple[int, int, int]]:
    """(quotes before, depth, depth between elements) at the head of each split."""
    files, out = defaultdict(list), {}
    for r in rows:
        files[r["file"]].append(r)
    for file, splits in files.items():
        quotes = depth = 0
        splits.sort(key=lambda r: r["block"])
        base = int(splits[0]["first"] == "[")
        for r in splits:
            out[file, r["block"]] = (quotes, depth, base)
            depth += r["in_depth"] if quotes % 2 else r["out_depth"]
            quotes += r["quotes"]
    return out


def _pieces(starts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ended, quotes, depth, base = None, [], False, 0, 0, 0
        rows: list = []

        def flush():
            batch = pa.RecordBatch.from_pydict({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(
                (("file", pa.string()), ("block", pa.int64()), ("kind", pa.int32()), ("text", pa.string())))})
            rows.clear()
            return batch

        def close():
            if now and held:
                rows.append((*now, TAIL if ended else THROUGH, "".join(held)))

        for file, block, text in _fragments(batches):
            if (file, block) != now:
                close()
                now, held, ended = (file, block), [], False
                if now not in starts.value:
                    raise RuntimeError("the splits of the file changed between two passes: keep spark.sql.files.maxPartitionBytes as it is")
                quotes, depth, base = starts.value[now]
            n, out, inner = _outside(text)
            depth += inner if quotes % 2 else out
            quotes += n
            held += [text, "}"]
            if quotes % 2 == 0 and depth == base:
                rows.append((*now, WHOLE if ended else HEAD, "".join(held)))
                held, ended = [], True
            if len(rows) >= 1000:
                yield flush()
        close()
        if rows:
            yield flush()

    return run


def json_elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of each element of the arrays in the files, and of what is left over."""
    lines = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    starts = spark.sparkContext.broadcast(_starts(lines.mapInArrow(_summaries, SUMMARY).collect()))  # a row per split
    found = lines.mapInArrow(_pieces(starts), PIECE)
    whole = found.filter(F.col("kind") == WHOLE).select("file", "text")
    # an element over a border: the tail of a split, splits without an end, the head of the next one; numbered by the splits that end one before
    splits = sorted(starts.value)
    number = {s: i for i, s in enumerate(splits)}
    parts = found.filter(F.col("kind") != WHOLE)
    order = spark.createDataFrame([(f, b, i) for (f, b), i in number.items()] or [], "file string, block long, number int")
    parts = parts.join(F.broadcast(order), ["file", "block"])  # a row per split
    ends = [r["number"] for r in parts.filter(F.col("kind") == HEAD).select("number").collect()]  # a number per split
    before = {}
    ended = set(ends)
    for i, (file, _) in enumerate(splits):
        same = i > 0 and splits[i - 1][0] == file
        before[i] = -1 - i if not same else (i - 1 if i - 1 in ended else before[i - 1])
    chain = spark.createDataFrame([(i, c) for i, c in before.items()] or [], "number int, chain int")
    own = F.when(F.col("kind") == TAIL, F.col("number")).otherwise(F.col("chain"))
    joined = (parts.join(F.broadcast(chain), "number").groupBy("file", own.alias("chain"))
              .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("number", "kind", "text"))), lambda x: x["text"]), "").alias("text")))  # one element
    # the brace behind a file's last text is not there
    rest = F.regexp_replace("text", r"\A[\s﻿]*\[?\s*,?\s*\]?\s*\}\z", "")
    clean = F.regexp_replace(F.when(rest == "", "").otherwise(F.col("text")), r"\A[\s﻿]*[\[,]?\s*", "")
    return whole.unionByName(joined.select("file", "text")).select("file", clean.alias("text")).filter("text <> ''")


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str, keep_bad_elements: bool = False) -> DataFrame:
    """The objects of the arrays in the files. An element that does not parse fails the read, or is kept in ``_corrupt_record``."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    text = json_elements(spark, path)
    if not keep_bad_elements:
        return text.select(F.from_json("text", schema, {"mode": "FAILFAST"}).alias("e")).select("e.*")
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return text.select(F.from_json("text", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("e")).select("e.*")
