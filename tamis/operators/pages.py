"""Rows kept in order, with a sparse index: a page reads the index and the one or two files it lies in.

``write_ordered`` sorts a table once, by Spark's range partitioning, into files of about ``rows_per_file`` rows, and writes a row per file beside
them: how many rows come before it, its first key and its last. After that ``page`` and ``page_at_key`` write nothing and
cost the same however deep they lie: a filter on the index, then the files it names. A row's number is the number before its
file plus its place in it, which the reader gives.

Keys are column names, ``"-name"`` for descending; NULLs come first ascending and last descending. Equal keys come in any order, but always in the same.
A tie-breaker per row splits a key that fills many files. It is written before the rows are dealt, so that a repeated task deals them
alike, unless the table is read from files that do not change (``staged=False``).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..session import materialise, scratch

TIE = "_order_tie"
INDEX = "part int, file string, rows long, before long, total long, keys string, schema string"


def _sort_column(key: str) -> Column:
    return F.col(f"`{key[1:]}`").desc() if key.startswith("-") else F.col(f"`{key}`").asc()


def _name(key: str) -> str:
    return key.removeprefix("-")


def write_rows(df: DataFrame, path: str, sort: list, files: int | None = None, rows_per_file: int = 1_000_000, staged: bool = True) -> DataFrame:
    """The rows in order at ``path``, one file per range, read back. ``sort`` may hold any columns Spark can sort by."""
    spark = df.sparkSession
    with scratch(spark, "unordered") as staging:
        rows = df.withColumn(TIE, F.monotonically_increasing_id())
        rows = materialise(rows, "unordered", staging) if staged else rows
        files = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // rows_per_file))
        (rows.repartitionByRange(files, *sort, TIE).sortWithinPartitions(*sort, TIE).drop(TIE)
         .write.option("maxRecordsPerFile", 0).parquet(path))
    return spark.read.schema(df.schema).parquet(path)


def part_number() -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("int")


def file_counts(rows: DataFrame, *more: Column) -> DataFrame:
    """(part, file, rows, before) of written rows, and aggregates of the user's. The window runs over a row per file."""
    each = rows.groupBy(part_number().alias("part"), F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"), *more)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return each.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0)))


def write_ordered(df: DataFrame, path: str, keys: list[str], rows_per_file: int = 1_000_000, files: int | None = None, staged: bool = True) -> str:
    """Write ``df`` in order at ``path``, and its index. Files hold about ``rows_per_file`` rows, and there are at least as many as the session
    has shuffle partitions, unless ``files`` says how many."""
    path = path.rstrip("/")
    rows = write_rows(df, f"{path}/rows", [_sort_column(k) for k in keys], files, rows_per_file, staged)
    key = F.struct(*[F.col(f"`{_name(k)}`").alias(f"k{i}") for i, k in enumerate(keys)])
    place = F.col("_metadata.row_index")
    index = (file_counts(rows, F.min_by(key, place).alias("first"), F.max_by(key, place).alias("last"))
             .withColumn("total", F.sum("rows").over(Window.partitionBy()))
             .withColumn("keys", F.lit(json.dumps(keys))).withColumn("schema", F.lit(rows.schema.json())))
    index.coalesce(1).sortWithinPartitions("part").write.parquet(f"{path}/index")
    return path


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """A row per file: part, file, rows, before (rows of the files before it), total, first and last key, keys, schema."""
    return spark.read.parquet(f"{path.rstrip('/')}/index")


def _rows_of(spark: SparkSession, path: str, entries) -> DataFrame:
    """The rows of some files of the index, numbered. No file is touched that is not named."""
    if not entries:
        return spark.read.parquet(f"{path.rstrip('/')}/rows").limit(0).withColumn("row_no", F.lit(0).cast("long"))
    schema = T.StructType.fromJson(json.loads(entries[0]["schema"]))
    rows = spark.read.schema(schema).parquet(*[e["file"] for e in entries])
    before = F.create_map(*[x for e in entries for x in (F.lit(e["part"]), F.lit(e["before"]))])
    return rows.withColumn("row_no", F.try_element_at(before, part_number()) + F.col("_metadata.row_index") + 1)


def page(spark: SparkSession, path: str, size: int, index: int) -> DataFrame:
    """Slice ``index`` of the ``ceil(n / size)`` slices of an ordered table, with row_no, total_count and chunk_count."""
    first, last = index * size + 1, (index + 1) * size
    entries = read_index(spark, path).filter((F.col("before") < last) & (F.col("before") + F.col("rows") >= first)).orderBy("part").collect()
    total = entries[0]["total"] if entries else 0
    return (_rows_of(spark, path, entries).filter(F.col("row_no").between(first, last)).orderBy("row_no")
            .withColumn("total_count", F.lit(total).cast("long")).withColumn("chunk_count", F.lit(-(-total // size)).cast("long")))


def beyond(columns, keys: list[str], values) -> Column:
    """Whether a key, given by its columns, comes after ``values`` in the order of ``keys``."""
    out = F.lit(False)
    for col, key, value in reversed(list(zip(columns, keys, values))):
        down = key.startswith("-")
        if value is None:
            more = F.lit(False) if down else col.isNotNull()
        else:
            more = F.coalesce(col < F.lit(value), F.lit(True)) if down else F.coalesce(col > F.lit(value), F.lit(False))
        out = more | (col.eqNullSafe(F.lit(value)) & out)
    return out


def page_at_key(spark: SparkSession, path: str, after, size: int) -> DataFrame:
    """The next ``size`` rows after the key ``after`` (a value per key column; None: NULL), with their row_no; rows equal to it are
    passed over."""
    index = read_index(spark, path)
    keys = json.loads((index.select("keys").head() or {"keys": "[]"})["keys"])
    after = list(after)
    if keys and len(after) != len(keys):
        raise ValueError(f"the table is ordered by {keys}")
    # every file has a row, and all rows of the files after the first one found lie beyond the key
    found = index.filter(beyond([F.col(f"last.k{i}") for i in range(len(keys))], keys, after)).orderBy("part").limit(size + 1).collect()
    entries, rows = found[:1], 0
    for e in found[1:]:
        if rows >= size:
            break
        entries.append(e)
        rows += e["rows"]
    return (_rows_of(spark, path, entries).filter(beyond([F.col(f"`{_name(k)}`") for k in keys], keys, after))
            .orderBy("row_no").limit(size))
