"""Keyed tables in versions: a change rewrites the files it touches and carries the others over.

A table is a folder. ``data`` holds Parquet files that are never changed, ``blooms`` a Bloom filter per file, ``manifest/version=n`` a row per file of
version n: its rows, its least and greatest key. A change finds the files that may hold its keys, first by their bounds, then by their
filters; it writes their new rows, and a manifest that names the new files and all files not touched. A version appears when its manifest is
complete; writing a number that exists fails, so of two writers at the same time one has to try again. Older versions stay readable.

Finding the files is a join of keys and bounds on cells: at most ``CELLS`` cuts through the key space, taken from the bounds, number the
keys and the files, so neither side is compared with all of the other. Only the filters of files that are within bounds are read. Filters are
bitmaps of Spark's own, built by aggregates. Keys must not repeat within the table; of several changes of a key in one call the last by
``order`` counts. A NULL is a key like others.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..session import list_folder, materialise, scratch
from .tables import last_updates

CELLS = 256
#: A Bloom filter has BITS bits per row, of which HASHES are set: one in 50 or so of foreign keys passes.
BITS, HASHES = 12, 4
BITMAP = 32_768  # fixed value: bits of one of Spark's bitmaps


def _key(keys: list[str], of=F.col) -> Column:
    return F.struct(*[of(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)])


def _bits(key: Column, buckets: Column) -> Column:
    """The positions of a key in a filter of so many bitmaps, as an array."""
    size = buckets * BITMAP
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(i)), size) for i in range(HASHES)])


def _versions(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n.removeprefix("version=")) for n in list_folder(spark, f"{root}/manifest") if n.startswith("version=")
                  and "_SUCCESS" in list_folder(spark, f"{root}/manifest/{n}"))


def latest_version(spark: SparkSession, root: str) -> int:
    found = _versions(spark, root.rstrip("/"))
    if not found:
        raise ValueError(f"{root} has no version")
    return found[-1]


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """A row per file: file, rows, low and high (least and greatest key), buckets (bitmaps of its filter), blooms (their folder)."""
    root = root.rstrip("/")
    return spark.read.parquet(f"{root}/manifest/version={latest_version(spark, root) if version is None else version}")


def read_table(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the latest if none is given."""
    files = manifest(spark, root, version).select("file").collect()  # a row per file
    schema, _ = _described(spark, root)
    return _rows(spark, schema, [r["file"] for r in files])


def _rows(spark, schema, files) -> DataFrame:
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def _described(spark, root) -> tuple[T.StructType, list[str]]:
    about = json.loads(spark.read.text(f"{root.rstrip('/')}/about").head()["value"])
    return T.StructType.fromJson(about["schema"]), about["keys"]


def _write_files(df: DataFrame, root: str, keys: list[str], files: int, folder: str) -> DataFrame:
    """Write rows in ranges of the key, their filters, and return their entries of the manifest, kept in ``folder``."""
    spark, name = df.sparkSession, uuid.uuid4().hex
    path = f"{root}/data/{name}"
    df.repartitionByRange(files, *[F.col(f"`{k}`") for k in keys]).write.option("maxRecordsPerFile", 0).parquet(path)
    rows = spark.read.schema(df.schema).parquet(path).select(F.col("_metadata.file_path").alias("file"), _key(keys).alias("key"))
    entries = materialise(rows.groupBy("file").agg(F.count("*").alias("rows"), F.min("key").alias("low"), F.max("key").alias("high"))
                          .withColumn("buckets", F.ceil(F.col("rows") * BITS / BITMAP).cast("int"))
                          .withColumn("blooms", F.lit(f"{root}/blooms/{name}")), "entries", f"{folder}/entries")
    at = F.explode(_bits(F.col("key"), F.col("buckets")))
    # two numbers per file of this change
    (rows.join(F.broadcast(entries.select("file", "buckets")), "file").select("file", at.alias("at"))
     .groupBy("file", F.floor(F.col("at") / BITMAP).cast("int").alias("bucket"))
     .agg(F.bitmap_construct_agg(F.col("at") % BITMAP).alias("bitmap")).write.parquet(f"{root}/blooms/{name}"))
    return entries


def _publish(entries: DataFrame, root: str, version: int) -> int:
    entries.coalesce(1).write.mode("errorifexists").parquet(f"{root}/manifest/version={version}")
    return version


def create_table(df: DataFrame, root: str, key, rows_per_file: int = 1_000_000, files: int | None = None) -> int:
    """Version 0 of a table: ``df`` in ranges of its key."""
    spark, root, keys = df.sparkSession, root.rstrip("/"), [key] if isinstance(key, str) else list(key)
    files = files or max(1, -(-df.count() // rows_per_file))
    about = json.dumps({"schema": json.loads(df.schema.json()), "keys": keys})
    spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{root}/about")
    with scratch(spark, "table") as folder:
        return _publish(_write_files(df, root, keys, files, folder), root, 0)


def files_with(spark: SparkSession, entries: DataFrame, keys: DataFrame, folder: str) -> list[str]:
    """The files that may hold any of the keys (a column ``key``): those within bounds whose filter hits. A name per file comes back.
    Intermediates go to ``folder``."""
    cuts = entries.select("low").distinct().orderBy("low").collect()  # a row per file
    cuts = [r["low"] for r in cuts[::max(1, -(-len(cuts) // CELLS))]]
    if not cuts:
        return []
    kind = entries.schema["low"].dataType
    # a constant of at most CELLS keys
    all_cuts = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(c, kind.fields)]) for c in cuts])

    def cell(key):
        return F.size(F.filter(all_cuts, lambda c: c <= key))

    bounds = entries.select("file", "low", "high", "buckets", "blooms", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))).alias("cell"))
    wanted = keys.select(F.col("key"), cell(F.col("key")).alias("cell"))
    within = materialise(wanted.join(bounds, "cell").filter("key >= low AND key <= high").select("key", "file", "buckets", "blooms"), "within", f"{folder}/within")
    folders = [r["blooms"] for r in within.select("blooms").distinct().collect()]
    if not folders:
        return []
    bit = F.col("at") % BITMAP
    asked = (within.withColumn("at", F.explode(_bits(F.col("key"), F.col("buckets"))))
             .select("file", "key", F.floor(F.col("at") / BITMAP).cast("int").alias("bucket"), bit.alias("bit")))
    blooms = spark.read.schema("file string, bucket int, bitmap binary").parquet(*folders).join(within.select("file").distinct(), "file", "left_semi")
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1
    # files of keys and filters are small, their rows are many: by its size Spark would send either to all tasks
    hits = materialise(asked.hint("merge").join(blooms.hint("merge"), ["file", "bucket"]).groupBy("file", "key").agg(F.count_if(is_set).alias("n"))
                       .filter(F.col("n") == HASHES).select("file").distinct(), "hits", f"{folder}/hits").collect()
    return sorted(r["file"] for r in hits)


def _change(spark: SparkSession, root: str, folder: str, changes: DataFrame, rewrite, rows_per_file: int, adds: bool) -> int:
    """A new version: ``rewrite`` makes of the rows of the touched files (possibly none) and the changes the rows that replace them."""
    version = latest_version(spark, root)
    schema, keys = _described(spark, root)
    now = manifest(spark, root, version)
    touched = files_with(spark, now, changes.select(_key(keys).alias("key")), folder)
    if not touched and not adds:
        return _publish(now, root, version + 1)
    fresh = rewrite(_rows(spark, schema, touched), schema, keys).select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in schema.fields])
    return _replace(spark, root, folder, now, version, touched, fresh, keys, rows_per_file)


def _replace(spark, root, folder, now, version, touched, fresh, keys, rows_per_file) -> int:
    fresh = materialise(fresh, "fresh", f"{folder}/fresh")
    n = fresh.count()
    kept = now.join(spark.createDataFrame([(f,) for f in touched], "file string"), "file", "left_anti").select(*now.columns)
    if n:
        files = max(1, -(-n // rows_per_file), min(len(touched), n))
        kept = kept.unionByName(_write_files(fresh, root, keys, files, folder))
    return _publish(kept, root, version + 1)


def upsert_table(spark: SparkSession, root: str, updates: DataFrame, order=None, insert: bool = True, rows_per_file: int = 1_000_000) -> int:
    """Write a version in which the rows of ``updates`` replace those of their key, or are added (``insert``).

    ``updates`` may have only some of the columns beside the key: the others keep their value, and are NULL in added rows. Returns the
    number of the version.
    """
    root = root.rstrip("/")
    schema, keys = _described(spark, root)
    known = [c for c in schema.names if c in updates.columns]
    if missing := [k for k in keys if k not in known]:
        raise ValueError(f"updates lack the key column {missing[0]}")

    with scratch(spark, "upsert") as folder:
        changes = materialise(last_updates(updates, keys, order).select(*[F.col(f"`{c}`") for c in known]), "changes", f"{folder}/changes")

        def rewrite(old, schema, keys):
            new = changes.select(_key(keys).alias("_k"), F.struct(*[F.col(f"`{c}`") for c in known]).alias("_new")).hint("merge")
            both = old.select(_key(keys).alias("_k"), F.struct(*[F.col(f"`{c}`") for c in schema.names]).alias("_old")).join(
                new, "_k", "full_outer" if insert else "left")

            def value(name):
                if name not in known:
                    return F.col("_old")[name]
                return F.when(F.col("_new").isNotNull(), F.col("_new")[name]).otherwise(F.col("_old")[name])

            return both.select(*[value(c).alias(c) for c in schema.names])

        return _change(spark, root, folder, changes, rewrite, rows_per_file, insert)


def delete_rows(spark: SparkSession, root: str, keys_gone: DataFrame, rows_per_file: int = 1_000_000) -> int:
    """Write a version without the rows of these keys."""
    root = root.rstrip("/")
    _, keys = _described(spark, root)
    with scratch(spark, "delete") as folder:
        gone = materialise(keys_gone.select(*[F.col(f"`{k}`") for k in keys]).distinct(), "changes", f"{folder}/changes")

        def rewrite(old, schema, keys):
            return old.withColumn("_k", _key(keys)).join(gone.select(_key(keys).alias("_k")).hint("merge"), "_k", "left_anti")

        return _change(spark, root, folder, gone, rewrite, rows_per_file, adds=False)


def compact_table(spark: SparkSession, root: str, rows_per_file: int = 1_000_000) -> int:
    """Write a version in which files of less than half of ``rows_per_file``, as many small changes leave them, are put together."""
    root = root.rstrip("/")
    version = latest_version(spark, root)
    schema, keys = _described(spark, root)
    now = manifest(spark, root, version)
    small = [r["file"] for r in now.filter(F.col("rows") * 2 < rows_per_file).select("file").collect()]  # a row per file
    if len(small) < 2:
        return version
    with scratch(spark, "compact") as folder:
        rows = materialise(_rows(spark, schema, small), "fresh", f"{folder}/fresh")
        kept = now.join(spark.createDataFrame([(f,) for f in small], "file string"), "file", "left_anti").select(*now.columns)
        return _publish(kept.unionByName(_write_files(rows, root, keys, -(-rows.count() // rows_per_file), folder)), root, version + 1)


def restore_version(spark: SparkSession, root: str, version: int) -> int:
    """Make an older version the latest one again; only a manifest is written."""
    root = root.rstrip("/")
    return _publish(manifest(spark, root, version), root, latest_version(spark, root) + 1)
