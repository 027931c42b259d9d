"""Writing: plain Spark writers, new versions instead of overwrites, append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_json(df: DataFrame, path: str, append: bool = False) -> str:
    """JSON lines; appending adds files and rewrites nothing."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)
    return path


def write_report(report: DataFrame, path: str) -> str:
    """A one-row report as JSON."""
    report.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return path


def append_log(df: DataFrame, path: str, partition_by: str | None = None) -> str:
    """Append to a parquet log (profiles by table_name, audit rows, run states, cache entries)."""
    writer = df.write.mode("append")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return path


def last_updates(updates: DataFrame, keys: list[str], order=None) -> DataFrame:
    """One update per key: the last by ``order`` (column names), the greatest content among equals. Combined before the shuffle."""
    row = F.struct(*[F.col(f"`{c}`") for c in updates.columns])
    by = F.struct(*[F.col(c) for c in ([order] if isinstance(order, str) else order or [])], F.to_json(row).alias("_content"))
    return (updates.groupBy(*[F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(keys)]).agg(F.max_by(row, by).alias("_row"))
            .select("_row.*"))


def upsert(base: DataFrame, updates: DataFrame, key, order=None) -> DataFrame:
    """Rows of ``base`` replaced by, or extended with, those of ``updates``, by key.

    Of several updates of a key the last by ``order`` (column names) counts. Write the result to a new path: the one being read
    must not be overwritten. ``versions.upsert_table`` rewrites only the files that hold a changed key.
    """
    keys = [key] if isinstance(key, str) else list(key)
    updates = last_updates(updates, keys, order).select(*base.columns)
    return base.join(updates.select(*keys), keys, "left_anti").unionByName(updates)


def write_version(df: DataFrame, root: str, version: str) -> str:
    """A complete new version of a table under its own directory; fails if it exists."""
    path = f"{root.rstrip('/')}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def write_profiles(profiles: DataFrame, path: str, table_name: str, ts) -> str:
    """Profile history: one row per table, column and time."""
    return append_log(profiles.withColumn("ts", F.lit(ts).cast("timestamp")).withColumn("table_name", F.lit(table_name)),
                      path, "table_name")


def audit_rows(df: DataFrame, kind: str, run_id: str, at, item_id: str = "record_id") -> DataFrame:
    """Rows of the audit log: kind is SNAPSHOT, CORRECTION or FEEDBACK."""
    return df.select(F.lit(run_id).alias("run_id"), F.lit(kind).alias("kind"),
                     F.col(item_id).cast("string").alias("item_id"),
                     F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
                     .alias("data"), F.lit(at).cast("timestamp").alias("created_at"))
