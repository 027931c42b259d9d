"""Reviewer decisions, cell corrections, audit rows, quarantine, rollback.

Nothing is changed without an approval row. Every function returns a new frame; writing a new
version of the table is left to ``sinks``.

Approved items and cells are joined to the whole table. Pass them written and read back
(``session.materialise``): Spark then knows their true size and broadcasts them only if they
are small, so that the table itself need not be shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.cells import is_numeric, to_number
from ..plans.checks import Table
from .reconcile import KEYS


def approved(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """Queue rows a reviewer approved, with who and when.

    ``decisions`` has record_id, action (approved / rejected), reviewer, decided_at; the newest
    decision about a record counts.
    """
    last = decisions.groupBy("record_id").agg(
        F.max_by(F.struct("action", "reviewer", "decided_at"), "decided_at").alias("d"))
    yes = last.filter(F.col("d.action") == "approved").select(
        "record_id", F.col("d.reviewer").alias("approved_by"), F.col("d.decided_at").alias("approved_at"))
    return queue.join(yes, "record_id")


def approved_all(queue: DataFrame, reviewer: str, decided_at) -> DataFrame:
    """The whole queue approved at once."""
    return queue.withColumn("approved_by", F.lit(reviewer)).withColumn(
        "approved_at", F.lit(decided_at).cast("timestamp"))


def feedback(judgments: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row per confirmed error that a reviewer rejected."""
    last = decisions.groupBy("record_id").agg(F.max_by(F.struct("action", "reason"), "decided_at").alias("d"))
    no = last.filter(F.col("d.action") == "rejected").select("record_id", F.col("d.reason").alias("rejection_reason"))
    return (judgments.filter("is_error").join(no, "record_id")
            .select(*KEYS, F.lit("rejected").alias("reviewer_action"),
                    F.coalesce("rejection_reason", F.lit("Reviewer rejected")).alias("rejection_reason")))


def correction_cells(items: DataFrame) -> DataFrame:
    """(record_id, rule_id, column_name, value) of every proposed cell.

    Three spellings are understood: a map of columns, a map holding just ``column`` and
    ``value``, and the flat fields correction_column / correction_value.
    """
    fix = F.col("suggested_correction")
    single = F.array(F.struct(F.try_element_at(fix, F.lit("column")).alias("key"),
                              F.try_element_at(fix, F.lit("value")).alias("value")))
    flat = F.array().cast("array<struct<key:string,value:string>>")
    if "correction_column" in items.columns:
        flat = F.when(F.coalesce("correction_column", F.lit("")) != "", F.array(F.struct(
            F.col("correction_column").alias("key"), F.col("correction_value").cast("string").alias("value"))))
    both = F.map_contains_key(fix, F.lit("column")) & F.map_contains_key(fix, F.lit("value"))
    pairs = F.when(fix.isNull() | (F.size(fix) == 0), flat).when(both, single).otherwise(F.map_entries(fix))
    extra = [c for c in ("confidence", "impact_score", "approved_by", "approved_at") if c in items.columns]
    return (items.select(*KEYS, *extra, F.explode(pairs).alias("cell"))
            .select(*KEYS, *extra, F.col("cell.key").alias("column_name"), F.col("cell.value").alias("value"))
            .filter((F.coalesce("record_id", F.lit("")) != "") & (F.coalesce("column_name", F.lit("")) != "")))


def _typed(text: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return text
    if isinstance(dtype, T.BooleanType):
        return F.lower(text).isin("true", "1")
    if is_numeric(dtype):
        return to_number(text, T.StringType()).try_cast(dtype)
    return text.try_cast(dtype)


def _winners(cells: DataFrame) -> DataFrame:
    """One row per cell: when several rules propose a value the highest rule id wins."""
    rest = [c for c in cells.columns if c not in ("record_id", "column_name")]
    return cells.groupBy("record_id", "column_name").agg(F.max_by(F.struct(*rest), "rule_id").alias("c"))


def apply_corrections(df: DataFrame, cells: DataFrame, key: str = "record_id") -> DataFrame:
    """The table with approved cells replaced; a value that does not fit the column is left out."""
    columns = [c for c in df.columns if c != key]
    table = Table(df.schema)
    # A map per record, with at most as many entries as the table has columns.
    fixes = (_winners(cells.filter(F.col("column_name").isin(columns)))
             .groupBy(F.col("record_id").alias("_rid"))
             .agg(F.map_from_entries(F.collect_list(F.struct("column_name", "c.value"))).alias("_fix")))
    joined = df.join(fixes, F.col(f"`{key}`").cast("string") == F.col("_rid"), "left")

    def cell(name):
        proposed = F.try_element_at(F.col("_fix"), F.lit(name))
        typed = _typed(proposed, table.dtype(name))
        usable = F.map_contains_key(F.col("_fix"), F.lit(name)) & (typed.isNotNull() | proposed.isNull())
        return F.when(usable, typed).otherwise(F.col(f"`{name}`")).alias(name)

    return joined.select(F.col(f"`{key}`"), *[cell(c) for c in columns]).select(*df.columns)


def correction_log(df: DataFrame, cells: DataFrame, run_id: str, key: str = "record_id") -> DataFrame:
    """One audit row per corrected cell with the value the source really held."""
    table = Table(df.schema)
    columns = [c for c in df.columns if c != key]
    old = F.coalesce(*[F.when(F.col("column_name") == c, table.text(c)) for c in columns])
    fits = F.lit(False)
    for c in columns:
        typed = _typed(F.col("c.value"), table.dtype(c))
        fits = fits | ((F.col("column_name") == c) & (typed.isNotNull() | F.col("c.value").isNull()))
    return (_winners(cells).withColumnRenamed("record_id", "_rid")
            .join(df, F.col(f"`{key}`").cast("string") == F.col("_rid"))
            .select(F.lit(run_id).alias("run_id"), F.col("_rid").alias("record_id"), "column_name",
                    old.alias("original_value"), F.col("c.value").alias("corrected_value"),
                    F.when(fits, "success").otherwise("failed").alias("status"), F.col("c.rule_id").alias("rule_id")))


def snapshot(df: DataFrame, items: DataFrame, key: str = "record_id") -> DataFrame:
    """The source rows that are about to change, as they are now."""
    ids = items.select(F.col("record_id").alias("_rid"))
    return df.join(ids, F.col(f"`{key}`").cast("string") == F.col("_rid"), "left_semi")


def rollback(df: DataFrame, saved: DataFrame, key: str = "record_id") -> DataFrame:
    """Put the saved rows back."""
    return df.join(saved.select(key), key, "left_anti").unionByName(saved.select(*df.columns))


def quarantine(df: DataFrame, items: DataFrame, run_id: str, reason: str, at, key: str = "record_id") -> DataFrame:
    """Quarantine rows: the whole source row as JSON, with run, reason and time."""
    rows = snapshot(df, items, key)
    return rows.select(F.col(f"`{key}`").cast("string").alias("record_id"),
                       F.lit(at).cast("timestamp").alias("quarantined_at"), F.lit(run_id).alias("run_id"),
                       F.lit(reason).alias("reason"),
                       F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
                       .alias("original_data"), F.lit("quarantined").alias("status"))


def split_quarantined(df: DataFrame, items: DataFrame, key: str = "record_id") -> tuple[DataFrame, DataFrame]:
    """(clean rows, quarantined rows)."""
    ids = items.select(F.col("record_id").alias("_rid"))
    same = F.col(f"`{key}`").cast("string") == F.col("_rid")
    return df.join(ids, same, "left_anti"), df.join(ids, same, "left_semi")


def flag_quarantined(df: DataFrame, items: DataFrame, reason: str, at, key: str = "record_id") -> DataFrame:
    """The table with quarantine marks; rows stay where they are."""
    ids = items.select(F.col("record_id").alias("_rid")).distinct()
    hit = F.col("_rid").isNotNull()
    return (df.join(ids, F.col(f"`{key}`").cast("string") == F.col("_rid"), "left")
            .withColumn("_quarantined", hit)
            .withColumn("_quarantined_at", F.when(hit, F.lit(at).cast("timestamp")))
            .withColumn("_quarantine_reason", F.when(hit, F.lit(reason))).drop("_rid"))
