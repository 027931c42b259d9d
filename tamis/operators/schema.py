"""Schema inference, fingerprints, and finding the column that identifies a record."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions import cells
from ..plans.rules import Rule, rules_df, rules_from_df
from .profile import _name_of, _present, value_counts

# Name parts that mark a time column.
DATETIME_HINTS = ("time", "timestamp", "date", "at", "created", "updated")

# Name parts that mark a column as a likely key.
KEY_HINTS = ("id", "번호", "코드")


def _hinted(name: str, substring: bool) -> bool:
    name = name.lower()
    if substring:  # also takes "status" and "category" for times
        return any(h in name for h in DATETIME_HINTS)
    return bool(set(re.split(r"[^a-z0-9]+", name)) & set(DATETIME_HINTS))


def _declared(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if cells.is_numeric(dtype):
        return "float"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "string"


def infer_schema(df: DataFrame, substring_hints: bool = True, untyped: bool = False) -> DataFrame:
    """One row per column: name, data type, nullable, rows seen; one aggregate over the table.

    Declared types decide. ``untyped=True`` is for text input (CSV): the widest reading of all
    present cells decides, rather than whichever cell happens to come first.
    """
    aggs, rows = [F.count("*").alias("total")], []
    for i, f in enumerate(df.schema.fields):
        col = F.col(f"`{f.name}`")
        if untyped and isinstance(f.dataType, T.StringType):
            kind = cells.csv_cell_type(col)
            col = F.when(kind != "null", col)
            aggs += [F.count_if(kind == "string").alias(f"s{i}"), F.count_if(kind == "float").alias(f"f{i}")]
            dtype = (F.when((F.col(f"s{i}") > 0) | (F.col(f"p{i}") == 0), "string")
                     .when(F.col(f"f{i}") > 0, "float").otherwise("integer"))
        else:
            dtype = F.when(F.col(f"p{i}") == 0, "string").otherwise(_declared(f.dataType))
        aggs.append(F.count(col).alias(f"p{i}"))
        if _hinted(f.name, substring_hints):
            dtype = F.lit("datetime")
        rows.append(F.struct(F.lit(f.name).alias("column_name"), dtype.alias("data_type"),
                             (F.col(f"p{i}") < F.col("total")).alias("nullable"), F.col("total").alias("sample_count")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def schema_fingerprint(inferred: DataFrame) -> DataFrame:
    """First 16 hex digits of SHA-256 over the sorted (name, type) pairs, nullability left out."""
    pairs = F.sort_array(F.collect_list(F.struct("column_name", "data_type")))  # one pair per column
    quoted = F.transform(pairs, lambda p: F.concat(F.lit('["'), p["column_name"], F.lit('", "'), p["data_type"],
                                                   F.lit('"]')))
    raw = F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))
    return inferred.agg(F.substring(F.sha2(raw, 256), 1, 16).alias("fingerprint"),
                        F.count("*").alias("column_count"))


def cached_rules(cache: DataFrame, fingerprint: Column | str, as_of, ttl_seconds: int = 3600) -> DataFrame:
    """Rule sets stored for a schema fingerprint, while no older than the time to live."""
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col("cached_at"))
    key = F.lit(fingerprint) if isinstance(fingerprint, str) else fingerprint
    return cache.filter((F.col("fingerprint") == key) & (age <= ttl_seconds))


def rule_cache_entries(spark: SparkSession, rules, fingerprint: str, written_at) -> DataFrame:
    """A rule set as rows to append to the cache, under the fingerprint of the schema it was made for."""
    return (rules_df(spark, rules).withColumn("fingerprint", F.lit(fingerprint))
            .withColumn("cached_at", F.lit(written_at).cast("timestamp")))


def newest_rules(cache: DataFrame, fingerprint: str, as_of, ttl_seconds: int = 3600) -> list[Rule] | None:
    """The rule set stored last for a schema fingerprint; None if there is none, or only older ones."""
    live = cached_rules(cache, fingerprint, as_of, ttl_seconds)
    newest = live.agg(F.max("cached_at").alias("t")).head()["t"]
    return None if newest is None else rules_from_df(live.filter(F.col("cached_at") == F.lit(newest)))


def key_candidates(df: DataFrame, columns=None) -> DataFrame:
    """Rows, present and distinct values per column, in the order a record key is looked for.

    priority 0: a column called record_id (nothing to map), 1: id, 2: name mentions an id,
    3: any other column. A key must be unique and never missing.
    """
    columns = list(columns or df.columns)
    counted = (value_counts(df, columns).withColumn("here", _present())
               .groupBy("pos").agg(F.sum("n").alias("row_count"),
                                   F.sum(F.when(F.col("here"), F.col("n")).otherwise(0)).alias("present_count"),
                                   F.count_if("here").alias("distinct_count")))
    lower = F.lower("column_name")
    hint = reduce(Column.__or__, [lower.contains(part) for part in KEY_HINTS])
    unique = (F.col("distinct_count") == F.col("row_count")) & (F.col("present_count") == F.col("row_count"))
    return (counted.withColumn("column_name", _name_of(columns))
            .withColumn("priority", F.when(lower == "record_id", 0).when(lower == "id", 1).when(hint, 2).otherwise(3))
            .withColumn("is_unique", unique)
            .select("pos", "column_name", "priority", "row_count", "present_count", "distinct_count", "is_unique"))


def rank_keys(df: DataFrame, columns=None) -> DataFrame:
    """``key_candidates`` with the chosen column marked (one row per column, so one small window). Counts the values of every column."""
    cand = key_candidates(df, columns)
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("usable"), "priority", "pos")
    named = F.max(F.col("priority") == 0).over(Window.partitionBy(F.lit(1)))
    return (cand.withColumn("usable", F.col("is_unique") & (F.col("priority") > 0))
            .withColumn("is_key", (F.row_number().over(order) == 1) & F.col("usable") & ~named)
            .drop("usable", "pos"))


def _priority(name: str) -> int:
    name = name.lower()
    return 0 if name == "record_id" else 1 if name == "id" else 2 if any(part in name for part in KEY_HINTS) else 3


def _sketched(df: DataFrame, columns):
    """(rows, present values per column, the columns that may be unique).

    One aggregate with sketches rules out columns with missing or clearly repeated values (the sketch errs by 2 %, a
    tenth is allowed).
    """
    seen = df.agg(F.count("*").alias("rows"), *[F.count(F.col(f"`{c}`")).alias(f"p{i}") for i, c in enumerate(columns)],
                  *[F.approx_count_distinct(F.col(f"`{c}`"), 0.02).alias(f"u{i}") for i, c in enumerate(columns)]).head()
    open_ = [i for i in range(len(columns)) if seen[f"p{i}"] == seen["rows"] > 0 and seen[f"u{i}"] >= 0.9 * seen["rows"]]
    return seen["rows"], [seen[f"p{i}"] for i in range(len(columns))], sorted(open_, key=lambda i: (_priority(columns[i]), i))


def _unique(df: DataFrame, column: str) -> bool:
    """Exactly, by a shuffle of this column alone."""
    return df.groupBy(F.col(f"`{column}`").alias("value")).agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def detect_key(df: DataFrame, columns=None) -> DataFrame:
    """Per column: priority, rows, present and different values, whether it is unique, and whether it is the key. All are counted exactly."""
    return rank_keys(df, columns)


def find_key(df: DataFrame, columns=None) -> str | None:
    """The column ``detect_key`` marks: open columns are tested in the order of preference until one is unique."""
    columns = list(columns or df.columns)
    if not all(_priority(c) for c in columns):
        return None
    return next((columns[i] for i in _sketched(df, columns)[2] if _unique(df, columns[i])), None)


def with_record_id(df: DataFrame, key: str | None) -> DataFrame:
    """Copy the key column to record_id; a table that has one already stays as it is."""
    return df if key is None else df.withColumn("record_id", F.col(f"`{key}`"))
