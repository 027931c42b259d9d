"""Reading parts of a table: columns, a head, a time range, a filter, the newest state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def project(df: DataFrame, columns) -> DataFrame:
    """Just these columns, in this order; one the table lacks is NULL instead of an error."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def head_sample(df: DataFrame, n: int = 100, key=None) -> DataFrame:
    """The first n rows; with a key, the n lowest, the same ones on every run."""
    return df.orderBy(key).limit(n) if key is not None else df.limit(n)


def changed_between(df: DataFrame, ts: str, since, until) -> DataFrame:
    """Rows modified in [since, until): a predicate the scan can use to skip files."""
    col, kind = F.col(ts), dict(df.dtypes)[ts]
    return df.filter((col >= F.lit(since).cast(kind)) & (col < F.lit(until).cast(kind)))


def filtered_scan(df: DataFrame, condition: Column | str, columns=None, max_rows: int | None = None) -> DataFrame:
    """Filter (and projection) evaluated by the scan."""
    out = df.filter(condition)
    out = out.select(*columns) if columns else out
    return out.limit(max_rows) if max_rows is not None else out


def display_order(df: DataFrame, priority) -> DataFrame:
    """Preferred columns first, the rest by name."""
    first = [c for c in priority if c in df.columns]
    return df.select(*first, *sorted(set(df.columns) - set(first)))


def latest_state(log: DataFrame, key, order) -> DataFrame:
    """Newest row per key of an append-only log; ``max_by`` is combined map-side."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in log.columns if c not in keys]
    order = F.struct(*order) if isinstance(order, (list, tuple)) else F.col(order)
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("s")).select(*keys, "s.*")
