"""Row numbers over a whole table without gathering it in one task.

``row_number()`` over an unpartitioned window sends every row to a single task. Here the rows are written once in key order (see
``pages``); a row's number is its place in its file plus the rows of the files before. For more than one page of a table write it
once with ``pages.write_ordered``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import fresh_path
from .pages import file_counts, part_number, write_rows


def number_rows(df: DataFrame, key_columns, ranges: int | None = None) -> DataFrame:
    """Add ``row_no`` 1..n in key order, NULLs first; equal keys come in any order. Keys may be columns such as ``F.desc("x")``.

    The rows lie in ``ranges`` files (by their number if not given).
    """
    keys = [F.col(k) if isinstance(k, str) else k for k in key_columns]
    rows = write_rows(df, fresh_path(df.sparkSession, "ordered"), keys, ranges)
    starts = file_counts(rows).select("part", "before")
    # Two numbers per file, so this side is small.
    return (rows.withColumn("part", part_number()).withColumn("_place", F.col("_metadata.row_index")).join(F.broadcast(starts), "part")
            .withColumn("row_no", F.col("before") + F.col("_place") + 1).drop("part", "before", "_place"))


def page(df: DataFrame, key_columns, size: int, index: int, ranges: int | None = None) -> DataFrame:
    """Slice ``index`` of ``ceil(n / size)`` slices in key order. Sorts the table: see ``pages`` for pages of a table kept in order."""
    numbered = number_rows(df, key_columns, ranges)
    total = numbered.count()
    return (numbered.filter(F.col("row_no").between(index * size + 1, (index + 1) * size))
            .withColumn("total_count", F.lit(total).cast("long"))
            .withColumn("chunk_count", F.lit(-(-total // size)).cast("long")))


def sorted_page(df: DataFrame, order_by, size: int, index: int) -> DataFrame:
    """A page for display, in order. No task and no driver holds the rows before it."""
    return page(df, order_by, size, index).orderBy("row_no").drop("row_no", "total_count", "chunk_count")


def _beyond(key_columns, after) -> Column:
    out = F.lit(False)
    for name, value in reversed(list(zip(key_columns, after))):
        col = F.col(name)
        more = col.isNotNull() if value is None else F.coalesce(col > F.lit(value), F.lit(False))
        out = more | (col.eqNullSafe(F.lit(value)) & out)
    return out


def page_after(df: DataFrame, key_columns, size: int, after=None) -> DataFrame:
    """The next ``size`` rows in ascending key order after the key ``after`` (None: the first ones), NULLs first.

    Nothing is written, and each task keeps ``size`` rows. Keys should be unique: rows equal to ``after`` are passed over.
    """
    rows = df if after is None else df.filter(_beyond(key_columns, after))
    return rows.orderBy(*key_columns).limit(size)
