"""Column profiles, their history, and what changed between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import cells
from ..plans.checks import Table

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def value_counts(df: DataFrame, columns=None) -> DataFrame:
    """(pos, whole, real, text, n): how often each value of each column occurs, NULLs included.

    One pass over the table. Values keep their own type until they are counted, so numbers are
    not printed per row, and counting is combined map-side, so a value that fills a third of
    the table is one row per task before the shuffle.
    """
    columns = list(columns or df.columns)
    table = Table(df.schema)
    rows = []
    for pos, name in enumerate(columns):
        dtype, col = table.dtype(name), table.col(name)
        whole = col.cast("long") if isinstance(dtype, _WHOLE) else F.lit(None).cast("long")
        # + 0.0 folds -0.0 into 0.0
        real = (col.cast("double") + F.lit(0.0)) if isinstance(dtype, (T.DoubleType, T.FloatType)) \
            else F.lit(None).cast("double")
        text = F.lit(None).cast("string") if isinstance(dtype, (*_WHOLE, T.DoubleType, T.FloatType)) \
            else table.text(name)
        rows.append(F.struct(F.lit(pos).alias("pos"), whole.alias("whole"), real.alias("real"), text.alias("text")))
    return (df.select(F.inline(F.array(*rows))).groupBy("pos", "whole", "real", "text")
            .agg(F.count("*").alias("n")))


def _present() -> Column:
    return F.col("whole").isNotNull() | F.col("real").isNotNull() | F.col("text").isNotNull()


def _value_text() -> Column:
    return F.coalesce(F.col("text"), F.col("whole").cast("string"), cells.float_text(F.col("real")))


def _name_of(columns) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("pos") + 1)


def top_values(df: DataFrame, columns=None, n: int = 10, counts: DataFrame | None = None) -> DataFrame:
    """The n most frequent values per column; ties by value text.

    ``row_number() <= n`` is applied before the shuffle too (window group limit), so a column
    with billions of distinct values sends n rows per task.
    """
    columns = list(columns or df.columns)
    counted = (counts if counts is not None else value_counts(df, columns)).filter(_present())
    by = Window.partitionBy("pos").orderBy(F.desc("n"), F.col("value"))
    return (counted.select("pos", _value_text().alias("value"), "n")
            .withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= n)
            .select(_name_of(columns).alias("column_name"), "rank", "value", "n"))


def _column_stats(df: DataFrame, columns, approx: bool, group: str | None) -> DataFrame:
    """One aggregate over the table, turned into one row per column."""
    table = Table(df.schema)
    # Reading a text as a number is dear, and five aggregates need it: once per row, below them.
    read = {f"_n{i}": cells.to_number(table.col(c), table.dtype(c)) for i, c in enumerate(columns)
            if isinstance(table.dtype(c), T.StringType)}
    df = df.withColumns(read) if read else df
    aggs, rows = [], []
    for i, name in enumerate(columns):
        dtype, col = table.dtype(name), table.col(name)
        number = F.col(f"_n{i}") if f"_n{i}" in read else cells.to_number(col, dtype)
        numeric = cells.is_numeric(dtype) or isinstance(dtype, (T.StringType, T.BooleanType))
        aggs.append(F.count(col).alias(f"p{i}"))
        if numeric:
            aggs += [F.min(number).alias(f"lo{i}"), F.max(number).alias(f"hi{i}"),
                     F.avg(number).alias(f"m{i}"), F.stddev_pop(number).alias(f"d{i}"),
                     F.count(number).alias(f"k{i}")]
        if not cells.is_numeric(dtype):
            # Times sort like their text, and are printed once, not per row.
            text = col if isinstance(dtype, _TIMES) else table.text(name)
            aggs += [F.min(text).alias(f"tlo{i}"), F.max(text).alias(f"thi{i}")]
        if approx:
            aggs.append(F.approx_count_distinct(col, 0.02).alias(f"u{i}"))
        lo, hi = (F.col(f"{x}{i}") if numeric else F.lit(None).cast("double") for x in ("lo", "hi"))
        tlo, thi = (F.lit(None).cast("string") if cells.is_numeric(dtype) else F.col(f"{x}{i}").cast("string") for x in ("tlo", "thi"))
        rows.append(F.struct(
            F.lit(i).alias("pos"), F.lit(name).alias("column_name"), F.col("total").alias("total_count"),
            F.col(f"p{i}").alias("present"), lo.alias("lo"), hi.alias("hi"), tlo.alias("tlo"), thi.alias("thi"),
            (F.round(F.col(f"m{i}"), 4) if numeric else F.lit(None).cast("double")).alias("mean_value"),
            (F.when(F.col(f"k{i}") >= 2, F.round(F.col(f"d{i}"), 4)) if numeric
             else F.lit(None).cast("double")).alias("stddev_value"),
            *([F.col(f"u{i}").alias("unique_count")] if approx else [])))
    grouped = df.groupBy(group) if group else df
    keep = [group] if group else []
    # Text bounds only when nothing reads as a number. Numbers are printed once per column, after the rows are made.
    return (grouped.agg(F.count("*").alias("total"), *aggs).select(*keep, F.inline(F.array(*rows)))
            .withColumn("min_value", F.coalesce(cells.float_text(F.col("lo")), F.col("tlo")))
            .withColumn("max_value", F.coalesce(cells.float_text(F.col("hi")), F.col("thi"))).drop("lo", "hi", "tlo", "thi"))


def _rates(stats: DataFrame, keep=()) -> DataFrame:
    nulls = F.col("total_count") - F.col("present")
    return stats.select(
        *keep, "column_name", "total_count", nulls.alias("null_count"),
        F.when(F.col("total_count") > 0, F.round(nulls / F.col("total_count"), 6)).otherwise(0.0).alias("null_rate"),
        F.coalesce("unique_count", F.lit(0)).cast("long").alias("unique_count"),
        F.when(F.col("present") > 0, F.round(F.coalesce("unique_count", F.lit(0)) / F.col("present"), 6))
        .otherwise(0.0).alias("uniqueness_rate"),
        "min_value", "max_value", "mean_value", "stddev_value",
        *([c for c in ("top_values",) if c in stats.columns]))


def profile_columns(df: DataFrame, columns=None, approx: bool = False, top_n: int = 0) -> DataFrame:
    """One row per column: counts, null rate, distinct values, bounds, mean, deviation, top values.

    Numbers come from one aggregate. Exact distinct counts (and top values) come from
    ``value_counts``; ``approx=True`` replaces the former by a sketch inside the same aggregate
    and so needs no second pass.
    """
    columns = list(columns or df.columns)
    stats = _column_stats(df, columns, approx, None)
    counts = None
    if not approx:
        counts = value_counts(df, columns)
        distinct = counts.filter(_present()).groupBy("pos").agg(F.count("*").alias("unique_count"))
        stats = stats.join(F.broadcast(distinct), "pos", "left")  # one row per column
    if top_n:
        pairs = (top_values(df, columns, top_n, counts)
                 .groupBy("column_name")  # at most top_n rows per column
                 .agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "value", "n"))),
                                  lambda x: F.struct(x["value"].alias("value"), x["n"].alias("count")))
                      .alias("top_values")))
        stats = stats.join(F.broadcast(pairs), "column_name", "left")
    return _rates(stats)


def profile_groups(df: DataFrame, group: str, columns) -> DataFrame:
    """Profiles per group value (one per day, say) with sketch-based distinct counts: one shuffle."""
    return _rates(_column_stats(df, list(columns), True, group), [group])


def key_presence(records: DataFrame, column: str = "v", top_n: int = 5) -> DataFrame:
    """Per key of raw JSON records (a variant column): rows that have it, those where it is null, distinct and top values.

    A DataFrame cannot tell a missing key from a null one, so this reads the records themselves. Values are counted
    map-side first, and of the counts ``top_n`` per key leave each task.
    """
    cells = F.explode(F.try_variant_get(F.col(column), "$", "map<string,variant>")).alias("column_name", "cell")
    counted = (records.select(cells).select("column_name", F.try_variant_get("cell", "$", "string").alias("value"))
               .groupBy("column_name", "value").agg(F.count("*").alias("n")))
    stats = counted.groupBy("column_name").agg(
        F.sum("n").alias("total_count"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        F.count("value").alias("distinct_count"))
    by = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    top = (counted.filter(F.col("value").isNotNull()).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top_n)
           .groupBy("column_name")  # at most top_n rows per key
           .agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "value", "n"))),
                            lambda x: F.struct(x["value"].alias("value"), x["n"].alias("count"))).alias("top_values")))
    return (stats.join(top, "column_name", "left")
            .withColumn("null_rate", F.round(F.col("null_count") / F.col("total_count"), 6)))


def condition_counts(df: DataFrame, targets: list[dict]) -> DataFrame:
    """Rows matching each textual condition, all conditions in one pass."""
    from ..plans.conditions import condition_column

    targets = [t for t in targets if t.get("condition") and t.get("columns")]
    aggs = [F.count_if(condition_column(t["condition"], df.schema, t["columns"])).alias(f"n{i}")
            for i, t in enumerate(targets)]
    rows = [F.struct(F.lit(t["condition"]).alias("condition"), F.lit(t.get("description", "")).alias("description"),
                     F.col(f"n{i}").alias("match_count")) for i, t in enumerate(targets)]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


# --- history ---------------------------------------------------------------

def history_window(history: DataFrame, table_name: str, column_name: str, as_of, days: int = 30) -> DataFrame:
    """Profiles of one column over the last days, oldest first."""
    since = F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days))
    return (history.filter((F.col("table_name") == table_name) & (F.col("column_name") == column_name)
                           & (F.col("ts") >= since))
            .orderBy("ts"))


def profile_change(history: DataFrame, null_rate_above: float = 0.05, unique_ratio_above: float = 0.2) -> DataFrame:
    """Latest profile of each column against the one before it.

    Only the two newest rows of a column leave each task (window group limit).
    """
    newest = Window.partitionBy("table_name", "column_name").orderBy(F.desc("ts"))
    two = history.withColumn("rn", F.row_number().over(newest)).filter("rn <= 2")

    def pick(name, rn):
        return F.max(F.when(F.col("rn") == rn, F.col(name)))

    pair = two.groupBy("table_name", "column_name").agg(
        pick("ts", 1).alias("ts"),
        pick("null_rate", 1).alias("null_rate"), pick("null_rate", 2).alias("prev_null_rate"),
        pick("unique_count", 1).alias("unique_count"), pick("unique_count", 2).alias("prev_unique_count"))
    null_shift = F.abs(F.col("null_rate") - F.col("prev_null_rate"))
    unique_shift = (F.abs(F.col("unique_count") - F.col("prev_unique_count"))
                    / F.greatest("prev_unique_count", F.lit(1)))
    kind = F.when(null_shift > null_rate_above, "null_rate").when(unique_shift > unique_ratio_above, "unique_count")
    return pair.select("*", F.coalesce(kind, F.lit("none")).alias("change"),
                       kind.isNotNull().alias("changed"))


METRICS = ("null_rate", "unique_count", "mean_value")


def profile_anomalies(history: DataFrame, current: DataFrame, warn: float = 20.0, critical: float = 50.0,
                      metrics=METRICS) -> DataFrame:
    """Current metrics against their historical average, as deviation in percent."""
    keys = ["table_name", "column_name"]
    past = history.groupBy(*keys).agg(*[F.avg(m).alias(f"avg_{m}") for m in metrics])
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("current_value"),
                              F.col(f"avg_{m}").alias("historical_avg")) for m in metrics])
    dev = F.when(F.col("historical_avg") != 0,
                 (F.col("current_value") - F.col("historical_avg")) / F.abs("historical_avg") * 100) \
        .when(F.col("current_value") == 0, 0.0).otherwise(100.0)
    return (current.join(past, keys).select(*keys, F.inline(rows))
            .filter(F.col("current_value").isNotNull() & F.col("historical_avg").isNotNull())
            .withColumn("deviation_pct", dev)
            .withColumn("severity", F.when(F.abs("deviation_pct") >= critical, "critical")
                        .when(F.abs("deviation_pct") >= warn, "warning").otherwise("info")))


def freshness(df: DataFrame, ts: str, as_of, max_age_days: int, by: str | None = None) -> DataFrame:
    """Newest time seen, and whether it is recent enough."""
    grouped = df.groupBy(by) if by else df
    limit = F.lit(as_of).cast("timestamp_ntz") - F.make_interval(days=F.lit(max_age_days))
    return (grouped.agg(F.max(F.col(ts).cast("timestamp_ntz")).alias("last_ts"))
            .withColumn("freshness_ok", F.coalesce(F.col("last_ts") >= limit, F.lit(False))))


def completeness(df: DataFrame, columns=None, max_null_rate: float = 0.05) -> DataFrame:
    """Null rate of each column against a limit; one aggregate."""
    columns = list(columns or df.columns)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("null_count"))
                     for i, c in enumerate(columns)])
    return (df.agg(F.count("*").alias("total_count"),
                   *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(columns)])
            .select("total_count", F.inline(rows))
            .withColumn("null_rate", F.when(F.col("total_count") > 0,
                                            F.round(F.col("null_count") / F.col("total_count"), 6)).otherwise(0.0))
            .withColumn("completeness_ok", F.col("null_rate") <= max_null_rate))
