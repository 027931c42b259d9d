"""Profiles that can be merged, and frequent values without counting every value.

``profile_state`` is one aggregate over a table: counts, bounds, mean and sum of squared deviations of each column, and Spark's own sketches of its
distinct values (HyperLogLog), of its numbers (KLL quantiles) and, if asked, of its frequent values. States are rows with binary columns: kept in the
history, they merge over days and partitions, so appended data are profiled alone and the whole table is not read again. Counts, bounds, mean
and deviation of a merged profile are those of the whole; distinct counts and quantiles carry the sketches' errors (``DISTINCT_ERROR`` and
``RANK_ERROR`` are three standard errors).

``heavy_hitters`` finds all values that fill at least a share of a column's rows: a frequent-items sketch, which has bounded size whatever the number of
distinct values, names the candidates, and a second aggregate counts them exactly. No value is shuffled but the candidates.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import cells
from ..plans.checks import Table
from .profile import _TIMES, _rates

LOG_BUCKETS, KLL_K = 14, 400
DISTINCT_ERROR = 3 * 1.04 / math.sqrt(1 << LOG_BUCKETS)  # relative, of the distinct count
RANK_ERROR = 0.02  # of the rows, of a quantile's place

STATE = ("pos int, column_name string, total_count long, present long, number_count long, lo double, hi double, tlo string, thi string, mean double, "
         "m2 double, distinct binary, numbers binary, frequent struct<sketch:binary,maxItemsTracked:int,itemDataType:string,itemDataTypeDDL:string>")


def profile_state(df: DataFrame, columns=None, frequent: int = 0) -> DataFrame:
    """A row per column, in one aggregate. ``frequent``: how many values a sketch of frequent values tracks (0: none)."""
    columns, table = list(columns or df.columns), Table(df.schema)
    reads = {f"_n{i}": cells.to_number(table.col(c), table.dtype(c)) for i, c in enumerate(columns) if isinstance(table.dtype(c), T.StringType)}
    df = df.withColumns(reads) if reads else df
    aggs, rows, kinds = [], [], {f.name: f.dataType for f in T.StructType.fromDDL(STATE)}
    for i, name in enumerate(columns):
        dtype, col = table.dtype(name), table.col(name)
        number = F.col(f"_n{i}") if f"_n{i}" in reads else cells.to_number(col, dtype)
        numeric = cells.is_numeric(dtype)
        made = {"present": F.count(col), "distinct": F.hll_sketch_agg(F.when(col.isNotNull(), F.xxhash64(col)), F.lit(LOG_BUCKETS))}
        if numeric or isinstance(dtype, (T.StringType, T.BooleanType)):
            real = F.when(~F.isnan(number), number)
            made |= {"lo": F.min(number), "hi": F.max(number), "mean": F.avg(number), "m2": F.var_pop(number) * F.count(number),
                     "number_count": F.count(number), "numbers": F.kll_sketch_agg_double(real, F.lit(KLL_K))}
        if not numeric:
            text = col if isinstance(dtype, _TIMES) else table.text(name)
            made |= {"tlo": F.min(text), "thi": F.max(text)}
        if frequent:
            made["frequent"] = F.call_function("approx_top_k_accumulate", table.text(name), F.lit(frequent))
        aggs += [v.alias(f"{k}{i}") for k, v in made.items()]
        fields = {"pos": F.lit(i), "column_name": F.lit(name), "total_count": F.col("total")} | {
            k: F.col(f"{k}{i}") for k in made}
        if "frequent" in fields:
            state = fields["frequent"]
            fields["frequent"] = F.struct(state["sketch"].alias("sketch"), state["maxItemsTracked"].alias("maxItemsTracked"),
                                          F.lit(None).cast("string").alias("itemDataType"), state["itemDataTypeDDL"].alias("itemDataTypeDDL"))
        rows.append(F.struct(*[(fields[k].cast(t) if k != "frequent" else fields[k]).alias(k) if k in fields else F.lit(None).cast(t).alias(k)
                               for k, t in kinds.items()]))
    return df.agg(F.count("*").alias("total"), *aggs).select(F.inline(F.array(*rows)))


def merge_states(states: DataFrame, by=(), frequent: int = 0) -> DataFrame:
    """States of parts of a table put together, per column and the columns ``by``. ``frequent`` as in ``profile_state``.

    The mean of all parts comes first (a window over the few rows of a column), as deviations add up only around a common mean.
    """
    by = list(by)
    keys = [*by, "column_name"]
    whole = Window.partitionBy(*keys)
    n = F.coalesce("number_count", F.lit(0))
    mean = F.sum(n * F.col("mean")).over(whole) / F.sum(n).over(whole)
    states = states.withColumn("_mean", mean).withColumn("_m2", F.col("m2") + n * (F.col("mean") - F.col("_mean")) ** 2)
    top = F.call_function("approx_top_k_combine", F.col("frequent"), F.lit(frequent)) if frequent else F.first("frequent")
    made = {"pos": F.min("pos"), **{c: F.sum(c) for c in ("total_count", "present", "number_count")},
            **{c: F.min(c) for c in ("lo", "tlo")}, **{c: F.max(c) for c in ("hi", "thi")}, "mean": F.first("_mean"), "m2": F.sum("_m2"),
            "distinct": F.hll_union_agg("distinct"), "numbers": F.kll_merge_agg_double("numbers"), "frequent": top}
    return states.groupBy(*keys).agg(*[v.alias(c) for c, v in made.items()])


def profile_from_state(states: DataFrame, keep=(), quantiles=(), top_n: int = 0) -> DataFrame:
    """Profiles as ``profile_columns`` gives them, of states; quantiles as columns ``q<percent>``, and the ``top_n`` frequent values."""
    out = states.select(
        *keep, "pos", "column_name", "total_count", "present", F.hll_sketch_estimate("distinct").alias("unique_count"),
        F.coalesce(cells.float_text(F.col("lo")), F.col("tlo")).alias("min_value"), F.coalesce(cells.float_text(F.col("hi")), F.col("thi")).alias("max_value"),
        F.round("mean", 4).alias("mean_value"),
        F.when(F.col("number_count") >= 2, F.round(F.sqrt(F.col("m2") / F.col("number_count")), 4)).alias("stddev_value"),
        *[F.when(F.kll_sketch_get_n_double("numbers") > 0, F.kll_sketch_get_quantile_double("numbers", F.lit(float(q)))).alias(f"q{round(100 * q)}") for q in quantiles],
        *([F.filter(F.call_function("approx_top_k_estimate", F.col("frequent"), F.lit(top_n + 1)), lambda x: x["item"].isNotNull()).alias("top_values")] if top_n else []))
    out = _rates(out, [*keep, "pos", *[c for c in out.columns if c.startswith("q") and c[1:].isdigit()]])
    return out.withColumn("top_values", F.slice("top_values", 1, top_n)) if top_n else out


def _item(table: Table, name: str) -> Column:
    """The value as the sketch counts it: whole numbers, times and texts as they are, others as text."""
    dtype, col = table.dtype(name), table.col(name)
    plain = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType, T.BooleanType, *_TIMES)
    return col if isinstance(dtype, plain) else table.text(name)


def _text(item: Column, dtype: T.DataType) -> Column:
    return cells.cell_text(item, dtype) if not isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType)) else item


def heavy_hitters(df: DataFrame, columns=None, share: float = 0.01, exact: bool = True) -> DataFrame:
    """All values that fill at least ``share`` of the rows of a column: column_name, value (text), n. NULLs are no values.

    The sketch of a column tracks 8 / share values, so its counts are off by less than a third of the share and no value with the
    share is missed. With ``exact`` the candidates, at most 1.5 / share per column, are counted in a second pass; else n is the sketch's
    estimate and ``error`` its bound, and values between two thirds of the share and the share may be among the rows.
    """
    columns, table = list(columns or df.columns), Table(df.schema)
    tracked, most = math.ceil(8 / share), math.ceil(1.5 / share) + 2
    found = df.agg(F.count("*").alias("rows"), *[F.call_function("approx_top_k", _item(table, c), F.lit(most), F.lit(tracked)).alias(f"t{i}")
                                                 for i, c in enumerate(columns)])
    kinds = [found.schema[f"t{i}"].dataType.elementType["item"].dataType for i in range(len(columns))]
    if not exact:
        rows = [F.transform(f"t{i}", lambda x: F.struct(F.lit(i).alias("pos"), F.lit(c).alias("column_name"), _text(x["item"], kinds[i]).alias("value"),
                                                       x["count"].alias("n"))) for i, c in enumerate(columns)]
        error = F.ceil(F.col("rows") * share / 3).cast("long")
        return (found.select("rows", F.explode(F.concat(*rows)).alias("x")).select("rows", "x.*")
                .filter(F.col("value").isNotNull() & (F.col("n") >= F.col("rows") * share)).select("column_name", "value", "n", error.alias("error")))
    seen = found.head()  # at most 1.5 / share + 2 values per column
    least = math.floor(seen["rows"] * share * 2 / 3)
    wanted = [[x["item"] for x in seen[f"t{i}"] if x["item"] is not None and x["count"] >= least] for i in range(len(columns))]
    items = [F.when(_item(table, c).isin(w), _item(table, c)) for c, w in zip(columns, wanted) if w]
    pairs = [F.struct(F.lit(c).alias("column_name"), _text(item, kinds[columns.index(c)]).alias("value")) for item, c in zip(items, (c for c, w in zip(columns, wanted) if w))]
    if not pairs:
        return df.sparkSession.createDataFrame([], "column_name string, value string, n long")
    # only candidates get past the filter; partial counts leave each task
    return (df.select(F.inline(F.array(*pairs))).filter("value IS NOT NULL").groupBy("column_name", "value").agg(F.count("*").alias("n"))
            .filter(F.col("n") >= F.lit(seen["rows"]) * share))
