"""Profiles, drift, schema inference."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tamis.operators import order, pages, profile, schema, sketches
from tamis.operators.suspects import counts_by, find_first_suspects
from tamis.plans import DEFAULT_RULES
from tamis.session import fresh_path
from tamis.sinks import append_log, write_profiles

from .base import AS_OF, parcel, query, sql, table

_ORDERS = [("o_orderkey", "n"), ("o_custkey", "n"), ("o_orderstatus", "s"), ("o_totalprice", "n"), ("o_orderdate", "s"),
           ("o_orderpriority", "s")]
_PARCELS = [(c, "m") for c in ("record_id", "tracking_id", "sender_name", "receiver_name", "sender_phone", "address", "dispatch_time",
                               "arrival_time", "status_code", "payment_method", "table_name")] \
    + [("road_addr_yn", "n"), ("weight_kg", "n"), ("cod_amount", "n"), ("order_date", "s")]
_LINES = [(c, "n") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")] \
    + [("l_returnflag", "s"), ("l_linestatus", "s"), ("l_shipdate", "s")]
_EVENTS = [("event_id", "n"), ("ts", "s"), ("user_id", "n"), ("event_type", "s"), ("value", "n"), ("props", "s")]


def _profile_sql(source, columns):
    """One aggregate per column; kind n = number, s = text, m = text that may hold numbers."""
    out = []
    for name, kind in columns:
        number = {"n": f"cast({name} AS double)", "s": "cast(NULL AS double)"}.get(kind, f"try_cast({name} AS double)")
        text = f"cast({name} AS varchar)"
        low, high = ((f"cast(min({number}) AS varchar)", f"cast(max({number}) AS varchar)") if kind == "n"
                     else (f"coalesce(cast(min({number}) AS varchar), min({text}))",
                           f"coalesce(cast(max({number}) AS varchar), max({text}))"))
        out.append(
            f"SELECT '{name}' AS column_name, count(*) AS total_count, count(*) - count({name}) AS null_count, "
            f"round((count(*) - count({name})) / count(*), 6) AS null_rate, count(DISTINCT {name}) AS unique_count, "
            f"round(count(DISTINCT {name}) / greatest(count({name}), 1), 6) AS uniqueness_rate, "
            f"{low} AS min_value, {high} AS max_value, round(avg({number}), 4) AS mean_value, "
            f"CASE WHEN count({number}) >= 2 THEN round(stddev_pop({number}), 4) END AS stddev_value FROM {source}")
    return " UNION ALL ".join(out)


@query("profile_columns", _profile_sql("orders", _ORDERS))
def profile_orders(spark, sf):
    return profile.profile_columns(table(spark, sf, "orders"))


@query("profile_parcels", sql(_profile_sql("p", _PARCELS), "p"))
def profile_parcels(spark, sf):
    """With NULLs, and text that mostly reads as numbers."""
    return profile.profile_columns(parcel(spark, sf))


@query("profile_lineitem", _profile_sql("lineitem", _LINES))
def profile_lineitem(spark, sf):
    return profile.profile_columns(table(spark, sf, "lineitem"))


@query("profile_events_sketch", f"SELECT * EXCLUDE (unique_count, uniqueness_rate), unique_count AS exact, true AS close FROM ({_profile_sql('events', _EVENTS)})")
def profile_events(spark, sf):
    """Distinct counts from sketches: one aggregate, nothing shuffled but one row per task.

    Checked against exact counts, which may differ by a tenth at most.
    """
    events = table(spark, sf, "events")
    exact = events.agg(*[F.count_distinct(c).alias(c) for c in events.columns]).select(F.inline(F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("exact")) for c in events.columns])))
    sketch = profile.profile_columns(events, approx=True)
    near = F.abs(F.col("unique_count") - F.col("exact")) <= F.col("exact") / 10
    return (sketch.join(F.broadcast(exact), "column_name").withColumn("close", near)  # a row per column
            .drop("unique_count", "uniqueness_rate"))


@query("json_key_presence", """WITH k AS (SELECT 'o_orderkey' AS column_name, cast(o_orderkey AS varchar) AS v FROM orders
UNION ALL SELECT 'status', CASE WHEN o_orderkey % 4 <> 1 THEN o_orderstatus END FROM orders WHERE o_orderkey % 4 <> 0),
c AS (SELECT column_name, v, count(*) AS n FROM k GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY v IS NULL, n DESC, v) AS rn FROM c)
SELECT *, round(null_count / total_count, 6) AS null_rate FROM (SELECT column_name, cast(sum(n) AS bigint) AS total_count,
  cast(coalesce(sum(n) FILTER (v IS NULL), 0) AS bigint) AS null_count, count(v) AS distinct_count,
  string_agg(v || ':' || n, ';' ORDER BY rn) FILTER (rn <= 5 AND v IS NOT NULL) AS top FROM t GROUP BY column_name)""")
def json_key_presence(spark, sf):
    """A quarter of the records lacks a key, a quarter has it as null."""
    line = F.expr("""CASE o_orderkey % 4 WHEN 0 THEN concat('{"o_orderkey":', o_orderkey, '}')
      WHEN 1 THEN concat('{"o_orderkey":', o_orderkey, ',"status":null}')
      ELSE concat('{"o_orderkey":', o_orderkey, ',"status":"', o_orderstatus, '"}') END""")
    path = fresh_path(spark, "records")
    table(spark, sf, "orders").select(line.alias("value")).write.text(path)
    out = profile.key_presence(spark.read.option("singleVariantColumn", "v").json(path))
    pairs = F.transform("top_values", lambda x: F.concat_ws(":", x["value"], x["count"].cast("string")))
    return out.withColumn("top", F.array_join(pairs, ";")).drop("top_values")


def _top_sql(source, columns, n):
    parts = [f"SELECT '{c}' AS column_name, cast({c} AS varchar) AS \"value\", count(*) AS n FROM {source} "
             f"WHERE {c} IS NOT NULL GROUP BY {c}" for c in columns]
    return (f"SELECT column_name, \"rank\", \"value\", n FROM (SELECT *, row_number() OVER (PARTITION BY column_name "
            f"ORDER BY n DESC, \"value\") AS \"rank\" FROM ({' UNION ALL '.join(parts)})) WHERE \"rank\" <= {n}")


@query("top_values", _top_sql("events", [c for c, _ in _EVENTS], 5))
def top_values(spark, sf):
    return profile.top_values(table(spark, sf, "events"), n=5)


@query("top_values_array", f"""
SELECT column_name, string_agg("value" || ':' || n, ';' ORDER BY "rank") AS top FROM
({_top_sql("orders", [c for c, _ in _ORDERS], 10)}) GROUP BY column_name""")
def top_values_array(spark, sf):
    """Top values as the profile carries them."""
    out = profile.profile_columns(table(spark, sf, "orders"), top_n=10)
    pairs = F.transform("top_values", lambda x: F.concat_ws(":", x["value"], x["count"].cast("string")))
    return out.select("column_name", F.array_join(pairs, ";").alias("top"))


# --- history: one profile per day of events, and per type -------------------------

def daily(spark, sf):
    """A growing number of events per day and type makes a profile history."""
    events = table(spark, sf, "events").withColumn("day", F.date_trunc("DAY", F.col("ts").cast("timestamp")))
    cleaned = events.withColumn("value", F.when(F.expr("event_id % (1 + day(ts) % 9) <> 0"), F.col("value")))
    return cleaned


def history(spark, sf):
    return (profile.profile_groups(daily(spark, sf), "day", ["value", "user_id"])
            .withColumnRenamed("day", "ts").withColumn("table_name", F.lit("events")))


_DAILY = """d AS (SELECT *, date_trunc('day', ts) AS day, CASE WHEN event_id % (1 + day(ts) % 9) <> 0 THEN "value" END AS v
  FROM events),
h AS (SELECT 'value' AS column_name, day AS ts, count(*) AS total_count, round((count(*) - count(v)) / count(*), 6)
  AS null_rate, round(avg(v), 4) AS mean_value FROM d GROUP BY day
  UNION ALL SELECT 'user_id', day, count(*), round((count(*) - count(user_id)) / count(*), 6), round(avg(user_id), 4)
  FROM d GROUP BY day)"""


@query("profile_history_window", f"""WITH {_DAILY} SELECT column_name, ts, total_count, null_rate, mean_value FROM h
WHERE column_name = 'value' AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY""")
def history_window(spark, sf):
    path = fresh_path(spark, "profiles")
    write_profiles(history(spark, sf).drop("table_name").withColumnRenamed("ts", "day"), path, "events", AS_OF)
    log = spark.read.parquet(path).drop("ts").withColumnRenamed("day", "ts")  # table_name prunes directories
    return (profile.history_window(log, "events", "value", AS_OF, 7)
            .select("column_name", F.col("ts").cast("timestamp_ntz").alias("ts"), "total_count", "null_rate", "mean_value"))


@query("profile_change", f"""WITH {_DAILY}, u AS (SELECT 'value' AS column_name, day AS ts, count(DISTINCT v) AS unique_count FROM d GROUP BY day
  UNION ALL SELECT 'user_id', day, count(DISTINCT user_id) FROM d GROUP BY day),
n AS (SELECT *, row_number() OVER w AS rn, lead(null_rate) OVER w AS prev, lead(unique_count) OVER w AS prev_unique_count
  FROM h JOIN u USING (column_name, ts) WINDOW w AS (PARTITION BY column_name ORDER BY ts DESC))
SELECT *, change <> 'none' AS changed FROM (SELECT column_name, null_rate, prev AS prev_null_rate, unique_count, prev_unique_count,
  CASE WHEN abs(null_rate - prev) > 0.05 THEN 'null_rate'
    WHEN abs(unique_count - prev_unique_count) / greatest(prev_unique_count, 1) > 0.2 THEN 'unique_count' ELSE 'none' END AS change
  FROM n WHERE rn = 1)""")
def profile_change(spark, sf):
    """With exact distinct counts, which SQL can tell as well."""
    exact = (daily(spark, sf).groupBy(F.col("day").alias("ts")).agg(F.count_distinct("value").alias("v"), F.count_distinct("user_id").alias("u"))
             .select("ts", F.inline(F.array(F.struct(F.lit("value").alias("column_name"), F.col("v").alias("unique_count")),
                                            F.struct(F.lit("user_id").alias("column_name"), F.col("u").alias("unique_count"))))))
    h = history(spark, sf).drop("unique_count").join(exact, ["ts", "column_name"])
    return profile.profile_change(h).select("column_name", "null_rate", "prev_null_rate", "unique_count", "prev_unique_count", "change", "changed")


@query("profile_anomaly", f"""WITH {_DAILY},
c AS (SELECT * FROM h WHERE ts = (SELECT max(ts) FROM h)), b AS (SELECT column_name, avg(null_rate) AS null_rate,
  avg(mean_value) AS mean_value FROM h WHERE ts < (SELECT max(ts) FROM h) GROUP BY column_name),
u AS (SELECT c.column_name, 'null_rate' AS metric, c.null_rate AS cur, b.null_rate AS past FROM c JOIN b USING (column_name)
  UNION ALL SELECT c.column_name, 'mean_value', c.mean_value, b.mean_value FROM c JOIN b USING (column_name)),
v AS (SELECT *, CASE WHEN past <> 0 THEN (cur - past) / abs(past) * 100 WHEN cur = 0 THEN 0.0 ELSE 100.0 END AS dev FROM u)
SELECT column_name, metric, round(cur, 3) AS current_value, round(past, 3) AS historical_avg,
  round(dev, 2) AS deviation_pct, CASE WHEN abs(dev) >= 50 THEN 'critical' WHEN abs(dev) >= 20 THEN 'warning'
  ELSE 'info' END AS severity FROM v""")
def profile_anomaly(spark, sf):
    h = history(spark, sf)
    newest = h.groupBy("table_name", "column_name").agg(F.max("ts").alias("last"))  # a row per column
    marked = h.join(F.broadcast(newest), ["table_name", "column_name"])
    out = profile.profile_anomalies(marked.filter("ts < last"), marked.filter("ts = last"),
                                    metrics=("null_rate", "mean_value"))
    return out.select("column_name", "metric", F.round("current_value", 3).alias("current_value"),
                      F.round("historical_avg", 3).alias("historical_avg"),
                      F.round("deviation_pct", 2).alias("deviation_pct"), "severity")


@query("freshness", f"""SELECT event_type, max(ts) AS last_ts, max(ts) >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY
AS freshness_ok FROM events GROUP BY event_type""")
def freshness(spark, sf):
    return profile.freshness(table(spark, sf, "events"), "ts", AS_OF, 1, by="event_type")


@query("completeness", sql(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS total_count, count(*) - count({c}) AS null_count, "
    f"round((count(*) - count({c})) / count(*), 6) AS null_rate, "
    f"round((count(*) - count({c})) / count(*), 6) <= 0.01 AS completeness_ok FROM p"
    for c, _ in _PARCELS), "p"))
def completeness(spark, sf):
    return profile.completeness(parcel(spark, sf), max_null_rate=0.01)


# --- schema -------------------------------------------------------------------------

_KINDS = [(c, "string") for c in ("record_id", "tracking_id", "sender_name", "receiver_name", "sender_phone", "address", "payment_method",
                                  "table_name")] \
    + [(c, "datetime") for c in ("dispatch_time", "arrival_time", "status_code", "order_date")] \
    + [("weight_kg", "float"), ("cod_amount", "float"), ("road_addr_yn", "integer")]


@query("infer_schema", sql(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{k}' AS data_type, count({c}) < count(*) AS nullable, count(*) AS sample_count FROM p"
    for c, k in _KINDS), "p"))
def infer_schema(spark, sf):
    """The substring hints also take "status_code" for a time."""
    return schema.infer_schema(parcel(spark, sf))


@query("infer_schema_untyped", """
SELECT 'c_custkey' AS column_name, CASE WHEN count(*) FILTER (NOT regexp_full_match(cast(c_custkey AS varchar), '-?[0-9]+')) = 0
  THEN 'integer' ELSE 'float' END AS data_type, count(c_custkey) < count(*) AS nullable FROM customer
UNION ALL SELECT 'c_nationkey', 'integer', count(c_nationkey) < count(*) FROM customer
UNION ALL SELECT 'c_acctbal', 'float', count(c_acctbal) < count(*) FROM customer
UNION ALL SELECT 'c_name', 'string', count(c_name) < count(*) FROM customer
UNION ALL SELECT 'c_mktsegment', 'string', count(*) FILTER (c_custkey % 7 = 0) > 0 FROM customer""")
def infer_untyped(spark, sf):
    cells = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string"), F.col("c_acctbal").cast("string"), "c_name",
        F.expr("CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_mktsegment END").alias("c_mktsegment"))
    return schema.infer_schema(cells, substring_hints=False, untyped=True).drop("sample_count")


@query("schema_fingerprint", """
SELECT substring(sha256('[' || string_agg('["' || c || '", "' || t || '"]', ', ' ORDER BY c) || ']'), 1, 16) AS fingerprint,
  count(*) AS column_count FROM (SELECT 'o_orderkey' AS c, CASE WHEN count(o_orderkey) > 0 THEN 'integer' ELSE 'string' END AS t FROM orders
UNION ALL SELECT 'o_custkey', CASE WHEN count(o_custkey) > 0 THEN 'integer' ELSE 'string' END FROM orders
UNION ALL SELECT 'o_orderstatus', CASE WHEN count(*) >= 0 THEN 'datetime' END FROM orders
UNION ALL SELECT 'o_totalprice', CASE WHEN count(o_totalprice) > 0 THEN 'float' ELSE 'string' END FROM orders
UNION ALL SELECT 'o_orderdate', CASE WHEN count(*) >= 0 THEN 'datetime' END FROM orders
UNION ALL SELECT 'o_orderpriority', CASE WHEN count(*) >= 0 THEN 'string' END FROM orders)""")
def fingerprint(spark, sf):
    """The substring hints also take "o_orderstatus" for a time."""
    return schema.schema_fingerprint(schema.infer_schema(table(spark, sf, "orders")))


_KEYS_SQL = """
WITH c AS (SELECT 'o_custkey' AS column_name, 3 AS priority, count(*) AS row_count, count(o_custkey) AS present_count,
  count(DISTINCT o_custkey) AS distinct_count FROM orders
UNION ALL SELECT 'order_id', 2, count(*), count(o_orderkey), count(DISTINCT o_orderkey) FROM orders
UNION ALL SELECT 'o_orderstatus', 3, count(*), count(o_orderstatus), count(DISTINCT o_orderstatus) FROM orders
UNION ALL SELECT 'paid_id', 2, count(*), count(*) FILTER (o_orderkey % 2 = 0), count(DISTINCT o_orderkey) FILTER (o_orderkey % 2 = 0) FROM orders)
SELECT *, distinct_count = row_count AND present_count = row_count AS is_unique, column_name = 'order_id' AS is_key FROM c"""


def keyed_orders(spark, sf):
    return table(spark, sf, "orders").select(
        F.expr("CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END").alias("paid_id"), "o_custkey",
        F.col("o_orderkey").alias("order_id"), "o_orderstatus")


@query("rank_keys", _KEYS_SQL)
def rank_keys(spark, sf):
    return schema.rank_keys(keyed_orders(spark, sf))


@query("detect_key", _KEYS_SQL)
def detect_key(spark, sf):
    return schema.detect_key(keyed_orders(spark, sf))


@query("record_id_added", "SELECT o_orderkey AS order_id, o_orderkey AS record_id, o_custkey FROM orders")
def record_id_added(spark, sf):
    """Find the key, then use it as the record id."""
    df = table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), "o_custkey")
    return schema.with_record_id(df, schema.find_key(df))


@query("rule_cache_lookup", f"""
SELECT fingerprint, count(*) AS n FROM (SELECT substring(sha256(p_brand), 1, 16) AS fingerprint,
  TIMESTAMP '{AS_OF}' - to_seconds(p_size * 100) AS cached_at FROM part) WHERE fingerprint = substring(sha256('Brand#17'), 1, 16)
  AND cached_at >= TIMESTAMP '{AS_OF}' - INTERVAL 3600 SECOND GROUP BY fingerprint""")
def rule_cache_lookup(spark, sf):
    """Rule sets cached by schema fingerprint, an hour at most."""
    cache = table(spark, sf, "part").select(
        F.substring(F.sha2("p_brand", 256), 1, 16).alias("fingerprint"), F.col("p_name").alias("rules"),
        (F.lit(AS_OF).cast("timestamp") - F.make_interval(secs=F.col("p_size") * 100)).alias("cached_at"))
    wanted = F.substring(F.sha2(F.lit("Brand#17"), 256), 1, 16)
    return schema.cached_rules(cache, wanted, AS_OF).groupBy("fingerprint").agg(F.count("*").alias("n"))


@query("rule_cache_roundtrip", sql("SELECT rule_id, count(*) AS n FROM s GROUP BY rule_id", "s"))
def rule_cache_roundtrip(spark, sf):
    """A rule set stored under the fingerprint of the table's schema, found again by it, and run."""
    data, path = parcel(spark, sf), fresh_path(spark, "rule-cache")
    mark = schema.schema_fingerprint(schema.infer_schema(data)).head()["fingerprint"]
    for key, rules, at in ((mark, DEFAULT_RULES[:1], "2024-01-30 23:10:00"), (mark, DEFAULT_RULES, "2024-01-30 23:30:00"),
                           ("other", DEFAULT_RULES[:2], "2024-01-30 23:50:00")):
        append_log(schema.rule_cache_entries(spark, rules, key, at), path)
    rules = schema.newest_rules(spark.read.parquet(path), mark, AS_OF)
    return counts_by(find_first_suspects(data, rules), "rule_id")


# --- order and pages ------------------------------------------------------------------

@query("page_records", """
SELECT o_orderkey, row_no, (SELECT count(*) FROM orders) AS total_count,
  cast(ceil((SELECT count(*) FROM orders) / 500.0) AS bigint) AS chunk_count FROM
(SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS row_no FROM orders)
WHERE row_no > 1000 AND row_no <= 1500""")
def page_records(spark, sf):
    return pages.page(spark, ordered(spark, sf, ["o_orderdate", "o_orderkey"], 16), 500, 2).select("o_orderkey", "row_no", "total_count", "chunk_count")


def ordered(spark, sf, keys, files):
    """Orders kept in order, all columns."""
    return pages.write_ordered(table(spark, sf, "orders"), fresh_path(spark, "ordered"), keys, files=files, staged=False)


_ORDER_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


@query("page_index", f"""WITH n AS (SELECT {_ORDER_COLUMNS}, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS row_no, count(*) OVER () AS total_count FROM orders)
SELECT *, cast(ceil(total_count / 300.0) AS bigint) AS chunk_count FROM n WHERE row_no <= 300 OR row_no > 600 AND row_no <= 900 OR row_no > (total_count - 1) // 300 * 300""")
def page_index(spark, sf):
    """Three pages, the last one among them, of one table that was written once."""
    path = ordered(spark, sf, ["-o_totalprice", "o_orderkey"], 16)
    last = (table(spark, sf, "orders").count() - 1) // 300
    return reduce(DataFrame.unionByName, [pages.page(spark, path, 300, i) for i in sorted({0, 2, last})])


@query("page_at_key", f"""WITH n AS (SELECT {_ORDER_COLUMNS}, row_number() OVER (ORDER BY o_custkey DESC, o_orderkey) AS row_no FROM orders)
SELECT * FROM n WHERE row_no BETWEEN 701 AND 1600""")
def page_at_key(spark, sf):
    """What follows the last key of a page, in two more pages."""
    path = ordered(spark, sf, ["-o_custkey", "o_orderkey"], 16)
    seen = pages.page(spark, path, 100, 6).agg(F.max_by(F.struct("o_custkey", "o_orderkey"), "row_no").alias("k")).head()["k"]
    one = pages.page_at_key(spark, path, seen, 450)
    seen = one.agg(F.max_by(F.struct("o_custkey", "o_orderkey"), "row_no").alias("k")).head()["k"]
    return one.unionByName(pages.page_at_key(spark, path, seen, 450))


@query("number_rows", """
SELECT p_partkey, row_number() OVER (ORDER BY p_brand, p_partkey) AS row_no FROM part""")
def number_rows(spark, sf):
    """Few brands hold many rows each; the second key column splits them."""
    return order.number_rows(table(spark, sf, "part").select("p_brand", "p_partkey"), ["p_brand", "p_partkey"],
                             ranges=8).drop("p_brand")


@query("number_rows_nulls", """
SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_custkey % 3 > 0 THEN o_custkey END DESC NULLS LAST, o_orderkey) AS row_no FROM orders""")
def number_rows_nulls(spark, sf):
    """A third of the rows has no key; the highest key first."""
    rows = table(spark, sf, "orders").select("o_orderkey", F.expr("CASE WHEN o_custkey % 3 > 0 THEN o_custkey END").alias("k"))
    return order.number_rows(rows, [F.desc("k"), "o_orderkey"], ranges=8).drop("k")


@query("page_after", """SELECT o_orderkey, o_custkey FROM orders WHERE (o_custkey, o_orderkey) > (SELECT (o_custkey, o_orderkey) FROM orders
ORDER BY o_custkey, o_orderkey LIMIT 1 OFFSET 199) ORDER BY o_custkey, o_orderkey LIMIT 200""")
def page_after(spark, sf):
    """The page after the last key of the page before."""
    rows, keys = table(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"]
    seen = order.page_after(rows, keys, 200).agg(F.max(F.struct(*keys)).alias("last")).head()["last"]
    return order.page_after(rows, keys, 200, tuple(seen))


# --- sketches ------------------------------------------------------------------------

_MERGED = {"l_orderkey": "l_orderkey", "part": "CASE WHEN l_linenumber <> 3 THEN l_partkey END", "l_extendedprice": "l_extendedprice", "l_returnflag": "l_returnflag",
           "l_shipdate": "l_shipdate", "code": "concat(l_returnflag, cast(l_suppkey AS string))"}
_NUMBERS = ("l_orderkey", "part", "l_extendedprice")


def _merged_sql(name, text):
    v = text.replace("AS string", "AS varchar")
    lo, hi = (f"cast({f}(cast({v} AS double)) AS varchar)" if name in _NUMBERS else f"cast({f}({v}) AS varchar)" for f in ("min", "max"))
    mean, dev = (f"round({f}(cast({v} AS double)), 4)" if name in _NUMBERS else "cast(NULL AS double)" for f in ("avg", "stddev_pop"))
    return (f"SELECT '{name}' AS column_name, count(*) AS total_count, count(*) - count({v}) AS null_count, {lo} AS min_value, {hi} AS max_value, {mean} AS mean_value, "
            f"{dev} AS stddev_value, count(DISTINCT {v}) AS exact_count, true AS unique_within, {'true' if name in _NUMBERS else 'cast(NULL AS boolean)'} AS median_within FROM lineitem")


@query("profile_merge", " UNION ALL ".join(_merged_sql(n, t) for n, t in _MERGED.items()))
def profile_merge(spark, sf):
    """States of two halves, appended to a log one after the other and merged, against the exact figures of the whole."""
    rows = table(spark, sf, "lineitem").select(*[F.expr(t).alias(n) for n, t in _MERGED.items()], "l_suppkey")
    path = fresh_path(spark, "states")
    for half in range(2):
        append_log(sketches.profile_state(rows.filter(F.col("l_suppkey") % 2 == half).drop("l_suppkey")), path)
    found = sketches.profile_from_state(sketches.merge_states(spark.read.parquet(path)), quantiles=[0.5])
    medians = {r["column_name"]: r["q50"] for r in found.select("column_name", "q50").collect()}
    exact = rows.agg(*[F.count_distinct(n).alias(f"u_{n}") for n in _MERGED],
                     *[(F.abs(F.count_if(F.col(n) < medians[n]) + F.count_if(F.col(n) <= medians[n]) - F.count(n)) <=
                        2 * sketches.RANK_ERROR * F.count(n) + F.count_if(F.col(n) == medians[n])).alias(f"m_{n}") for n in _NUMBERS])
    each = exact.select(F.inline(F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(f"u_{n}").alias("exact_count"),
                                                    (F.col(f"m_{n}") if n in _NUMBERS else F.lit(None).cast("boolean")).alias("median_within")) for n in _MERGED])))
    within = F.abs(F.col("unique_count") - F.col("exact_count")) <= 1 + sketches.DISTINCT_ERROR * F.col("exact_count")
    return (found.join(each, "column_name").withColumn("unique_within", within)
            .select("column_name", "total_count", "null_count", "min_value", "max_value", "mean_value", "stddev_value", "exact_count", "unique_within", "median_within"))


_SKEWED = {"hot": "CASE WHEN o_orderkey % 3 = 0 THEN 'hot' WHEN o_orderkey % 100 = 1 THEN 'warm' ELSE cast(o_orderkey AS string) END",
           "o_orderpriority": "o_orderpriority", "o_orderkey": "o_orderkey", "paid": "CASE WHEN o_custkey % 7 < 3 THEN cast(o_custkey % 7 AS double) / 4 END"}


@query("top_values_sketch", " UNION ALL ".join(f"SELECT '{n}' AS column_name, cast({t.replace('AS string', 'AS varchar')} AS varchar) AS value, count(*) AS n FROM orders "
                                               f"WHERE {t.replace('AS string', 'AS varchar')} IS NOT NULL GROUP BY 2 HAVING count(*) >= 0.005 * (SELECT count(*) FROM orders)"
                                               for n, t in _SKEWED.items()))
def top_values_sketch(spark, sf):
    """Every value with half a per cent of the rows: named by a sketch, counted exactly."""
    return sketches.heavy_hitters(table(spark, sf, "orders").select(*[F.expr(t).alias(n) for n, t in _SKEWED.items()]), share=0.005)
