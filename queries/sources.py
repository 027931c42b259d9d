"""Sources, sinks and streams: written to the shared folder, read back, compared with the table."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from tamis import sinks, sources, streaming
from tamis.operators.suspects import find_first_suspects
from tamis.plans import Rule
from tamis.session import folder_bytes, fresh_path, materialise

from .base import parcel, query, sql, table

ORDERS = ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
          "o_orderpriority string")
ORDER_COLS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
ORDERS_SQL = f"SELECT {ORDER_COLS} FROM orders"


def orders(spark, sf):
    return table(spark, sf, "orders").select(*ORDER_COLS.split(", "))


@query("scan_jsonl", ORDERS_SQL)
def scan_jsonl(spark, sf):
    path = sinks.write_json(orders(spark, sf), fresh_path(spark, "jsonl"))
    return sources.read_json_lines(spark, path, ORDERS)


@query("scan_jsonl_bad_lines", "SELECT count(*) AS line_count, count(*) FILTER (o_orderkey % 10 <> 0) AS "
                               "good_lines, count(*) FILTER (o_orderkey % 10 = 0) AS bad_lines FROM orders")
def scan_jsonl_bad_lines(spark, sf):
    """Every tenth line is cut; the rest is read, the cut ones are kept aside."""
    path = fresh_path(spark, "jsonl")
    line = F.to_json(F.struct(*ORDER_COLS.split(", ")))
    orders(spark, sf).select(F.when(F.expr("o_orderkey % 10 = 0"), F.substring(line, 1, 20)).otherwise(line).alias("value")) \
        .write.text(path)
    read = sources.read_json_lines(spark, path, ORDERS, keep_bad_lines=True)
    return read.select("o_orderkey", "_corrupt_record").agg(
        F.count("*").alias("line_count"), F.count("o_orderkey").alias("good_lines"),
        F.count("_corrupt_record").alias("bad_lines"))


@query("scan_json_documents", ORDERS_SQL)
def scan_json_documents(spark, sf):
    """Files that each hold an array of objects, up to a hundred per array."""
    path = fresh_path(spark, "documents")
    row = F.struct(*ORDER_COLS.split(", "))
    (orders(spark, sf).groupBy(F.expr("o_orderkey div 100").alias("g")).agg(F.to_json(F.collect_list(row)).alias("value"))
     .select("value").repartition(8).write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path))
    return sources.read_json_documents(spark, path, T.StructType.fromDDL(ORDERS))


@query("scan_json_split", f"""SELECT {ORDER_COLS}, '}}]{{["' || o_orderkey || '\\' AS note, [o_custkey, o_orderkey] AS ids FROM orders""")
def scan_json_split(spark, sf):
    """One array in one file, with brackets, braces, quotes and backslashes in its texts, read by many tasks."""
    path, kind = fresh_path(spark, "array"), ORDERS + ", note string, ids array<bigint>"
    note = F.concat(F.lit('}]{["'), F.col("o_orderkey").cast("string"), F.lit("\\"))
    rows = orders(spark, sf).withColumn("note", note).withColumn("ids", F.array("o_custkey", "o_orderkey"))
    element = F.to_json(F.struct(*rows.columns), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})
    # one file; where its lines end does not matter to the reader
    first, last = rows.agg(F.min("o_orderkey"), F.max("o_orderkey")).head()
    key = F.col("o_orderkey")
    text = F.concat(F.when(key == first, "[").otherwise(""), element, F.when(key == last, "]").otherwise(","))
    rows.select(text.alias("value"), key).coalesce(1).sortWithinPartitions(key).select("value").write.option("lineSep", " ").text(path)
    setting, conf = "spark.sql.files.maxPartitionBytes", spark.conf
    before = conf.get(setting)
    conf.set(setting, str(max(64 * 1024, folder_bytes(spark, path) // 500)))  # many tasks, whose number does not grow with a large file
    try:
        return materialise(sources.read_json_array(spark, path, kind), "elements")
    finally:
        conf.set(setting, before)


@query("roundtrip_json", sql("SELECT * EXCLUDE (road, jibun, kind) FROM p", "p"))
def roundtrip_json(spark, sf):
    """Missing values and Korean text survive."""
    data = parcel(spark, sf)
    path = sinks.write_json(data, fresh_path(spark, "jsonl"))
    return sources.read_json_lines(spark, path, data.schema)


@query("append_union", f"{ORDERS_SQL} UNION ALL {ORDERS_SQL} WHERE o_orderkey % 2 = 0")
def append_union(spark, sf):
    path = sinks.write_json(orders(spark, sf), fresh_path(spark, "jsonl"))
    sinks.write_json(orders(spark, sf).filter("o_orderkey % 2 = 0"), path, append=True)
    return sources.read_json_lines(spark, path, ORDERS)


@query("csv_coerce", sql("""SELECT * EXCLUDE (road, jibun, kind) REPLACE (cast(record_id AS bigint) AS record_id,
cast(order_date AS varchar) AS order_date) FROM p""", "p"))
def csv_coerce(spark, sf):
    data = parcel(spark, sf).withColumn("order_date", F.col("order_date").cast("string"))
    path = fresh_path(spark, "csv")
    data.write.option("header", True).csv(path)
    return sources.coerce_csv(sources.read_csv_text(spark, path))


_RAGGED = """concat(CASE WHEN c_custkey % 11 = 1 THEN '' ELSE concat(cast(c_custkey AS string), ',') END, c_name, ',', c_mktsegment,
  CASE WHEN c_custkey % 11 = 0 THEN ',more,"cells"' ELSE '' END)"""


@query("csv_ragged", f"""SELECT CASE WHEN good THEN cast(c_custkey AS varchar) END AS c_custkey, CASE WHEN good THEN c_name END AS c_name,
CASE WHEN good THEN c_mktsegment END AS c_mktsegment, CASE WHEN NOT good THEN {_RAGGED} END AS record
FROM (SELECT *, c_custkey % 11 > 1 AS good FROM customer)""")
def csv_ragged(spark, sf):
    """Records with a cell too few or too many are kept aside as text."""
    path = fresh_path(spark, "csv")
    lines = table(spark, sf, "customer").select(F.expr(_RAGGED).alias("c_custkey,c_name,c_mktsegment"))
    lines.write.option("header", True).option("sep", "\u0001").option("quote", "\u0000").csv(path)  # the lines as they are
    return sources.read_csv_text(spark, path, keep_bad_records=True).withColumnRenamed("_corrupt_record", "record")


@query("typed_json_flatten", """SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority, o_orderkey % 2 = 0 AS paid,
CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS status, cast(o_custkey AS varchar) || ',x' AS tags,
'c' || o_custkey AS city FROM orders""")
def typed_json_flatten(spark, sf):
    """Export lines with type tags, gzip: numbers, texts, flags, NULLs, lists and maps."""
    def tag(name, col):
        return F.struct(col.cast("string").alias(name))

    item = F.struct(
        tag("N", F.col("o_orderkey")).alias("o_orderkey"), tag("N", F.col("o_custkey")).alias("o_custkey"),
        tag("N", F.col("o_totalprice")).alias("o_totalprice"), tag("S", F.col("o_orderdate")).alias("o_orderdate"),
        tag("S", F.col("o_orderpriority")).alias("o_orderpriority"),
        F.struct((F.expr("o_orderkey % 2 = 0")).alias("BOOL")).alias("paid"),
        F.struct(F.expr("CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END").alias("S"),
                 F.expr("CASE WHEN o_orderkey % 3 = 0 THEN true END").alias("NULL")).alias("status"),
        F.struct(F.array(F.struct(F.col("o_custkey").cast("string").alias("N"), F.lit(None).cast("string").alias("S")),
                         F.struct(F.lit(None).cast("string").alias("N"), F.lit("x").alias("S"))).alias("L")).alias("tags"),
        F.struct(F.struct(tag("S", F.concat(F.lit("c"), "o_custkey")).alias("city")).alias("M")).alias("place"))
    path = fresh_path(spark, "export")
    (orders(spark, sf).select(F.to_json(F.struct(item.alias("Item"))).alias("value")).repartition(4)
     .write.option("compression", "gzip").text(path))
    flat = sources.read_typed_json(
        spark, path, "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string, paid boolean, status string, "
                     "tags array<string>, place struct<city:string>", pattern="*.txt.gz")
    return flat.withColumn("tags", F.array_join("tags", ",")).withColumn("city", F.col("place.city")).drop("place")


@query("typed_json_inferred", f"SELECT * REPLACE (cast(o_orderdate AS varchar) AS o_orderdate) FROM ({ORDERS_SQL})")
def typed_json_inferred(spark, sf):
    """The same without a declared schema."""
    item = F.struct(*[F.struct(F.col(c).cast("string").alias(t)).alias(c) for c, t in
                      zip(ORDER_COLS.split(", "), "NNSNSS")])
    path = fresh_path(spark, "export")
    orders(spark, sf).select(F.to_json(item).alias("value")).write.text(path)
    return sources.read_typed_json(spark, path, pattern="*.txt")


@query("sample_head", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 100")
def sample_head(spark, sf):
    """The head of a table by key; the limit is the feature."""
    return sources.head_sample(orders(spark, sf), 100, "o_orderkey").select("o_orderkey", "o_orderpriority")


@query("project_columns", "SELECT o_orderkey, o_orderstatus, cast(NULL AS varchar) AS hub_code FROM orders")
def project_columns(spark, sf):
    return sources.project(orders(spark, sf), ["o_orderkey", "hub_code", "o_orderstatus"])


@query("display_columns", ORDERS_SQL)
def display_columns(spark, sf):
    return sources.display_order(orders(spark, sf), ["o_orderstatus", "missing", "o_orderkey"])


@query("incremental_extract", """SELECT event_id, event_type FROM events
WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-12 12:00:00'""")
def incremental_extract(spark, sf):
    return sources.changed_between(table(spark, sf, "events"), "ts", "2024-01-10 00:00:00", "2024-01-12 12:00:00") \
        .select("event_id", "event_type")


@query("filtered_scan", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def filtered_scan(spark, sf):
    return sources.filtered_scan(table(spark, sf, "lineitem"), "l_quantity > 45 AND l_returnflag = 'R'",
                                 ["l_orderkey", "l_partkey", "l_quantity"])


@query("latest_state", """SELECT user_id AS state_key, event_id AS run_id, event_type, "value" FROM (SELECT *, row_number()
OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def latest_state(spark, sf):
    """Run states appended to a log; the newest per key is the current one."""
    states = table(spark, sf, "events").selectExpr("user_id AS state_key", "event_id AS run_id", "event_type", "value", "ts")
    path = sinks.append_log(states, fresh_path(spark, "states"))
    return sources.latest_state(spark.read.parquet(path), "state_key", ["ts", "run_id"]).drop("ts")


# --- streams ---------------------------------------------------------------------------

EVENT_RULES = [
    Rule("E-value", "out_of_range", ("value",), "range_check", {"min_value": 1, "max_value": 100}, "critical"),
    Rule("E-type", "out_of_range", ("event_type",), "range_check", {"allowed_values": ["view", "click", "purchase", "signup"]}),
    Rule("E-props", "format_inconsistency", ("props",), "regex_validate", {"pattern": r'\{"k": \d{2}\}'}),
]
_EVENT_SUSPECTS = """SELECT cast(event_id AS varchar) AS record_id, 'E-value' AS rule_id, 'critical' AS severity FROM events
WHERE "value" < 1 OR "value" > 100
UNION ALL SELECT cast(event_id AS varchar), 'E-type', 'warning' FROM events WHERE event_type = 'error'
UNION ALL SELECT cast(event_id AS varchar), 'E-props', 'warning' FROM events
WHERE NOT regexp_full_match(props, '\\{"k": [0-9]{2}\\}')"""


def event_stream(spark, sf):
    kind = table(spark, sf, "events").schema
    return spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").parquet(sf)


def drain(stream):
    """Run a stream over all that is there, and read what it wrote."""
    spark = stream.sparkSession
    path = fresh_path(spark, "stream")
    streaming.write_stream(stream, path, fresh_path(spark, "stream-state")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query("stream_validate", _EVENT_SUSPECTS)
def stream_validate(spark, sf):
    found = streaming.stream_suspects(event_stream(spark, sf), EVENT_RULES, "event_id")
    return drain(found).select("record_id", "rule_id", "severity")


@query("validate_events", _EVENT_SUSPECTS)
def validate_events(spark, sf):
    """The same rules in batch."""
    return find_first_suspects(table(spark, sf, "events"), EVENT_RULES, "event_id").select("record_id", "rule_id", "severity")


@query("stream_dedup", _EVENT_SUSPECTS)
def stream_dedup(spark, sf):
    """Every event arrives twice; each (record, rule) comes out once. The watermark covers the data."""
    twice = event_stream(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    found = streaming.stream_suspects_once(twice, EVENT_RULES, "event_id", "ts", "60 days")
    return drain(found).select("record_id", "rule_id", "severity")


@query("stream_dedup_late", f"""WITH s AS ({_EVENT_SUSPECTS}), e AS (SELECT cast(event_id AS varchar) AS id,
  ts <= (SELECT max(ts) FROM events) - INTERVAL 4 DAY AS forgotten FROM events)
SELECT record_id, rule_id, severity, CASE WHEN forgotten THEN 2 ELSE 1 END AS times FROM s JOIN e ON id = record_id""")
def stream_dedup_late(spark, sf):
    """A watermark of two days, and every event three times: as it is, again unchanged, and 60 days on.

    The second copies are late or known. Of the third, those come out again whose first copy has left the state: it is kept
    for two days of event time, and the watermark is two days behind the last event.
    """
    events, source = table(spark, sf, "events"), fresh_path(spark, "events")
    out, state = fresh_path(spark, "stream"), fresh_path(spark, "stream-state")
    for days in (0, 0, 60):
        events.withColumn("ts", F.col("ts") + F.make_interval(days=F.lit(days))).write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        found = streaming.stream_suspects_once(stream, EVENT_RULES, "event_id", "ts", "2 days")
        streaming.write_stream(found, out, state).awaitTermination()
    return spark.read.parquet(out).groupBy("record_id", "rule_id", "severity").agg(F.count("*").cast("int").alias("times"))


@query("stream_late", f"""SELECT s.*, e.ts AS event_time, e.ts <= (SELECT max(ts) FROM events) - INTERVAL 3 DAY AS late
FROM ({_EVENT_SUSPECTS}) s JOIN events e ON cast(e.event_id AS varchar) = s.record_id""")
def stream_late(spark, sf):
    """The last three days first, then everything: copies are dropped, and what lies behind the watermark of two days comes out as late."""
    events, source = table(spark, sf, "events"), fresh_path(spark, "events")
    out, state = fresh_path(spark, "stream"), fresh_path(spark, "stream-state")
    newest = events.agg(F.max("ts")).head()[0]
    for part in (F.col("ts") > F.lit(newest) - F.make_interval(days=F.lit(3)), F.lit(True)):
        events.filter(part).write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        streaming.write_stream(streaming.stream_suspects_and_late(stream, EVENT_RULES, "event_id", "ts", "2 days"), out, state,
                               empty_batches=False).awaitTermination()
    return spark.read.parquet(out).select("record_id", "rule_id", "severity", F.col("event_time").cast("timestamp_ntz").alias("event_time"), "late")


def write_shards(spark, events, path):
    """Events as a feed: a shard per user group, segments of some hundred numbers, every tenth line of one shard without number or torn."""
    image = F.struct(*events.columns)
    number = F.concat(F.lit("9" * 20), F.lpad(F.col("event_id").cast("string"), 12, "0"))  # beyond a bigint
    kind = F.expr("CASE event_id % 3 WHEN 0 THEN 'INSERT' WHEN 1 THEN 'MODIFY' ELSE 'REMOVE' END")
    micros = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    line = F.to_json(F.struct(number.alias("sequence_number"), kind.alias("event_name"), image.alias("new_image")), micros)
    bare = F.to_json(F.struct(kind.alias("event_name"), image.alias("new_image")), micros)
    lines = events.select("event_id", F.concat(F.lit("s"), F.col("user_id") % 3).alias("shard"),
                          F.concat(F.lit("9" * 20), F.lpad((F.floor(F.col("event_id") / 400) * 400).cast("string"), 12, "0")).alias("segment"),
                          F.when(F.expr("user_id % 3 = 2 AND event_id % 10 = 0"), F.when(F.col("event_id") % 20 == 0, bare).otherwise(F.left(line, F.lit(30))))
                          .otherwise(line).alias("value"))
    (lines.repartition("shard", "segment").sortWithinPartitions("shard", "segment", "event_id").drop("event_id")
     .write.mode("append").partitionBy("shard", "segment").text(path))


@query("feed_shards", """SELECT event_id, ts, user_id, event_type, "value", props, CASE event_id % 3 WHEN 0 THEN 'INSERT' ELSE 'MODIFY' END AS event_name,
  's' || user_id % 3 AS shard, '99999999999999999999' || lpad(cast(event_id AS varchar), 12, '0') AS sequence_number FROM events
WHERE event_id % 3 <> 2 AND NOT (user_id % 3 = 2 AND event_id % 10 = 0)
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, 'REJECTED', 's2', cast(count(*) AS varchar) FROM events WHERE user_id % 3 = 2 AND event_id % 10 = 0""")
def feed_shards(spark, sf):
    """Shards of unequal speed, one that begins late, and a restart from the checkpoint between; lines without number are kept apart."""
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    feed, out, state = fresh_path(spark, "feed"), fresh_path(spark, "stream"), fresh_path(spark, "stream-state")
    middle = events.agg(F.max("event_id")).head()[0] // 800 * 400
    ahead = F.expr(f"user_id % 3 = 0 AND event_id < {middle + 400} OR user_id % 3 = 2 AND event_id < {middle}")
    for part in (ahead, ~ahead):
        write_shards(spark, events.filter(part), feed)
        streaming.write_stream(sources.stream_shards(spark, feed), out, state).awaitTermination()
    lines = spark.read.parquet(out)
    rejected = sources.shard_rejects(lines, events.schema).groupBy("shard").agg(F.count("*").cast("string").alias("sequence_number"))
    return sources.shard_changes(lines, events.schema).unionByName(rejected.withColumn("event_name", F.lit("REJECTED")), allowMissingColumns=True)


@query("change_feed", """SELECT event_id, event_type, CASE event_id % 3 WHEN 0 THEN 'INSERT' ELSE 'MODIFY' END AS event_name
FROM events WHERE event_id % 3 <> 2""")
def change_feed(spark, sf):
    """Envelopes with inserts, updates and deletes, read as a stream."""
    image = T.StructType.fromDDL("event_id bigint, event_type string, value double")
    path = write_envelopes(spark, sf)
    return drain(sources.read_feed(spark, path, image, files_per_batch=2)).select("event_id", "event_type", "event_name")


def write_envelopes(spark, sf):
    envelope = F.struct(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("sequence_number"),
        F.expr("CASE event_id % 3 WHEN 0 THEN 'INSERT' WHEN 1 THEN 'MODIFY' ELSE 'REMOVE' END").alias("event_name"),
        F.struct("event_id", "event_type", "value").alias("new_image"))
    path = fresh_path(spark, "feed")
    table(spark, sf, "events").select(envelope.alias("e")).select("e.*").repartition(4).write.json(path)
    return path


@query("change_feed_after", """SELECT event_id, event_type FROM events WHERE event_id % 3 <> 2 AND event_id > 500""")
def change_feed_after(spark, sf):
    """From a sequence number on."""
    image = T.StructType.fromDDL("event_id bigint, event_type string, value double")
    return sources.read_feed_after(spark, write_envelopes(spark, sf), image, "000000000500").select("event_id", "event_type")


@query("change_feed_numbers", """SELECT s_suppkey FROM supplier WHERE s_suppkey % 7 > 2
UNION ALL SELECT s_suppkey FROM supplier WHERE s_suppkey % 7 <= 2 AND s_suppkey > 25""")
def change_feed_numbers(spark, sf):
    """After a sequence number, with numbers of different lengths, leading zeros and more digits than a bigint has."""
    number = F.expr("CASE WHEN s_suppkey % 7 > 2 THEN concat('9', lpad(cast(s_suppkey AS string), 36, '0')) "
                    "WHEN s_suppkey % 7 = 2 THEN concat('000', cast(s_suppkey AS string)) ELSE cast(s_suppkey AS string) END")
    path = fresh_path(spark, "feed")
    (table(spark, sf, "supplier").select(number.alias("sequence_number"), F.lit("INSERT").alias("event_name"), F.struct("s_suppkey").alias("new_image"))
     .write.json(path))
    return sources.read_feed_after(spark, path, T.StructType.fromDDL("s_suppkey bigint"), "25").select("s_suppkey")


@query("change_feed_bad", "SELECT count(*) AS n FROM supplier WHERE s_suppkey % 4 = 0")
def change_feed_bad(spark, sf):
    """Cut envelopes are kept aside as text."""
    envelope = F.to_json(F.struct(F.col("s_suppkey").cast("string").alias("sequence_number"), F.lit("INSERT").alias("event_name"),
                                  F.struct("s_suppkey").alias("new_image")))
    path = fresh_path(spark, "feed")
    cut = F.when(F.col("s_suppkey") % 4 == 0, F.left(envelope, F.lit(20))).otherwise(envelope)
    table(spark, sf, "supplier").select(cut.alias("value")).write.text(path)
    return sources.bad_envelopes(spark, path, T.StructType.fromDDL("s_suppkey bigint")).agg(F.count("*").alias("n"))


@query("stream_batches", f"SELECT rule_id, count(*) AS n FROM ({_EVENT_SUSPECTS}) GROUP BY rule_id")
def stream_batches(spark, sf):
    """A batch job per micro-batch: validate, append."""
    path = fresh_path(spark, "found")

    def step(batch, batch_id):
        # A batch that runs again after a failure replaces its own directory: written once.
        found = find_first_suspects(batch, EVENT_RULES, "event_id").select("record_id", "rule_id", "severity")
        found.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    streaming.each_batch(event_stream(spark, sf), step, fresh_path(spark, "stream-state")).awaitTermination()
    return spark.read.parquet(path).groupBy("rule_id").agg(F.count("*").alias("n"))


@query("stream_resume", "SELECT event_id, event_type FROM events WHERE event_id % 3 <> 2")
def stream_resume(spark, sf):
    """Two runs over one checkpoint: the second takes only the files that are new."""
    image = T.StructType.fromDDL("event_id bigint, event_type string, value double")
    source, feed = write_envelopes(spark, sf), fresh_path(spark, "feed")
    out, state = fresh_path(spark, "stream"), fresh_path(spark, "stream-state")
    envelopes = spark.read.schema(sources.envelope_schema(image)).json(source)
    for part in ("new_image.event_id % 2 = 0", "new_image.event_id % 2 = 1"):
        envelopes.filter(part).write.mode("append").json(feed)
        streaming.write_stream(sources.read_feed(spark, feed, image), out, state).awaitTermination()
    return spark.read.parquet(out).select("event_id", "event_type")
