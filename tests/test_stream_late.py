"""Once-only suspects with the late ones kept, and state that goes away."""

import datetime as dt
import json
import time

from tamis import streaming
from tamis.plans import Rule
from tamis.session import fresh_path

RULES = [Rule("low", "out_of_range", ("v",), "range_check", {"min_value": 10}), Rule("high", "out_of_range", ("v",), "range_check", {"max_value": 90}, "critical")]
START = dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc)


def test_timely_late_and_forgotten(spark):
    source, out, state = (fresh_path(spark, n) for n in ("source", "out", "state"))
    schema = "record_id string, v long, ts timestamp"

    def run(*rows):
        """(record, seconds, value) rows; returns (rows written by this run, keys in the state)."""
        data = [(r, v, None if s is None else START + dt.timedelta(seconds=s)) for r, s, v in rows]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(source)
        seen = set() if not run.seen else {tuple(map(str, r)) for r in spark.read.parquet(out).collect()}
        query = streaming.write_stream(streaming.stream_suspects_and_late(spark.readStream.schema(schema).parquet(source), RULES, "record_id", "ts", "2 seconds"),
                                       out, state, empty_batches=False)
        query.awaitTermination()
        run.seen = True
        fresh = [r for r in spark.read.parquet(out).collect() if tuple(map(str, r)) not in seen]
        return sorted((r["record_id"], r["rule_id"], r["late"]) for r in fresh), json.loads(query.lastProgress.json)["stateOperators"][0]["numRowsTotal"]

    run.seen = False
    found, kept = run(("a", 10, 1), ("a", 12, 2), ("b", 11, 95), ("fine", 11, 50))
    assert found == [("a", "low", False), ("b", "high", False)] and kept == 2
    first = [r for r in spark.read.parquet(out).collect() if r["record_id"] == "a"][0]
    assert first["event_time"].replace(tzinfo=None) == dt.datetime(2024, 5, 1, 0, 0, 10) and dict(first["current_values"]) == {"v": "1"}
    # the watermark is at 10: copies are dropped, c is behind it, d has no time
    found, _ = run(("a", 13, 3), ("a", 5, 3), ("c", 9, 1), ("c", 8, 1), ("d", None, 1), ("e", 10, 99))
    assert found == [("c", "low", True), ("d", "low", True), ("e", "high", False)]
    assert run(("c", 9, 1), ("e", 8, 99))[0] == []  # late copies of a known key
    run(("far", 1000, 1))
    time.sleep(3.5)  # timers of the clock
    _, kept = run(("end", 1001, 50))
    held = [r["key"]["record_id"] for r in spark.read.format("statestore").load(state).collect()]
    assert held == ["far"] and kept == 1
    assert run(("a", 999, 1), ("a", 10, 1))[0] == [("a", "low", False)]  # forgotten, so new again


def test_python_is_handed_buckets_and_no_row_is_lost(spark):
    """Keys lie in Spark's own state; the watermark moves with rows that are no suspects as well, and nothing behind it is dropped."""
    source, out, state = (fresh_path(spark, n) for n in ("source", "out", "state"))

    def run(rows):
        rows.select("record_id", "v", (rows.s + START.timestamp()).cast("timestamp").alias("ts")).write.mode("append").parquet(source)
        stream = spark.readStream.schema("record_id string, v long, ts timestamp").parquet(source)
        query = streaming.write_stream(streaming.stream_suspects_and_late(stream, RULES, "record_id", "ts", "2 seconds"), out, state, empty_batches=False)
        query.awaitTermination()
        return json.loads(query.lastProgress.json)["stateOperators"]

    many = spark.range(500).selectExpr("cast(id % 250 AS string) AS record_id", "if(id % 250 < 200, 5, 50) AS v", "id % 250 AS s")
    held = {o["operatorName"]: o["numRowsTotal"] for o in run(many)}
    assert held == {"dedupeWithinWatermark": 200, "applyInPandasWithState": 0}
    # the watermark is at 247, by rows that are no suspects
    again = spark.createDataFrame([("0", 95, 1), ("x", 95, 247), ("y", 95, 246), ("z", 95, None), ("z", 5, 300)], "record_id string, v long, s long")
    assert sum(o["numRowsDroppedByWatermark"] for o in run(again)) == 0
    found = {(r["record_id"], r["rule_id"]): r["late"] for r in spark.read.parquet(out).collect()}
    assert spark.read.parquet(out).count() == 205 and {k: v for k, v in found.items() if k[1] == "high"} == {
        ("0", "high"): True, ("x", "high"): False, ("y", "high"): True, ("z", "high"): True}
    assert found["z", "low"] is False and not any(v for k, v in found.items() if k[1] == "low")
    later = run(spark.createDataFrame([("sound", 50, 900)], "record_id string, v long, s long"))  # at 298: all but z of 300 have gone
    assert later[0]["numRowsTotal"] == 1
    assert spark.read.parquet(out).filter("record_id = 'z' AND rule_id = 'high'").head()["event_time"] is None
