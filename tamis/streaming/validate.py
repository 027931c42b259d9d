"""Rules on streams."""

from __future__ import annotations

from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.suspects import find_first_suspects


BUCKETS = 4096  # of keys that are handed to Python at once


def _latest(batches):
    """The latest time of a task, if it has one."""
    import pyarrow as pa
    import pyarrow.compute as pc

    last = None
    for b in batches:
        here = pc.max(b.column(0))
        last = here if last is None or not last.is_valid or (here.is_valid and here.as_py() > last.as_py()) else last
    if last is not None and last.is_valid:
        yield pa.RecordBatch.from_arrays([pa.array([last.as_py()], last.type)], names=["event_time"])


def stream_suspects(stream: DataFrame, rules, key: str = "record_id") -> DataFrame:
    """Suspects of a stream: the same projection as in batch, stateless, append mode."""
    return find_first_suspects(stream, rules, key)


def stream_suspects_once(stream: DataFrame, rules, key: str, event_time: str, late_by: str = "1 hour") -> DataFrame:
    """Each (record, rule) once, though a record may come again within the watermark.

    State holds the keys seen since the watermark. Rows later than ``late_by`` are dropped by
    Spark, so it must cover how far apart copies of a record can be.
    """
    stamped = (stream.withColumn("event_time", F.col(event_time).cast("timestamp"))
               .withWatermark("event_time", late_by))
    return (find_first_suspects(stamped, rules, key, carry=["event_time"])
            .dropDuplicatesWithinWatermark(["record_id", "rule_id"]))


def stream_suspects_and_late(stream: DataFrame, rules, key: str, event_time: str, late_by: str = "1 hour") -> DataFrame:
    """Each (record, rule) once, and what comes too late to tell, apart: suspects with event_time and a column ``late``.

    A suspect behind the watermark, or without a time, is not lost: if its key is still known it is a copy, else it comes out with ``late`` true.
    Others come out the first time, the earliest of a micro-batch. A key is kept until the watermark has passed that time (of late ones the watermark
    when they came) by ``late_by``; copies in between are dropped. Keys are held in Spark's state store, a time each, and are let go by Spark with
    a micro-batch. Only the watermark has to be asked for in Python: by buckets of keys, which keep no state, each with the keys of one micro-batch.
    """
    stamped = stream.withColumn("event_time", F.col(event_time).cast("timestamp")).withWatermark("event_time", late_by)
    found = find_first_suspects(stamped, rules, key, carry=["event_time"])
    rest = [c for c in found.columns if c not in ("record_id", "rule_id", "event_time")]
    # the columns that settle ties come first
    text = F.to_json(F.struct(*rest, F.unix_micros("event_time").alias("event_time")), {"ignoreNullFields": "false"})
    at = F.coalesce(F.unix_millis("event_time"), F.lit(-1)).alias("at")
    packed = found.select(F.pmod(F.xxhash64("record_id", "rule_id"), F.lit(BUCKETS)).alias("bucket"), "record_id", "rule_id", "event_time", at, text.alias("suspect"))
    # the second watermark is to move as the first does, also by rows that are no suspects: a row per task, without a suspect
    latest = stamped.select("event_time").mapInArrow(_latest, "event_time timestamp").select(
        F.lit(BUCKETS).cast("long"), F.lit(None).cast("string"), F.lit(None).cast("string"), "event_time", at, F.lit(None).cast("string"))

    def first_of_batch(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        """Of each key the earliest timely suspect, else the earliest, and the time that it is kept from: it lies ahead of the watermark, so Spark drops none."""
        watermark, best, newest = state.getCurrentWatermarkMs(), {}, None
        for f in frames:
            for record_id, rule_id, at, suspect in zip(f["record_id"], f["rule_id"], f["at"], f["suspect"]):
                if suspect is None:
                    newest = at if newest is None else max(newest, at)
                    continue
                row, known = (at < watermark, at, suspect), best.get((record_id, rule_id))
                if known is None or row < known:
                    best[record_id, rule_id] = row
        out = [(*k, suspect, late, max(at * 1000, watermark * 1000 + 1)) for k, (late, at, suspect) in best.items()]
        out += [] if newest is None else [(None, None, None, False, newest * 1000)]
        yield pd.DataFrame(out, columns=["record_id", "rule_id", "suspect", "late", "kept_from"])

    first = packed.union(latest).groupBy("bucket").applyInPandasWithState(
        first_of_batch, "record_id string, rule_id string, suspect string, late boolean, kept_from long", "none long", "append", GroupStateTimeout.NoTimeout)
    # the filter names the time, else Spark would move it below the watermark
    once = (first.withColumn("kept_from", F.timestamp_micros("kept_from")).withWatermark("kept_from", late_by)
            .filter("suspect IS NOT NULL OR kept_from IS NULL").dropDuplicatesWithinWatermark(["record_id", "rule_id"]))
    schema = T.StructType([T.StructField("event_time", T.LongType()) if f.name == "event_time" else f for f in found.schema if f.name in (*rest, "event_time")])
    return once.select("record_id", "rule_id", F.from_json("suspect", schema).alias("p"), "late").select(
        "record_id", "rule_id", *[f"p.{c}" for c in rest], F.timestamp_micros("p.event_time").alias("event_time"), "late")


def each_batch(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str,
               available_now: bool = True) -> StreamingQuery:
    """Run a batch job (validate, judge, report ...) on every micro-batch; resumes from the checkpoint."""
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def write_stream(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True, empty_batches: bool = True) -> StreamingQuery:
    """Append a stream to parquet with exactly-once file commits.

    Without ``empty_batches`` Spark runs no micro-batch that has no data. A run over what is there (``available_now``) needs that if the stream has
    timers of the clock: such a stream always wants one more batch, and the run would not end.
    """
    writer = (stream.writeStream.outputMode("append").format("parquet")
              .option("path", path).option("checkpointLocation", checkpoint))
    conf, key = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(key)
    conf.set(key, str(empty_batches and before == "true").lower())
    try:  # a query keeps the settings it was started with
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        conf.set(key, before)
