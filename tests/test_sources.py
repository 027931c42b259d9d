"""Files, tables, sinks and streams."""

import gzip
import json

import pytest
from pyspark.sql import functions as F, types as T

from parcels import SCHEMA, records
from plain import rows
from tamis import sinks, sources, streaming
from tamis.operators.suspects import find_first_suspects
from tamis.plans import DEFAULT_RULES
from tamis.sources import files


def write(path, text, zipped=False):
    path.parent.mkdir(exist_ok=True, parents=True)
    (gzip.open if zipped else open)(path, "wt", encoding="utf-8").write(text)
    return str(path.parent)


def test_json_lines(spark, tmp_path):
    d = write(tmp_path / "a" / "x.jsonl", '{"a": 1}\n\n{"a": 2, "b": "y"}\n')
    assert rows(sources.read_json_lines(spark, d, "a int, b string")) == [(1, None), (2, "y")]
    d = write(tmp_path / "b" / "x.jsonl", '{"a": 1}\n{"a":\n')
    with pytest.raises(Exception):
        sources.read_json_lines(spark, d, "a int").collect()
    kept = sources.read_json_lines(spark, d, "a int", keep_bad_lines=True).select("a", "_corrupt_record")
    assert rows(kept) == [(1, None), (None, '{"a":')]


def test_json_array_and_object(spark, tmp_path):
    d = write(tmp_path / "a" / "x.json", '[{"a": 1},\n {"a": 2}]')
    write(tmp_path / "a" / "y.json", '{\n"a": 3}')
    assert rows(sources.read_json_documents(spark, d, "a int")) == [(1,), (2,), (3,)]


def test_ragged_csv_fails_or_is_kept(spark, tmp_path):
    d = write(tmp_path / "a" / "x.csv", 'id,n\n1,a\n2,b,c\n3\n4,"d\ne"\n')
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        sources.read_csv_text(spark, d).select("id").collect()
    kept = sources.read_csv_text(spark, d, line_breaks_in_cells=True, keep_bad_records=True).collect()
    assert [(r["id"], r["n"]) for r in kept] == [("1", "a"), (None, None), (None, None), ("4", "d\ne")]
    assert [r["_corrupt_record"] for r in kept] == [None, "2,b,c", "3", None]


def test_csv_with_bom_quotes_and_mixed_cells(spark, tmp_path):
    d = write(tmp_path / "a" / "x.csv", '﻿id,n,f,t,e\n1, 7 ,1.5,"a,""b""",\n2,1_000,3,5,\n')
    df = sources.coerce_csv(sources.read_csv_text(spark, d))
    assert df.columns == ["id", "n", "f", "t", "e"]
    assert [t for _, t in df.dtypes] == ["bigint", "bigint", "double", "string", "string"]
    assert rows(df) == [(1, 7, 1.5, 'a,"b"', None), (2, 1000, 3.0, "5", None)]


def test_typed_json(spark, tmp_path):
    lines = [{"Item": {"id": {"N": "1"}, "x": {"N": "1.5"}, "ok": {"BOOL": True}, "s": {"NULL": True},
                       "tags": {"L": [{"S": "a"}, {"N": "2"}]}, "m": {"M": {"k": {"S": "v"}, "n": {"N": "3"}}}, "set": {"SS": ["q"]}}},
             {"id": {"N": "2"}, "s": {"S": "text"}, "ok": {"BOOL": False}}]
    d = write(tmp_path / "a" / "x.json.gz", "\n".join(json.dumps(x) for x in lines), zipped=True)
    df = sources.read_typed_json(spark, d, "id int, x double, ok boolean, s string, tags array<string>, m struct<k:string,n:int>, "
                                           "`set` string", partitions=2)
    a, b = sorted(df.collect())
    assert (a["id"], a["x"], a["ok"], a["s"], a["tags"], tuple(a["m"]), a["set"]) == (
        1, 1.5, True, None, ["a", "2"], ("v", 3), '{"SS":["q"]}')
    assert (b["id"], b["x"], b["ok"], b["s"], b["tags"]) == (2, None, False, "text", None)


def test_typed_json_schema_is_found(spark, tmp_path):
    lines = [{"Item": {"id": {"N": "1"}, "x": {"N": "1"}, "ok": {"BOOL": True}, "s": {"NULL": True}}},
             {"Item": {"id": {"N": "2"}, "x": {"N": "1.5"}, "s": {"S": "t"}}}]
    d = write(tmp_path / "a" / "x.json", "\n".join(json.dumps(x) for x in lines))
    df = sources.read_typed_json(spark, d)
    assert df.dtypes == [("id", "bigint"), ("ok", "boolean"), ("s", "string"), ("x", "double")]
    assert rows(df) == [(1, True, None, 1.0), (2, None, "t", 1.5)]


def test_projection_and_order(spark):
    df = spark.createDataFrame([(1, 2, 3)], "c int, b int, a int")
    assert sources.project(df, ["a", "zz"]).collect() == [(3, None)]
    assert sources.display_order(df, ["b", "zz"]).columns == ["b", "a", "c"]
    assert sources.head_sample(df, 5).count() == 1


def test_filters_reach_the_scan(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    text = sources.changed_between(events, "ts", "2024-01-02", "2024-01-03").select("event_id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in text and "LessThan(ts" in text


def test_upsert_and_versions(spark, tmp_path):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    out = sinks.upsert(base, spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string"), "k")
    path = sinks.write_version(out, str(tmp_path), "1")
    assert rows(spark.read.parquet(path)) == [(1, "a"), (2, "B"), (3, "c")]
    with pytest.raises(Exception):
        sinks.write_version(out, str(tmp_path), "1")


def test_whole_numbers_beyond_bigint_are_kept(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,w,h\n1,98765432109876543210,%s\n2,3,4\n" % ("9" * 50))
    out = sources.coerce_csv(sources.read_csv_text(spark, str(tmp_path / "a.csv")))
    assert [t for _, t in out.dtypes] == ["bigint", "decimal(38,0)", "string"]
    assert {str(r["w"]) for r in out.collect()} == {"98765432109876543210", "3"} and {r["h"] for r in out.collect()} == {"9" * 50, "4"}
    (tmp_path / "t.json").write_text('{"a": {"N": "98765432109876543210"}, "b": {"N": "1E+20"}, "c": {"N": "7"}}\n')
    (row,) = sources.read_typed_json(spark, str(tmp_path / "t.json")).collect()
    assert (int(row["a"]), int(row["b"]), row["c"]) == (98765432109876543210, 10 ** 20, 7)


def test_upsert_takes_one_update_per_key(spark):
    base = spark.createDataFrame([(1, "a", 0)], "k int, v string, n int")
    updates = spark.createDataFrame([(1, "late", 2), (1, "early", 1), (2, "x", 0), (2, "x", 0)], "k int, v string, n int")
    assert rows(sinks.upsert(base, updates, "k", "n")) == [(1, "late", 2), (2, "x", 0)]


def test_feed_numbers_and_bad_envelopes(spark, tmp_path):
    image = T.StructType.fromDDL("a int")
    lines = ['{"sequence_number": "%s", "event_name": "INSERT", "new_image": {"a": %d}}' % (n, i) for i, n in enumerate(
        ["99", "900", "1000", "00901", "9" * 40, "1" + "0" * 40])]
    good, bad = tmp_path / "good", tmp_path / "bad"
    good.mkdir(), bad.mkdir()
    (good / "f.json").write_text("\n".join(lines))
    (bad / "f.json").write_text("\n".join([lines[0], lines[1][:30]]))
    assert sorted(r["a"] for r in sources.read_feed_after(spark, str(good), image, "900").collect()) == [2, 3, 4, 5]
    with pytest.raises(Exception):
        sources.read_feed_after(spark, str(bad), image).collect()
    assert rows(sources.bad_envelopes(spark, str(bad), image)) == [(lines[1][:30],)] and sources.bad_envelopes(spark, str(good), image).isEmpty()


def test_logs_append_and_newest_state(spark, tmp_path):
    for n in (1, 2):
        sinks.append_log(spark.createDataFrame([("k", n, f"v{n}")], "key string, at int, v string"), str(tmp_path / "log"))
    assert rows(sources.latest_state(spark.read.parquet(str(tmp_path / "log")), "key", "at")) == [("k", 2, "v2")]


def test_profile_log_is_partitioned_by_table(spark, tmp_path):
    path = str(tmp_path / "p")
    sinks.write_profiles(spark.createDataFrame([("c", 0.5)], "column_name string, null_rate double"), path, "t", "2024-01-01")
    text = spark.read.parquet(path).filter("table_name = 't'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(table_name" in text


IMAGE = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("v", T.StringType())])


def envelopes(path, *rows_):
    path.mkdir(exist_ok=True)
    (path / f"{len(list(path.iterdir()))}.json").write_text("\n".join(json.dumps(
        {"sequence_number": f"{i:04d}", "event_name": kind, "new_image": {"id": i, "v": "x"}}) for i, kind in rows_))


def run(stream, tmp_path, name):
    streaming.write_stream(stream, str(tmp_path / name), str(tmp_path / f"{name}-state")).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / name))


def test_feed_keeps_inserts_and_updates_and_resumes(spark, tmp_path):
    feed = tmp_path / "feed"
    envelopes(feed, (1, "INSERT"), (2, "REMOVE"), (3, "MODIFY"))
    read = lambda: sources.read_feed(spark, str(feed), IMAGE)
    assert rows(run(read(), tmp_path, "out"), "id") == [(1,), (3,)]
    envelopes(feed, (4, "INSERT"))
    assert rows(run(read(), tmp_path, "out"), "id") == [(1,), (3,), (4,)]
    assert rows(sources.read_feed_after(spark, str(feed), IMAGE, "0001"), "id") == [(3,), (4,)]


@pytest.fixture(scope="module")
def parcel_files(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("parcels"))
    df = spark.createDataFrame(records(), SCHEMA).withColumn(
        "seen_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("record_id").cast("int")))
    df.unionByName(df).repartition(3).write.mode("overwrite").parquet(path)
    return path, df


def test_stream_finds_what_batch_finds(spark, tmp_path, parcel_files):
    path, df = parcel_files
    once = rows(find_first_suspects(df, DEFAULT_RULES), "record_id", "rule_id", "reason")
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    twice = run(streaming.stream_suspects(stream(), DEFAULT_RULES), tmp_path, "all")
    assert rows(twice, "record_id", "rule_id", "reason") == sorted(once * 2, key=repr)
    dedup = run(streaming.stream_suspects_once(stream(), DEFAULT_RULES, "record_id", "seen_at", "1 day"), tmp_path, "once")
    assert rows(dedup, "record_id", "rule_id", "reason") == once


def test_each_batch(spark, tmp_path, parcel_files):
    path, df = parcel_files
    out = str(tmp_path / "batches")

    def step(batch, number):
        find_first_suspects(batch, DEFAULT_RULES).write.mode("overwrite").parquet(f"{out}/batch={number}")

    streaming.each_batch(spark.readStream.schema(df.schema).parquet(path), step, str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(out).count() == 2 * find_first_suspects(df, DEFAULT_RULES).count()


def test_csv_cells_are_read_once(spark):
    """Two patterns per column find its type, however many kinds of cells there are."""
    rows = [("1", "1", "1", "1", "1", "", "a"), ("2_0", "9" * 19, "9" * 39, "1.5", "x", None, "1"), (" 3 ", "-4", "5", "inf", None, "", None)]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} string" for i in range(7)))
    assert sources.csv_types(df) == dict(zip(df.columns, ("integer", "wide", "string", "float", "string", "string", "string")))
    assert files._type_bits(df)._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") == 2 * 7
    assert sources.csv_types(df.limit(0)) == {c: "string" for c in df.columns}
