"""Feeds in shards: positions per shard, restarts, lines without a number."""

import json
import os

from pyspark.sql import types as T

from tamis import sources, streaming
from tamis.session import fresh_path
from tamis.sources.shards import ShardFiles, _segments, line_number

IMAGE = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType())])


def line(number, i, kind="INSERT", v="x"):
    return json.dumps({"sequence_number": number, "event_name": kind, "new_image": {"id": i, "v": v}}, ensure_ascii=False)


def write(root, shard, segment, lines, name="part-0.txt"):
    folder = f"{root}/shard={shard}/segment={segment}"
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n" * bool(lines))


def test_numbers_of_lines():
    assert line_number(line("007", 1)) == 7 and line_number(line("9" * 40, 1)) == int("9" * 40) and line_number('{"sequence_number": 5}') == 5
    assert {line_number(x) for x in ("", "{", "[1]", "7", '{"a": 1}', line(None, 1), line("x", 1), line("-3", 1), '{"sequence_number": true}')} == {None}


def test_segments_that_reach_into_a_range(tmp_path):
    root = str(tmp_path)
    for s in (0, 10, 20):
        write(root, "a", s, [line(str(n), n) for n in range(s, s + 10)])
    write(root, "b", 5, [])
    files = ShardFiles(root)
    assert files.shards() == ["a", "b"] and files.last("a") == 29 and files.last("b") is None
    picked = [[p.segment for p in _segments(files, start, {"a": end})] for start, end in (({}, "29"), ({"a": "9"}, "29"), ({"a": "12"}, "15"), ({"a": "29"}, "29"))]
    assert picked == [[0, 10, 20], [0, 10, 20], [10], [20]]
    assert ShardFiles(str(tmp_path / "nothing")).shards() == []


def test_restarts_and_late_shards(spark, tmp_path):
    root, out, state = str(tmp_path / "feed"), fresh_path(spark, "out"), fresh_path(spark, "state")
    big = 10 ** 30

    def run():
        streaming.write_stream(sources.stream_shards(spark, root), out, state).awaitTermination()
        return spark.read.schema("shard string, sequence_number string, line string").parquet(out)

    write(root, "fast", big, [line(str(big + i), i) for i in range(20)] + ["torn {"])
    write(root, "slow", 0, [line("0003", 100, "MODIFY", "é"), line(None, 101), line("4", 102, "REMOVE")])
    first = run()
    assert first.count() == 24
    write(root, "slow", 0, [line("5", 103)], "part-1.txt")  # the same segment goes on
    write(root, "slow", 6, [json.dumps([1]), line("6", 104)])
    write(root, "new", 1, [line("1", 200), line("2", 201, v=None)])
    lines = run()
    changes = sources.shard_changes(lines, IMAGE).collect()
    assert sorted((r["shard"], r["id"]) for r in changes) == sorted([("fast", i) for i in range(20)] + [("slow", i) for i in (100, 103, 104)] + [("new", 200), ("new", 201)])
    assert {(r["sequence_number"], r["v"], r["event_name"]) for r in changes if r["id"] == 100} == {("3", "é", "MODIFY")}
    assert sorted(r["line"] for r in sources.shard_rejects(lines, IMAGE).collect()) == sorted(["torn {", line(None, 101), "[1]"])
    assert lines.count() == 29 and run().count() == 29  # nothing new, nothing twice


def test_batches_after_numbers(spark, tmp_path):
    root = str(tmp_path)
    write(root, "a", 1, [line(str(i), i) for i in range(1, 9)])
    write(root, "b", 1, [line(str(i), 10 * i) for i in range(1, 4)])
    got = sources.shard_changes(sources.read_shards(spark, root, {"a": "6"}), IMAGE).collect()
    assert sorted(r["id"] for r in got) == [7, 8, 10, 20, 30]
    assert sources.read_shards(spark, str(tmp_path / "none")).collect() == []


def test_changes_without_number_do_not_vanish(spark, tmp_path):
    import pytest

    (tmp_path / "f.json").write_text("\n".join([line("1", 1), line(None, 2), line("x9", 3), line("12", 4)]))
    assert sources.bad_envelopes(spark, str(tmp_path), IMAGE).count() == 2
    assert sources.read_feed_after(spark, str(tmp_path), IMAGE).count() == 4
    with pytest.raises(Exception, match="no sequence number"):
        sources.read_feed_after(spark, str(tmp_path), IMAGE, "1").collect()


def test_many_segments_are_few_tasks_and_one_listing(tmp_path):
    from tamis.sources import shards

    for i in range(1, 1203):
        folder = tmp_path / "shard=a" / f"segment={i:06d}"
        folder.mkdir(parents=True)
        (folder / "part").write_text(f'{{"sequence_number": "{i}"}}\n')
    listed, files = [], ShardFiles(str(tmp_path))
    tasks = shards._tasks(_segments(files, {}, {"a": "1202"}))
    assert len(tasks) <= shards.TASKS and [p.segment for t in tasks for p in t.parts] == list(range(1, 1203))
    whole = ShardFiles._list
    try:
        ShardFiles._list = lambda self, path: listed.append(path) or whole(self, path)
        read = [r for t in tasks[:3] for r in shards._read(str(tmp_path), t)]
    finally:
        ShardFiles._list = whole
    assert [r[1] for r in read] == [str(p.segment) for t in tasks[:3] for p in t.parts] and all("segment=" in path for path in listed)
