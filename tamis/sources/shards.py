"""A feed in shards as a stream whose position is a sequence number per shard.

A feed is a folder ``shard=<name>/segment=<first number>/`` of text files, an envelope per line, in ascending order of their numbers; writers add
lines in new segments or files and never change old ones. The stream's offset holds, for each shard, the last number read, so a restart goes
on after that number in every shard, however far apart they are, and a shard that appears later is read from its beginning. A segment,
or a few of many, is a task, so a backlog is read in parallel. Segments and the last numbers are found by listing folders and reading the last segment of each
shard alone.

A line that is no envelope, or has no number, cannot be addressed by itself: it is delivered, as text without number, together with the numbered
line before it. ``shard_changes`` and ``shard_rejects`` tell the two kinds apart; together they are all lines, each once.

Files are read through Arrow's file systems, so the folder may be local or in an object store it knows. Python data sources run in
Python on the executors, which need this package.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .feed import envelope_schema

TASKS = 500  # at most so many read at a time
LINE = "shard string, sequence_number string, line string"


def line_number(line: str) -> int | None:
    """The sequence number of an envelope, of any length."""
    try:
        number = json.loads(line).get("sequence_number")
    except (ValueError, AttributeError):
        return None
    return int(number) if isinstance(number, str) and re.fullmatch(r"[0-9]+", number) else number if type(number) is int else None


class ShardFiles:
    """Shards, segments and lines of a folder."""

    def __init__(self, path: str):
        from pyarrow import fs

        self._fs, self._root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))

    def _list(self, path: str):
        from pyarrow import fs

        return sorted(self._fs.get_file_info(fs.FileSelector(path, allow_not_found=True)), key=lambda i: i.path)

    def _named(self, path: str, key: str) -> list[str]:
        return [i.base_name[len(key) + 1:] for i in self._list(path) if not i.is_file and i.base_name.startswith(f"{key}=")]

    def shards(self) -> list[str]:
        return self._named(self._root, "shard")

    def named_segments(self, shard: str) -> dict[int, list[str]]:
        """The names of each segment (one, but for zeros in front), in ascending order; lists the shard's folder."""
        found: dict[int, list[str]] = {}
        for name in self._named(f"{self._root}/shard={shard}", "segment"):
            found.setdefault(int(name), []).append(name)
        return dict(sorted(found.items()))

    def segments(self, shard: str) -> list[int]:
        return list(self.named_segments(shard))

    def lines(self, shard: str, segment: int, names: list[str] | None = None) -> Iterator[tuple[int, bool, str]]:
        """(number, or that of the line before; whether it is the line's own; line) in order. With its ``names`` at hand the shard is not listed."""
        folder = f"{self._root}/shard={shard}"
        for name in self.named_segments(shard).get(segment, []) if names is None else names:
            for info in self._list(f"{folder}/segment={name}"):
                if not info.is_file or info.base_name[0] in "._":
                    continue
                last = segment
                with self._fs.open_input_stream(info.path) as raw:
                    for line in _text_lines(raw):
                        number = line_number(line)
                        last = last if number is None else number
                        yield last, number is not None, line

    def last(self, shard: str) -> int | None:
        for segment, names in reversed(self.named_segments(shard).items()):
            numbers = [n for n, _, _ in self.lines(shard, segment, names)]
            if numbers:
                return max(numbers)
        return None


def _text_lines(raw, size: int = 1 << 20) -> Iterator[str]:
    rest = b""
    while block := raw.read(size):
        *whole, rest = (rest + block).split(b"\n")
        for line in whole:
            if line.strip():
                yield line.decode("utf-8", "replace")
    if rest.strip():
        yield rest.decode("utf-8", "replace")


class _Segment(InputPartition):
    def __init__(self, shard: str, segment: int, after: int, upto: int, names: list[str] | None = None):
        self.shard, self.segment, self.after, self.upto, self.names = shard, segment, after, upto, names


class _Segments(InputPartition):
    def __init__(self, parts: list[_Segment]):
        self.parts = parts


def _segments(files: ShardFiles, start: dict, end: dict) -> list[_Segment]:
    """The segments that reach into (start, end] of each shard."""
    out = []
    for shard, upto in end.items():
        after, named = int(start.get(shard, -1)), files.named_segments(shard)
        found = list(named)
        for i, first in enumerate(found):
            if first <= int(upto) and (i + 1 == len(found) or found[i + 1] > after):
                out.append(_Segment(shard, first, after, int(upto), named[first]))
    return out


def _tasks(segments: list[_Segment]) -> list[_Segments]:
    """A task per segment, or, of many, tasks of as many neighbours each."""
    size = max(1, -(-len(segments) // TASKS))
    return [_Segments(segments[i:i + size]) for i in range(0, len(segments), size)]


def _read(path: str, task: _Segments | None):
    files = ShardFiles(path)
    for part in task.parts if task else []:  # none: a feed without segments
        for number, own, line in files.lines(part.shard, part.segment, part.names):
            if part.after < number <= part.upto:
                yield part.shard, str(number) if own else None, line


def _ends(files: ShardFiles) -> dict[str, str]:
    last = {s: files.last(s) for s in files.shards()}
    return {s: str(n) for s, n in last.items() if n is not None}  # text: numbers may be longer than JSON readers keep


class _ShardStream(DataSourceStreamReader):
    def __init__(self, path: str, start: dict):
        self._path, self._start = path, start

    def initialOffset(self) -> dict:
        return self._start

    def latestOffset(self) -> dict:
        return self._start | _ends(ShardFiles(self._path))

    def partitions(self, start: dict, end: dict):
        return _tasks(_segments(ShardFiles(self._path), start, end))

    def read(self, partition):
        return _read(self._path, partition)


class _ShardBatch(DataSourceReader):
    def __init__(self, path: str, start: dict):
        self._path, self._start = path, start

    def partitions(self):
        files = ShardFiles(self._path)
        return _tasks(_segments(files, self._start, _ends(files)))

    def read(self, partition):
        return _read(self._path, partition)


class ShardFeed(DataSource):
    """Options: ``path``, and ``after``, a JSON object of shard and number, for where to begin without a checkpoint."""

    @classmethod
    def name(cls):
        return "shard_feed"

    def schema(self):
        return LINE

    def _start(self) -> dict:
        return json.loads(self.options.get("after") or "{}")

    def streamReader(self, schema):
        return _ShardStream(self.options["path"], self._start())

    def reader(self, schema):
        return _ShardBatch(self.options["path"], self._start())


def _reader(spark: SparkSession, reader, path: str, after: dict | None) -> DataFrame:
    spark.dataSource.register(ShardFeed)
    return reader.format("shard_feed").option("after", json.dumps(after or {})).load(path)


def stream_shards(spark: SparkSession, path: str, after: dict | None = None) -> DataFrame:
    """The lines of a feed as a stream: shard, sequence_number, line. The checkpoint resumes it; ``after`` says where to begin without one."""
    return _reader(spark, spark.readStream, path, after)


def read_shards(spark: SparkSession, path: str, after: dict | None = None) -> DataFrame:
    """The same in batch, all lines or those after a number per shard."""
    return _reader(spark, spark.read, path, after)


def _parsed(lines: DataFrame, image: T.StructType) -> DataFrame:
    schema = T.StructType([*envelope_schema(image), T.StructField("_corrupt_record", T.StringType())])
    parsed = F.from_json("line", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.withColumn("_e", parsed).withColumn("_fine", F.col("sequence_number").isNotNull() & F.col("_e._corrupt_record").isNull())


def shard_changes(lines: DataFrame, image: T.StructType) -> DataFrame:
    """New images of inserts and updates, with event_name, shard and sequence_number."""
    return (_parsed(lines, image).filter("_fine").filter(F.col("_e.event_name").isin("INSERT", "MODIFY"))
            .select("_e.new_image.*", "_e.event_name", "shard", "sequence_number"))


def shard_rejects(lines: DataFrame, image: T.StructType) -> DataFrame:
    """Lines that do not parse as envelopes of this image, or have no number: shard, line."""
    return _parsed(lines, image).filter("NOT _fine").select("shard", "line")
