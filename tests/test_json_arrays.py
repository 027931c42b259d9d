"""JSON arrays read by many tasks against Python's reader."""

import json
import random

import pytest

from tamis import sources
from tamis.sources.arrays import _outside

SCHEMA = "i long, t string, n struct<a:array<string>,b:long>, m map<string,string>"
NASTY = ['}', '{', '"', '\\', '\\"', '}]', '[{', '\n', '\\\\"}', 'é漢😀', ',', '', ' plain ', '"},{"', '\\u007d']


def rows_of(n, seed):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choices(NASTY, k=rng.randint(0, 6)))
    out = [{"i": i, "t": text(), "n": {"a": [text() for _ in range(rng.randint(0, 3))], "b": i}, "m": {text() or "k": text()}} for i in range(n)]
    out[n // 2]["t"] = "long }{ \\" * 3000  # reaches over several splits
    return out


@pytest.fixture
def small_splits(spark):
    key, kept = "spark.sql.files.maxPartitionBytes", {}
    for k, v in ((key, "2k"), ("spark.sql.files.openCostInBytes", "1")):
        kept[k] = spark.conf.get(k)
        spark.conf.set(k, v)
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def got(df):
    return sorted(((r["i"], r["t"], r["n"].asDict(), dict(r["m"])) for r in df.collect()), key=lambda r: r[0])


@pytest.mark.parametrize("style", [{}, {"indent": 2}, {"separators": (",", ":")}, {"ensure_ascii": False, "indent": "\t"}])
def test_as_python_reads_it(spark, tmp_path, small_splits, style):
    rows = rows_of(150, 1)
    (tmp_path / "one.json").write_text(json.dumps(rows, **style), encoding="utf-8")
    (tmp_path / "two.json").write_text("﻿ \n" + json.dumps([r | {"i": r["i"] + 1000} for r in rows[:3]], **style) + "\n\n", encoding="utf-8")
    (tmp_path / "none.json").write_text(" [ ] ")
    (tmp_path / "single.json").write_text(json.dumps(rows[4] | {"i": 5000}, **style) + "\n", encoding="utf-8")
    (tmp_path / "two_objects.json").write_text(json.dumps(rows[4] | {"i": 6000}, **style) + "\n" + json.dumps(rows[5] | {"i": 6001}, **style), encoding="utf-8")
    df = sources.read_json_array(spark, str(tmp_path), SCHEMA)
    want = rows + [r | {"i": r["i"] + 1000} for r in rows[:3]] + [rows[4] | {"i": 5000}, rows[4] | {"i": 6000}, rows[5] | {"i": 6001}]
    assert got(df) == sorted(((r["i"], r["t"], r["n"], r["m"]) for r in want), key=lambda r: r[0])
    tasks = spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions()
    assert tasks > 20


def test_what_is_no_object_is_kept_or_fails(spark, tmp_path, small_splits):
    (tmp_path / "f.json").write_text('[{"i": 1}, 17, {"i": 2}, {"i": "x{"}, {"i": 3}] tail')
    read = sources.read_json_array(spark, str(tmp_path), SCHEMA, keep_bad_elements=True).collect()
    assert sorted(r["i"] for r in read if r["_corrupt_record"] is None) == [1, 3]
    assert len([r for r in read if r["_corrupt_record"] is not None]) == 3
    with pytest.raises(Exception, match="MALFORMED|Malformed|FAILFAST"):
        sources.read_json_array(spark, str(tmp_path), SCHEMA).collect()


def test_levels_of_a_fragment():
    """Quotes, and levels with the closing brace behind, from outside and from inside a string."""
    assert _outside('[{"a": 1') == (2, 1, 0)
    assert _outside('x"') == (1, 0, -1) and _outside('{x"[') == (1, 1, 0)
    assert _outside(r'"\"{"') == (2, -1, 1)


def test_nothing(spark, tmp_path):
    (tmp_path / "e.json").write_text("")
    assert sources.read_json_array(spark, str(tmp_path), SCHEMA).collect() == []


def test_the_size_of_a_folder(spark, tmp_path):
    from tamis.session import folder_bytes

    spark.range(100).selectExpr("repeat('x', 9) AS value").coalesce(2).write.text(str(tmp_path / "t"))
    assert folder_bytes(spark, str(tmp_path / "t")) == 1000
