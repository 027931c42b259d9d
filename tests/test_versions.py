"""Keyed tables in versions: what a change writes, what it carries over, and what older versions still read."""

import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F

from plain import rows
from tamis import sinks
from tamis.session import fresh_path, list_folder, shared_folder
from tamis.sinks import versions


def table_of(spark, n=1000, files=10, start=0):
    root = fresh_path(spark, "table")
    df = spark.range(start, start + 2 * n, 2).selectExpr("id AS k", "concat('v', id) AS v", "id % 7 AS w")
    assert sinks.create_table(df.repartition(3), root, "k", files=files) == 0
    return root


def files_of(spark, root, version=None):
    return {r["file"]: r["rows"] for r in sinks.manifest(spark, root, version).collect()}


def test_one_changed_key_rewrites_one_file(spark):
    root = table_of(spark)
    before = files_of(spark, root)
    assert len(before) == 10 and sum(before.values()) == 1000
    assert sinks.upsert_table(spark, root, spark.createDataFrame([(500, "new", 0)], "k long, v string, w long")) == 1
    after = files_of(spark, root)
    assert len(before.keys() - after.keys()) == 1 and len(after.keys() - before.keys()) == 1 and sum(after.values()) == 1000
    assert sinks.read_table(spark, root).filter("k = 500").collect() == [(500, "new", 0)]
    assert sinks.read_table(spark, root, 0).filter("k = 500").collect() == [(500, "v500", 3)]
    assert sinks.read_table(spark, root).filter("v <> concat('v', k)").count() == 1
    assert not any(n.startswith(("upsert-", "table-") ) and glob.glob(f"{shared_folder(spark)}/tamis/{n}/changes*") for n in list_folder(spark, shared_folder(spark) + "/tamis"))


def test_keys_between_are_added_without_rewriting(spark):
    """Odd keys lie within the bounds of files, but hit their filters seldom."""
    root = table_of(spark, 4000, 8)
    before = files_of(spark, root)
    sinks.upsert_table(spark, root, spark.createDataFrame([(1001, "x"), (99_999, "y")], "k long, v string"))
    after = files_of(spark, root)
    assert len(before.keys() - after.keys()) <= 1 and sum(after.values()) == 4002
    assert sinks.read_table(spark, root).filter("k IN (1001, 99999)").orderBy("k").collect() == [(1001, "x", None), (99_999, "y", None)]
    sinks.upsert_table(spark, root, spark.createDataFrame([(1001, "z"), (3, "no")], "k long, v string"), insert=False)
    assert sinks.read_table(spark, root).filter("k IN (3, 1001)").collect() == [(1001, "z", None)]


def test_filters_pass_few_foreign_keys_and_every_own_one(spark):
    root = table_of(spark, 5000, 4)
    now = sinks.manifest(spark, root)
    own = spark.range(0, 10_000, 2).select(F.struct(F.col("id").alias("k0")).alias("key"))
    assert set(versions.files_with(spark, now, own, fresh_path(spark, "x"))) == set(files_of(spark, root))
    hit = [bool(versions.files_with(spark, now, spark.createDataFrame([((i,),)], "key struct<k0:long>"), fresh_path(spark, "x"))) for i in range(1, 1200, 60)]
    assert sum(hit) <= 4
    outside = spark.createDataFrame([((-5,),), ((20_000,),)], "key struct<k0:long>")
    assert versions.files_with(spark, now, outside, fresh_path(spark, "x")) == []


def test_against_a_dictionary(spark):
    """Rounds of changes with repeated, new, missing and NULL keys; every version stays what it was."""
    root = fresh_path(spark, "table")
    state = {(i % 40, f"n{i % 11}"): (i, None) for i in range(300)} | {(None, "a"): (1, "x"), (3, None): (2, "y"), (None, None): (3, None)}
    schema = "a int, b string, n long, t string"
    sinks.create_table(spark.createDataFrame([(*k, *v) for k, v in state.items()], schema), root, ["a", "b"], files=5)
    history = [dict(state)]
    for r in range(2):
        new = [((i * 7 + r) % 55 if i % 9 else None, f"n{i % 13}" if i % 8 else None, r * 1000 + i) for i in range(0, 60)]
        sinks.upsert_table(spark, root, spark.createDataFrame(new, "a int, b string, n long"), order="n", rows_per_file=30)
        for a, b, n in new:
            state[a, b] = (n, state.get((a, b), (None, None))[1])
        gone = [((i * 5 + r) % 50 if i else None, f"n{(i + r) % 11}") for i in range(25)]
        sinks.delete_rows(spark, root, spark.createDataFrame([(None, None), *gone] if r == 1 else gone, "a int, b string"))
        history.append(None)  # the version between
        for k in gone + [(None, None)] * (r == 1):
            state.pop(k, None)
        history.append(dict(state))
    for version, want in enumerate(history):
        if want is not None:
            got = sinks.read_table(spark, root, version).collect()
            assert sorted(map(tuple, got), key=repr) == sorted(((*k, *v) for k, v in want.items()), key=repr), version
    files = len(files_of(spark, root))
    last = sinks.compact_table(spark, root, 1000)
    assert len(files_of(spark, root)) == 1 < files and rows(sinks.read_table(spark, root)) == rows(sinks.read_table(spark, root, last - 1))
    assert sinks.compact_table(spark, root, 1000) == last


def test_restore_writes_a_manifest_only(spark):
    root = table_of(spark, 50, 3)
    sinks.delete_rows(spark, root, spark.createDataFrame([(4,), (6,), (7,)], "k long"))
    data = set(glob.glob(f"{root}/data/**", recursive=True))
    assert sinks.restore_version(spark, root, 0) == 2 == sinks.latest_version(spark, root)
    assert set(glob.glob(f"{root}/data/**", recursive=True)) == data
    assert rows(sinks.read_table(spark, root)) == rows(sinks.read_table(spark, root, 0)) and sinks.read_table(spark, root, 1).count() == 48


def test_two_writers_of_one_version(spark):
    root = table_of(spark, 20, 2)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        versions._publish(sinks.manifest(spark, root), root, 0)
    with pytest.raises(ValueError, match="has no version"):
        sinks.latest_version(spark, fresh_path(spark, "nothing"))
    with pytest.raises(ValueError, match="key column"):
        sinks.upsert_table(spark, root, spark.createDataFrame([("x",)], "v string"))


def test_empty_tables_and_timestamps(spark):
    root = fresh_path(spark, "table")
    at = [dt.datetime(2024, 1, 1, h) for h in range(24)]
    sinks.create_table(spark.createDataFrame([], "t timestamp, file string"), root, "t")
    assert sinks.read_table(spark, root).collect() == []
    sinks.upsert_table(spark, root, spark.createDataFrame([(t, "a") for t in at], "t timestamp, file string"), rows_per_file=5)
    assert len(files_of(spark, root)) == 5
    sinks.upsert_table(spark, root, spark.createDataFrame([(at[7], "b")], "t timestamp, file string"), rows_per_file=5)
    assert len(files_of(spark, root, 1).keys() - files_of(spark, root).keys()) == 1
    assert [r["file"] for r in sinks.read_table(spark, root).orderBy("t").collect()] == ["a"] * 7 + ["b"] + ["a"] * 16
    sinks.delete_rows(spark, root, spark.createDataFrame([(t,) for t in at], "t timestamp"))
    assert sinks.read_table(spark, root).collect() == [] and files_of(spark, root) == {}


def test_changes_are_not_broadcast(spark, monkeypatch):
    """Keys take little room in files and much in memory: whatever their files' size, they meet filters and rows in shuffles."""
    root, plans, write = table_of(spark), {}, versions.materialise

    def noting(df, name, path=None):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name, path)

    monkeypatch.setattr(versions, "materialise", noting)
    sinks.upsert_table(spark, root, spark.range(0, 2000, 50).selectExpr("id AS k", "'new' AS v"))
    sinks.upsert_table(spark, root, spark.range(0, 2000, 50).selectExpr("id AS k", "'newer' AS v"), insert=False)
    sinks.delete_rows(spark, root, spark.range(0, 2000, 100).selectExpr("id AS k"))
    assert sinks.read_table(spark, root).filter("v = 'newer'").count() == 20 and sinks.read_table(spark, root).count() == 980
    assert len(plans["hits"]) == len(plans["fresh"]) == 3
    # the filters' files are named by a broadcast of a row per file, below the sorts
    for plan in plans["fresh"]:
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    for plan in plans["hits"]:
        assert "SortMergeJoin [file" in plan and ", bucket#" in plan.split("SortMergeJoin")[1].split("\n")[0]
