"""Judge calls in committed rounds: what is asked again, and what is not."""

import json
import time

import pytest
from pyspark.sql import functions as F

from tamis.operators import judge
from tamis.session import fresh_path, list_folder, shared_folder


def items_of(spark, n=40, text="t"):
    return spark.createDataFrame([(f"r{i}", "q", f"{text}{i}", i) for i in range(n)], "record_id string, rule_id string, note string, n int")


def speaker(name, refuse=None, fail=None):
    def judge_items(batch):
        if refuse is not None and any(i["n"] % 4 == refuse for i in batch):
            raise PermissionError("no more credit")
        if fail is not None and any(i["n"] % 4 == fail for i in batch):
            raise TimeoutError("too slow")
        return json.dumps([{"record_id": i["record_id"], "rule_id": i["rule_id"], "is_error": True, "evidence": name} for i in batch]), len(batch), 1

    return judge_items


def said(calls, items):
    found, failed = judge.settled(calls, items)
    return ({(r["record_id"], r["reasoning"]) for r in found.collect()}, {(r["record_id"], r["error"]) for r in failed.collect()})


def test_a_hard_failure_loses_one_round(spark):
    items, ledger = items_of(spark), fresh_path(spark, "ledger")
    with pytest.raises(Exception, match="no more credit"):
        judge.judge_in_rounds(items, speaker("first", refuse=2), ledger, rounds=4, deal=F.col("n"), batch_size=3)
    done = judge.read_ledger(spark, ledger)
    assert done.agg(F.sum("input_tokens")).head()[0] == 20
    assert not any(n.startswith("open-items") for n in list_folder(spark, shared_folder(spark) + "/tamis"))
    calls = judge.judge_in_rounds(items, speaker("second"), ledger, rounds=4, deal=F.col("n"), batch_size=3)
    found, failed = said(calls, items)
    assert found == {(f"r{i}", "first" if i % 4 < 2 else "second") for i in range(40)} and not failed
    assert calls.agg(F.sum("input_tokens")).head()[0] == 40  # every item once
    assert calls.count() == calls.select("batch_id").distinct().count()
    again = judge.judge_in_rounds(items, speaker("third", refuse=0), ledger)  # nothing is left to ask
    assert said(again, items) == (found, failed)


def test_failed_calls_and_changed_items_are_asked_again(spark):
    items, ledger = items_of(spark, 12), fresh_path(spark, "ledger")
    calls = judge.judge_in_rounds(items, speaker("first", fail=1), ledger, retries=0, batch_size=1, round_items=5)
    assert len([n for n in list_folder(spark, ledger) if n.startswith("round-")]) >= 2
    found, failed = said(calls, items)
    assert found == {(f"r{i}", "first") for i in range(12) if i % 4 != 1} and failed == {(f"r{i}", "too slow") for i in (1, 5, 9)}
    found, failed = said(judge.judge_in_rounds(items, speaker("second"), ledger), items)
    assert found == {(f"r{i}", "second" if i % 4 == 1 else "first") for i in range(12)} and not failed
    changed = items.withColumn("note", F.when(F.col("n") < 2, "new").otherwise(F.col("note")))
    calls = judge.judge_in_rounds(changed, speaker("third"), ledger)
    assert {r for r in said(calls, changed)[0] if r[1] == "third"} == {("r0", "third"), ("r1", "third")}
    assert said(calls, items)[0] == found  # the old items keep their answers


def test_equal_items_are_asked_once_and_nulls_are_kept(spark):
    rows = [("r1", "q", "x", 1)] * 3 + [(None, "q", "y", 2), ("r3", None, "z", 3)]
    items, ledger = spark.createDataFrame(rows, "record_id string, rule_id string, note string, n int"), fresh_path(spark, "ledger")
    calls = judge.judge_in_rounds(items, speaker("a"), ledger, batch_size=2, rounds=2)
    assert sorted((i["record_id"] or "", i["rule_id"] or "") for r in calls.collect() for i in r["items"]) == [("", "q"), ("r1", "q"), ("r3", "")]
    none = judge.judge_in_rounds(items.limit(0), speaker("a"), fresh_path(spark, "ledger"))
    assert none.collect() == [] and said(none, items.limit(0)) == (set(), set())


def test_a_round_that_was_not_finished_does_not_count(spark):
    items, ledger = items_of(spark, 8), fresh_path(spark, "ledger")
    judge.judge_in_rounds(items.filter("n < 4"), speaker("first"), ledger)
    judge.read_ledger(spark, ledger).drop("response").withColumn("response", F.lit("half")).write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{ledger}/round-00000001-torn")
    found, _ = said(judge.judge_in_rounds(items, speaker("second"), ledger), items)
    assert found == {(f"r{i}", "first" if i < 4 else "second") for i in range(8)}


def test_tries_lie_apart(spark):
    start = time.perf_counter()
    calls = judge.call_judge(items_of(spark, 1), speaker("x", fail=0), retries=2, backoff=0.5, parallel_calls=1).collect()
    assert time.perf_counter() - start >= 1.5 and calls[0]["error"] == "too slow"


def test_a_response_is_read_in_one_pass(spark):
    """Answers by name, without one, repeated, invented, bare and missing; each response is scanned once for judgments and once for failures."""
    asked = [("r1", "a"), ("r1", "b"), ("r2", "a"), ("r3", None), (None, "a"), ("r5", "x")]
    said = [{"record_id": "r1", "reasoning": "first"}, {"record_id": "r1", "evidence": 2}, {"record_id": "r1", "evidence": "third"}, {"record_id": "r2", "rule_id": "a"},
            {"record_id": "r2", "rule_id": "zzz", "evidence": "e"}, {"record_id": "r3", "evidence": "e", "rule_id": "a"}, 7]
    rows = [("1", "PRIMARY", asked, "so [" + ", ".join(map(json.dumps, said)) + "] end", None), ("2", "PRIMARY", asked[:1], "[{", None), ("3", "PRIMARY", asked[:2], None, "late"),
            ("4", "PRIMARY", [], "[]", None)]
    calls = spark.createDataFrame(rows, "batch_id string, analysis_type string, items array<struct<record_id:string,rule_id:string>>, response string, error string")
    good, bad = judge.parse_responses(calls)
    assert [tuple(r) for r in good.orderBy("pos").select("record_id", "rule_id", "reasoning").collect()] == [("r1", "a", "first"), ("r1", "b", "2"), ("r1", "b", "third")]
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in bad.select("batch_id", "record_id", "rule_id", "error").collect()), key=key) == sorted([
        ("1", "r2", "a", "Missing evidence field"), ("1", "r3", None, "No answer"), ("1", None, "a", "No answer"), ("1", "r5", "x", "No answer"),
        ("1", "r2", "zzz", "Not asked"), ("1", "r3", "a", "Not asked"), ("1", "", None, "Not asked"),
        ("2", "r1", "a", "JSON parse error"), ("3", "r1", "a", "late"), ("3", "r1", "b", "late")], key=key)
    for frame in (good, bad):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("try_parse_json") + plan.count("parse_json(") <= 2 and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_a_shuffle_of_items_carries_no_digest(spark):
    """Digests do not shrink: items are dealt by them once, and each task computes them again."""
    items = spark.range(50).selectExpr("cast(id % 40 AS string) AS record_id", "'R1' AS rule_id", "'x' AS severity")
    once = judge._digested(items).dropDuplicates(["digest"])
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "digest" not in plan.partition("Exchange ")[2]
    assert once.count() == 40
