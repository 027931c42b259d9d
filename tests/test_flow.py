"""A whole run over the seeded records."""

import json

import pytest
from pyspark.sql import functions as F

from plain import rows
from parcels import NUMBER, SCHEMA, SOUND, TOTAL, records
from tamis import flow
from tamis.operators import judge as judging
from tamis.operators.reconcile import rule_pattern_keys
from tamis.plans import DEFAULT_RULES
from tamis.session import materialise


@pytest.fixture(scope="module")
def parcels(spark):
    return spark.createDataFrame(records(), SCHEMA)


def asker(verdict):
    def ask(items):  # local, so that it travels by value
        return json.dumps([{"record_id": i["record_id"], "rule_id": i["rule_id"], "evidence": "e",
                            "suggested_correction": {"weight_kg": 15} if "weight" in i["rule_id"] else None, **verdict(i)}
                           for i in items])

    return ask


def test_whole_run(spark, parcels):
    found = flow.check(parcels, DEFAULT_RULES)
    first = asker(lambda i: {"is_error": True, "confidence": "HIGH"})
    # the second opinion is shown the first, and differs on one record
    odd, heavy, status = (str(NUMBER[n]) for n in ("everything", "piano", "unheard status"))
    second = asker(lambda i: {"is_error": i["first_opinion"]["is_error"] and i["record_id"] != odd})
    third = asker(lambda i: {"is_error": False, "confidence": "MEDIUM"})
    out = flow.judge(found, first, "2024-01-01", reflect=second, deep=third)
    n, doubtful = found.count(), found.filter(F.col("record_id") == odd).count()
    assert out.judgments.count() == n and out.failures.count() == 0
    assert out.judgments.filter("confidence = 'HIGH' and is_error").count() == n - doubtful
    assert rows(out.judgments.filter(F.col("record_id") == odd).select("is_error", "confidence", "reflection_note").distinct()) == [
        (False, "MEDIUM", "DEEP_ANALYSIS: e")]
    kinds = {r["analysis_type"] for r in out.calls.collect()}
    assert kinds == {"PRIMARY", "REFLECTION", "DEEP_ANALYSIS"}

    summary = flow.report(parcels, found, out.judgments).head()
    assert (summary["total_scanned"], summary["total_suspects"], summary["total_errors"]) == (TOTAL, n, n - doubtful)
    assert summary["health_score"] == round(1 - (n - doubtful) / TOTAL, 4)

    decisions = spark.createDataFrame([(heavy, "approved", "kim", "2024-01-02", None), (status, "rejected", "kim", "2024-01-02", "fine")],
                                      "record_id string, action string, reviewer string, decided_at string, reason string")
    done = flow.correct(parcels, out.judgments, decisions, "run-1", "2024-01-03")
    assert rows(done.log, "record_id", "column_name", "original_value", "corrected_value") == [(heavy, "weight_kg", "212.5", "15")]
    assert done.table.filter("weight_kg > 30").select("record_id").collect() == [(odd,)] and done.table.count() == TOTAL
    assert rows(done.snapshot, "record_id", "weight_kg") == [(heavy, 212.5)] == rows(
        done.quarantine.select("record_id", F.get_json_object("original_data", "$.weight_kg").cast("double").alias("w")))
    assert rows(done.feedback, "record_id", "rejection_reason") == [(status, "fine")]


def test_opinions_are_not_broadcast(spark, parcels, monkeypatch):
    """A row per suspect takes little room in files and much in memory: whatever their files' size, opinions meet in shuffles."""
    asked, plans, call = {}, {}, judging.call_judge

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    def noting_calls(items, function, kind, *args, **kwargs):
        asked[kind] = plan(items)
        return call(items, function, kind, *args, **kwargs)

    def noting_writes(df, name, path=None):
        plans[name] = plan(df)
        return materialise(df, name, path)

    monkeypatch.setattr(judging, "call_judge", noting_calls)
    monkeypatch.setattr(flow, "materialise", noting_writes)
    sure, odd = asker(lambda i: {"is_error": True, "confidence": "HIGH"}), asker(lambda i: {"is_error": int(i["record_id"]) % 2 == 0})
    out = flow.judge(flow.check(parcels, DEFAULT_RULES), sure, "2024-01-01", reflect=odd, deep=sure)
    assert out.judgments.filter("NOT reflection_match").count() > 0 and out.new_cache_entries.count() > 0
    for text in (asked["REFLECTION"], asked["DEEP_ANALYSIS"], plans["opinions"], plans["judgments"], plan(out.new_cache_entries)):
        assert "SortMergeJoin" in text and "Broadcast" not in text
    tasks = out.calls.groupBy("analysis_type").agg(F.count_distinct(F.split("batch_id", "-")[0]).alias("n"))
    assert {r["n"] for r in tasks.collect()} == {4}  # as many call for every opinion


def test_cached_patterns_are_not_asked_again(spark, parcels, tmp_path):
    found = flow.check(parcels, DEFAULT_RULES)
    keys = rule_pattern_keys(DEFAULT_RULES, parcels.schema)
    first = flow.judge(found, asker(lambda i: {"is_error": True, "confidence": "HIGH"}), "2024-01-01")

    def never(items):
        raise RuntimeError("asked")

    again = flow.judge(found, never, "2024-01-02", cache=first.new_cache_entries, pattern_keys=keys)
    assert again.calls.count() == 0 and again.judgments.count() == found.count()
    assert rows(again.judgments.select("is_error", "from_cache").distinct()) == [(True, True)]


def test_clean_table_asks_nobody(spark, parcels):
    found = flow.check(parcels.filter(f"cast(record_id as int) <= {SOUND}"), DEFAULT_RULES)

    def never(items):
        raise RuntimeError("asked")

    out = flow.judge(found, never, "2024-01-01")
    assert found.count() == out.judgments.count() == out.calls.count() == 0
    assert flow.report(parcels, found, out.judgments).head()["status"] == "healthy"
