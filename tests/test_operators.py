"""Profiles, order, judgments, lineage, corrections on small hand-made inputs."""

import json
import math
import statistics
from collections import Counter
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from plain import rows
from parcels import SCHEMA, TOTAL, records
from tamis.operators import correct, details, health, judge, lineage, order, profile, reconcile, schema
from tamis.operators import suspects as sus
from tamis.operators.pages import file_counts, write_rows
from tamis.plans import DEFAULT_RULES, merge_rules, rules_df
from tamis.session import fresh_path, materialise, shared_folder


@pytest.fixture(scope="module")
def parcels(spark):
    return spark.createDataFrame(records(), SCHEMA)


@pytest.fixture(scope="module")
def found(spark, parcels):
    return materialise(sus.find_first_suspects(parcels, DEFAULT_RULES), "found")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- profile ------------------------------------------------------------------

def test_profile_against_plain_python(spark):
    data = [("5", 1.0, 3), ("x", -0.0, 3), (None, 0.0, None), ("5", 2.5, 4), ("7.5", None, 4), (" 1_0 ", 1.0, 4)]
    df = spark.createDataFrame(data, "t string, d double, i int")
    got = {r["column_name"]: r for r in profile.profile_columns(df, top_n=2).collect()}
    for n, name in enumerate("tdi"):
        values = [r[n] for r in data if r[n] is not None]
        numbers = []
        for v in values:
            try:
                numbers.append(float(v))
            except ValueError:
                pass
        g = got[name]
        assert (g["total_count"], g["null_count"]) == (6, 6 - len(values))
        assert g["unique_count"] == len(set(values)) and g["uniqueness_rate"] == round(len(set(values)) / len(values), 6)
        assert float(g["min_value"]) == min(numbers) and float(g["max_value"]) == max(numbers)
        assert g["mean_value"] == round(statistics.fmean(numbers), 4)
        assert math.isclose(g["stddev_value"], statistics.pstdev(numbers), abs_tol=1e-4)
        top = sorted(Counter(values).items(), key=lambda kv: (-kv[1], str(kv[0] + 0.0 if name == "d" else kv[0])))[:2]
        assert [(t["value"], t["count"]) for t in g["top_values"]] == [(str(v + 0.0 if name == "d" else v), c) for v, c in top]


def test_profile_of_empty_and_all_null(spark):
    df = spark.createDataFrame([], "a string, b int")
    assert profile.profile_columns(df).select("total_count", "unique_count", "null_rate").distinct().collect() == [(0, 0, 0.0)]
    (r,) = profile.profile_columns(spark.createDataFrame([(None,)], "a string")).collect()
    assert (r["null_rate"], r["unique_count"], r["uniqueness_rate"], r["min_value"]) == (1.0, 0, 0.0, None)


def test_text_bounds_only_without_numbers_and_one_number_has_no_deviation(spark):
    df = spark.createDataFrame([("b", "9"), ("a", "z")], "t string, u string")
    got = {r["column_name"]: r for r in profile.profile_columns(df).collect()}
    assert (got["t"]["min_value"], got["t"]["max_value"], got["t"]["mean_value"]) == ("a", "b", None)
    assert (got["u"]["min_value"], got["u"]["mean_value"], got["u"]["stddev_value"]) == ("9.0", 9.0, None)


def test_top_values_keep_n_rows_per_task(spark, sf):
    text = plan(profile.top_values(spark.read.parquet(f"{sf}/events.parquet"), ["user_id"], 5))
    assert text.count("WindowGroupLimit") == 2


def test_sketch_profile_is_one_aggregate(spark, sf):
    text = plan(profile.profile_columns(spark.read.parquet(f"{sf}/orders.parquet"), approx=True))
    assert text.count("FileScan") == 1 and "hashpartitioning" not in text


HISTORY = "table_name string, column_name string, ts timestamp, null_rate double, unique_count long, mean_value double"


def at(day):
    return datetime(2024, 1, day, tzinfo=timezone.utc)


def test_profile_change(spark):
    df = spark.createDataFrame([
        ("t", "a", at(1), 0.9, 5, 1.0), ("t", "a", at(2), 0.0, 10, 1.0), ("t", "a", at(3), 0.06, 10, 1.0),
        ("t", "b", at(2), 0.0, 10, 1.0), ("t", "b", at(3), 0.05, 12, 1.0),
        ("t", "c", at(2), 0.0, 10, 1.0), ("t", "c", at(3), 0.0, 13, 1.0), ("t", "d", at(3), 0.0, 13, 1.0),
        ("t", "e", at(2), 0.0, 0, 1.0), ("t", "e", at(3), 0.0, 1, 1.0)], HISTORY)
    assert rows(profile.profile_change(df), "column_name", "change") == [
        ("a", "null_rate"), ("b", "none"), ("c", "unique_count"), ("d", "none"), ("e", "unique_count")]


def test_profile_anomalies(spark):
    past = spark.createDataFrame([("t", "a", at(1), 0.1, 10, 100.0), ("t", "a", at(2), 0.1, 10, 100.0)], HISTORY)
    now = spark.createDataFrame([("t", "a", at(3), 0.1, 13, 20.0)], HISTORY)
    got = {r["metric"]: r for r in profile.profile_anomalies(past, now).collect()}
    assert {m: r["severity"] for m, r in got.items()} == {
        "null_rate": "info", "unique_count": "warning", "mean_value": "critical"}
    assert got["mean_value"]["deviation_pct"] == -80.0


def test_infer_schema(spark):
    df = spark.createDataFrame([(1, 1.5, True, None, "x", "y", "z")],
                               "n int, f double, b boolean, e int, status_code string, created string, plain string")
    got = {r["column_name"]: (r["data_type"], r["nullable"]) for r in schema.infer_schema(df).collect()}
    assert got == {"n": ("integer", False), "f": ("float", False), "b": ("boolean", False), "e": ("string", True),
                   "status_code": ("datetime", False), "created": ("datetime", False), "plain": ("string", False)}
    strict = {r["column_name"]: r["data_type"] for r in schema.infer_schema(df, substring_hints=False).collect()}
    assert strict["status_code"] == "string" and strict["created"] == "datetime"


def test_fingerprint_like_hashlib(spark):
    import hashlib

    inferred = spark.createDataFrame([("b", "string", True), ("a", "integer", False)],
                                     "column_name string, data_type string, nullable boolean")
    raw = json.dumps([["a", "integer"], ["b", "string"]])
    assert schema.schema_fingerprint(inferred).head()["fingerprint"] == hashlib.sha256(raw.encode()).hexdigest()[:16]


@pytest.mark.parametrize("columns, key", [
    ("x int, id int", "id"), ("x int, order_id int", "order_id"), ("x int, y int", "y"), ("x int, `번호` int", "번호"),
    ("record_id int, id int", None)])
def test_detect_key(spark, columns, key):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], columns)
    chosen = [r["column_name"] for r in schema.detect_key(df).filter("is_key").collect()]
    assert chosen == ([key] if key else []) and schema.find_key(df) == key


def test_no_key_when_values_repeat_or_miss(spark):
    df = spark.createDataFrame([(1, None), (1, 2)], "id int, x int")
    assert schema.detect_key(df).filter("is_key").count() == 0 and schema.find_key(df) is None
    assert schema.find_key(df.limit(0)) is None


def test_key_presence(spark):
    lines = ['{"a": 1, "b": null}', '{"a": 1}', '{"a": "x", "b": {"c": 2}}', '{}']
    records = spark.createDataFrame([(x,) for x in lines], "s string").select(F.parse_json("s").alias("v"))
    got = {r["column_name"]: r for r in profile.key_presence(records, top_n=1).collect()}
    assert {k: (r["total_count"], r["null_count"], r["distinct_count"]) for k, r in got.items()} == {"a": (3, 0, 2), "b": (2, 1, 1)}
    assert [tuple(x) for x in got["a"]["top_values"]] == [("1", 2)] and [tuple(x) for x in got["b"]["top_values"]] == [('{"c":2}', 1)]


def test_rule_cache_round_trip(spark):
    from tamis.plans import DEFAULT_RULES

    cache = schema.rule_cache_entries(spark, DEFAULT_RULES[:2], "f", "2024-01-02 00:00:00").unionByName(
        schema.rule_cache_entries(spark, DEFAULT_RULES, "f", "2024-01-02 00:30:00"))
    assert sorted(schema.newest_rules(cache, "f", "2024-01-02 01:00:00"), key=str) == sorted(DEFAULT_RULES, key=str)
    assert schema.newest_rules(cache, "f", "2024-01-03 00:00:00") is None and schema.newest_rules(cache, "g", "2024-01-02 01:00:00") is None


def test_rule_cache_age(spark):
    df = spark.createDataFrame([("f", at(2)), ("f", at(1)), ("g", at(2))], "fingerprint string, cached_at timestamp")
    assert schema.cached_rules(df, "f", "2024-01-02 01:00:00").count() == 1
    assert schema.cached_rules(df, "f", "2024-01-02 01:00:01").count() == 0


# --- order --------------------------------------------------------------------

@pytest.mark.parametrize("hot", [0, 400])
def test_row_numbers(spark, hot):
    """With and without a key that holds a third of the rows."""
    data = [(i * 7919 % 1000, f"k{i % 13}") for i in range(800)] + [(500, "k1")] * hot
    df = spark.createDataFrame(data, "a int, b string").repartition(5)
    got = sorted(order.number_rows(df, ["a", "b"], ranges=10).collect(), key=lambda r: r["row_no"])
    assert [r["row_no"] for r in got] == list(range(1, len(data) + 1))
    assert [(r["a"], r["b"]) for r in got] == sorted(data)


def test_hot_key_is_dealt_over_parts(spark):
    df = spark.createDataFrame([(i,) for i in range(1000)] + [(5,)] * 1000, "a int")
    counts = [r["rows"] for r in file_counts(write_rows(df, fresh_path(spark, "hot"), ["a"], 10)).collect()]
    assert sum(counts) == 2000 and max(counts) < 400
    assert [r["row_no"] for r in order.number_rows(df.filter("a < 0"), ["a"]).collect()] == []


def test_missing_keys_come_first_and_keys_may_descend(spark):
    data = [(None,), (3,), (None,), (1,), (2,)]
    df = spark.createDataFrame(data, "a int").repartition(2)
    for key, want in ((F.col("a"), [None, None, 1, 2, 3]), (F.desc("a"), [3, 2, 1, None, None])):
        got = sorted(order.number_rows(df, [key], ranges=3).collect(), key=lambda r: r["row_no"])
        assert [r["a"] for r in got] == want


def test_pages_for_display_hold_no_earlier_rows(spark):
    df = spark.range(1000).repartition(4)
    deep = order.sorted_page(df, ["id"], 10, 90)
    assert [r["id"] for r in deep.collect()] == list(range(900, 910))
    assert "limit=910" not in plan(deep)
    rows_, after, seen = df.select(F.when(F.col("id") >= 3, F.col("id")).alias("k"), "id"), None, []
    for _ in range(4):
        page = order.page_after(rows_, ["k", "id"], 2, after).collect()
        seen += [r["id"] for r in page]
        after = tuple(page[-1])
    assert seen == list(range(8))


def test_files_follow_the_number_of_rows(spark):
    """However few files or tasks the rows come from."""
    counts = file_counts(write_rows(spark.range(0, 900, 1, 1), fresh_path(spark, "few"), ["id"], rows_per_file=50)).collect()
    assert len(counts) == 18 and max(r["rows"] for r in counts) < 200


def test_pages_cover_the_table(spark):
    df = spark.range(1003).repartition(3)
    pages = [order.page(df, ["id"], 250, i, ranges=6).collect() for i in range(5)]
    assert [len(p) for p in pages] == [250, 250, 250, 250, 3]
    assert sorted(r["id"] for p in pages for r in p) == list(range(1003))
    assert {(r["total_count"], r["chunk_count"]) for p in pages for r in p} == {(1003, 5)}
    assert order.page(df, ["id"], 250, 9, ranges=6).count() == 0


def test_numbering_never_gathers_rows_in_one_task(spark):
    """Only the counts of the files meet in one."""
    text = plan(order.number_rows(spark.range(1000), ["id"], ranges=8))
    assert text.count("Exchange SinglePartition") == 1
    below = text[text.index("Exchange SinglePartition"):].splitlines()[1]
    assert "HashAggregate(keys=[" in below and "count(1)" in below


# --- judge --------------------------------------------------------------------

def make_answer():
    def answer(items):  # local, so that it travels by value
        return "Sure:\n" + json.dumps([{"record_id": i["record_id"], "is_error": True, "evidence": "e", "confidence": "HIGH"}
                                       for i in items]), 3, 2

    return answer


def test_call_judge_batches_and_tokens(spark, found):
    answer = make_answer()
    sizes = [len(r["items"]) for r in judge.call_judge(found, answer, batch_size=7).collect()]
    assert max(sizes) <= 7 and sum(sizes) == found.count()
    calls = judge.call_judge(found, answer, batch_size=7)
    cost = judge.token_cost(calls).head()
    assert cost["input_tokens"] == 3 * cost["calls"] and cost["total_tokens"] == 5 * cost["calls"]
    assert math.isclose(cost["cost_usd"], round(cost["calls"] * (3 * 3 + 2 * 15) / 1e6, 6))


def test_judge_is_called_once_per_batch(spark, found, tmp_path):
    answer = make_answer()

    def counting(items):
        (tmp_path / f"{items[0]['record_id']}-{items[0]['rule_id']}-{datetime.now().timestamp()}").touch()
        return answer(items)

    calls = judge.call_judge(found, counting, batch_size=5)
    good, bad = judge.parse_responses(calls)
    good.count(), bad.count(), judge.token_cost(calls).collect()
    assert len(list(tmp_path.iterdir())) == calls.count()


def test_failing_judge_fails_its_items(spark, found):
    def broken(items):
        raise RuntimeError("no quota")

    good, bad = judge.parse_responses(judge.call_judge(found, broken, retries=0))
    assert good.count() == 0 and bad.count() == found.count()
    assert rows(judge.failure_reasons(bad)) == [("no quota",)]


def responses(spark, *texts):
    data = [(str(i), "PRIMARY", [("1", "A"), ("2", "B")], t, 0, 0, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, judge.RESPONSE_SCHEMA)


def test_parse_responses(spark):
    text = 'x [{"record_id": "1", "is_error": true, "evidence": "e", "suggested_correction": {"a": 1, "b": null}},' \
           '{"record_id": 2, "reasoning": "r"}, {"record_id": "9", "evidence": null}, {"record_id": "3"}] y'
    good, bad = judge.parse_responses(responses(spark, text))
    got = {r["record_id"]: r for r in good.collect()}
    assert got["1"]["rule_id"] == "A" and got["1"]["suggested_correction"] == {"a": "1", "b": None}
    assert (got["2"]["rule_id"], got["2"]["is_error"], got["2"]["confidence"], got["2"]["reasoning"]) == ("B", False, "LOW", "r")
    assert set(got) == {"1", "2"}
    assert rows(bad, "record_id", "error") == [("3", "Not asked"), ("9", "Not asked")]


def test_every_item_is_a_judgment_or_a_failure(spark):
    """A judge that leaves out, repeats, invents, gives no evidence and names no rule."""
    items = [("1", "A"), ("1", "B"), ("2", "A"), ("3", "A"), ("3", "B"), ("4", "A")]
    text = json.dumps([{"record_id": "1", "evidence": "x"}, {"record_id": "1", "evidence": "y"}, {"record_id": "2", "rule_id": "Z", "evidence": "e"},
                       {"record_id": "3", "rule_id": "B", "evidence": "e"}, {"record_id": "3", "rule_id": "B", "evidence": "again"},
                       {"record_id": "4", "rule_id": "A"}])
    good, bad = judge.parse_responses(spark.createDataFrame([("0", "PRIMARY", items, text, 0, 0, None)], judge.RESPONSE_SCHEMA))
    assert rows(reconcile.last_answer(good).select("record_id", "rule_id", "reasoning")) == [("1", "A", "x"), ("1", "B", "y"), ("3", "B", "again")]
    assert rows(bad, "record_id", "rule_id", "error") == [
        ("2", "A", "No answer"), ("2", "Z", "Not asked"), ("3", "A", "No answer"), ("4", "A", "Missing evidence field")]


def test_calls_follow_the_argument_not_the_files(spark, found):
    answer = lambda items: json.dumps([{**i, "evidence": "e"} for i in items])
    one_file = materialise(found.coalesce(1), "one-file")
    calls = judge.call_judge(one_file, answer, batch_size=1000, parallel_calls=7)
    assert 1 < len({r["batch_id"].split("-")[0] for r in calls.collect()}) <= 7
    assert judge.parse_responses(calls)[0].count() == found.count()


def test_parse_single_object_and_broken_text(spark):
    good, bad = judge.parse_responses(responses(spark, '{"record_id": "1", "evidence": "e"}', '[{"record_id": "1"', "sorry"))
    assert rows(good, "record_id", "rule_id") == [("1", "A")]
    assert rows(bad, "record_id", "error") == [*[("1", "JSON parse error")] * 2, *[("2", "JSON parse error")] * 2, ("2", "No answer")]


def test_batch_payloads(spark, found):
    numbered = order.number_rows(found.select("record_id", "rule_id"), ["record_id", "rule_id"], ranges=4)
    got = judge.batch_payloads(numbered, 10).orderBy("batch_no").collect()
    items = [i for r in got for i in json.loads(r["payload"])]
    assert [r["item_count"] for r in got[:-1]] == [10] * (len(got) - 1)
    assert [(i["record_id"], i["rule_id"]) for i in items] == rows(found, "record_id", "rule_id")


# --- judgments ----------------------------------------------------------------

J = "record_id string, rule_id string, is_error boolean, confidence string, reasoning string"


def test_reconcile_and_deep(spark):
    first = spark.createDataFrame([(str(i), "A", True, "HIGH", "") for i in range(4)], J)
    second = spark.createDataFrame([("0", "A", True, "", ""), ("1", "A", False, "", ""), ("2", "A", False, "", "")], J)
    out = reconcile.reconcile(first, second)
    assert rows(out, "record_id", "is_error", "confidence", "reflection_match") == [
        ("0", True, "HIGH", True), ("1", True, "LOW", False), ("2", True, "LOW", False), ("3", True, "HIGH", True)]
    third = spark.createDataFrame([("1", "A", False, "MEDIUM", "why")], J)
    deep = {r["record_id"]: r for r in reconcile.apply_deep(out, third).collect()}
    assert (deep["1"]["is_error"], deep["1"]["confidence"], deep["1"]["reflection_note"]) == (False, "MEDIUM", "DEEP_ANALYSIS: why")
    assert deep["2"]["reflection_note"] == "Primary/Reflection mismatch"


def test_repeated_answers_do_not_multiply(spark):
    first = spark.createDataFrame([("1", "A", True, "HIGH", "")] * 50, J)
    second = spark.createDataFrame([("1", "A", False, "", "")] * 50, J)
    assert reconcile.reconcile(first, second).count() == 50


def test_cache(spark, found):
    keyed = found.withColumn("k", reconcile.pattern_key())
    key = keyed.filter("rule_id = 'R002-tracking_id_format'").head()["k"]
    assert key == "format_inconsistency:R002-tracking_id_format:tracking_id"
    verdict = '{"is_error":true,"confidence":"HIGH","reasoning":"r"}'
    cache = spark.createDataFrame([(key, "old", "HIGH", at(1), None), (key, verdict, "HIGH", at(2), at(9)),
                                   ("x:y:z", verdict, "HIGH", at(2), None)],
                                  "pattern_key string, judgment string, confidence string, cached_at timestamp, expires_at timestamp")
    for keys in (None, [key]):
        hits, misses = reconcile.cache_lookup(found, cache, "2024-01-09", keys)
        assert hits.count() == 3 and hits.count() + misses.count() == found.count()
        assert {r["reasoning"] for r in reconcile.cached_judgments(hits).collect()} == {"r"}
        hits, _ = reconcile.cache_lookup(found, cache, "2024-01-10", keys)
        assert hits.count() == 0
    assert key in reconcile.rule_pattern_keys(DEFAULT_RULES, spark.createDataFrame([], SCHEMA).schema)


def test_known_patterns_are_looked_up_without_moving_suspects(spark, parcels):
    found = sus.find_first_suspects(parcels, DEFAULT_RULES)
    cache = spark.createDataFrame([], "pattern_key string, judgment string, confidence string, cached_at timestamp, expires_at timestamp")
    hits, _ = reconcile.cache_lookup(found, cache, "2024-01-09", reconcile.rule_pattern_keys(DEFAULT_RULES, parcels.schema))
    assert "SortMergeJoin" not in plan(hits) and "BroadcastHashJoin" in plan(hits)


def test_cache_entries_only_high(spark, found):
    verdicts = found.select("record_id", "rule_id", "error_type", F.lit(True).alias("is_error"),
                            F.when(F.col("error_type") == "out_of_range", "high").otherwise("LOW").alias("confidence"),
                            F.lit("r").alias("reasoning"), F.lit(None).cast("map<string,string>").alias("suggested_correction"))
    out = reconcile.cache_entries(verdicts, found, "2024-01-01", ttl_days=2)
    assert {r["pattern_key"].split(":")[0] for r in out.collect()} == {"out_of_range"}
    assert out.filter("expires_at = timestamp'2024-01-03'").count() == out.count() == 3


def test_ranking(spark):
    df = spark.createDataFrame([("1", "A", True, c, "") for c in ("LOW", "odd", "HIGH", "MEDIUM")], J)
    assert [r["confidence"] for r in reconcile.ranked(df).collect()][:2] == ["HIGH", "MEDIUM"]
    counts = reconcile.confidence_counts(df).head()
    assert (counts["total_analyzed"], counts["high_count"], counts["low_count"]) == (4, 1, 1)


# --- lineage ------------------------------------------------------------------

LINEAGE = ("table_name string, upstream_tables array<string>, downstream_tables array<string>, query_volume_7d long, "
           "certification_status string, column_lineage map<string,string>")


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame([
        ("t", ["u"], ["a", "b", "c"], 15000, "certified", {"x": "u.x1", "y": "u.y1", "z": "plain", "w": "u.w.deep"}),
        ("lonely", ["u9", "u8"], [], 0, "certified", {})], LINEAGE)


def found_in(spark, *rows_):
    return spark.createDataFrame([(str(i), "R", *r) for i, r in enumerate(rows_)],
                                 "record_id string, rule_id string, severity string, table_name string, target_columns array<string>")


def test_impact(spark, catalog):
    df = found_in(spark, ("critical", "t", []), ("odd", "t", []), (None, "lonely", []), ("info", "nowhere", []))
    got = [r for r in sorted(lineage.impact_scores(df, catalog).collect())]
    weight = math.log10(15001) / 5
    assert [r["impact_score"] for r in got] == [round(30 * weight, 2), round(3 * weight, 2), 0.5, 0.1]
    assert got[0]["query_volume_weight"] == 0.8352
    top = sus.top_by_impact(lineage.impact_scores(df, catalog), 2)
    assert [r["record_id"] for r in top.collect()] == ["0", "1"]


def test_root_causes(spark, catalog):
    changes = spark.createDataFrame([("u", "y1", "null_rate", True), ("u", "x1", "none", False)],
                                    "table_name string, column_name string, change string, changed boolean")
    df = found_in(spark, ("info", "t", ["x", "y"]), ("info", "t", ["x", "w"]), ("info", "t", ["z"]),
                  ("info", "lonely", ["x"]), ("info", "nowhere", ["x"]), ("info", "t", ["w"]))
    got = [(r["root_cause_status"], r["root_cause_table"], r["root_cause_column"], r["root_cause_confidence"])
           for r in sorted(lineage.root_causes(df, catalog, changes).collect())]
    assert got == [("success", "u", "y1", "HIGH"), ("success", "u", "x1", "MEDIUM"), ("partial", "u", "", "LOW"),
                   ("partial", "u9", "", "LOW"), ("no_lineage", "", "", "LOW"), ("success", "u", "w.deep", "MEDIUM")]


# --- results, health, corrections ---------------------------------------------

def test_causes_are_found_per_pair_not_per_suspect(spark, catalog):
    changes = spark.createDataFrame([], "table_name string, column_name string, change string, changed boolean")
    df = found_in(spark, *[("info", "t", ["x"])] * 50, ("info", None, ["x"]))
    text = plan(lineage.root_causes(df, catalog, changes))
    assert "SortMergeJoin" not in text and "hashpartitioning(table_name" not in text
    got = lineage.root_causes(df, catalog, changes).groupBy("root_cause_status").count().collect()
    assert {r[0]: r[1] for r in got} == {"success": 50, "no_lineage": 1}


def test_record_detail(spark):
    found = spark.createDataFrame([("1", "A", "t1", "info"), ("1", "B", "t2", "info"), ("2", "A", "t1", "critical")],
                                  "record_id string, rule_id string, error_type string, severity string")
    verdicts = spark.createDataFrame([("{'record_id': '1'}", "A", True, "LOW", ""), ("1", "B", False, "HIGH", ""),
                                      ("3", "A", True, "HIGH", "")], J)
    out = details.record_detail(found, verdicts)
    assert rows(out, "record_id", "source", "has_error", "confidence", "violation_count") == [
        ("1", "both", False, "HIGH", 2), ("2", "rule", True, "N/A", 1), ("3", "llm", True, "HIGH", 0)]
    assert rows(details.search_details(out, "T2"), "record_id") == [("1",)]


def test_resolve_addresses(spark):
    df = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c"), ("4", "d"), ("5", None)], "record_id string, address string")
    known = spark.createDataFrame([("a", "A road", "A lot", 1), ("b", "", "B lot", 1), ("c", "C1", "", 2), ("c", "C0", "", 1)],
                                  "search_text string, road_addr string, jibun_addr string, position int")
    out = details.resolve_addresses(df, known)
    assert rows(out, "record_id", "address_type", "normalized_address", "address_confidence") == [
        ("1", "road", "A road", 0.9), ("2", "jibun", "B lot", 0.9), ("3", "ambiguous", "C0", 0.5), ("4", "ambiguous", "d", 0.0),
        ("5", "ambiguous", None, 0.0)]


def test_health(spark):
    df = spark.createDataFrame([("1", "A", True, "HIGH", ""), ("2", "A", True, "LOW", ""), ("3", "A", False, "HIGH", "")], J)
    assert health.health_score(df, 10).head()["health_score"] == 0.85
    assert health.health_score(df, 10, count_non_errors=True).head()["health_score"] == 0.75
    assert health.health_score(df, 10, count_non_errors=True).head()["status"] == "warning"
    assert health.health_score(df, 1).head()["status"] == "critical" and health.health_score(df, 1).head()["health_score"] == 0.0
    assert health.health_score(df.limit(0), 0).head()["health_score"] == 1.0


def test_report_without_suspects(spark, parcels):
    empty = sus.find_suspects(parcels, [])
    out = health.report_summary(parcels, empty, spark.createDataFrame([], J)).head()
    assert (out["total_scanned"], out["total_suspects"], out["filtering_ratio"], out["error_type_distribution"]) == (TOTAL, 0, 0.0, {})


DEC = "record_id string, action string, reviewer string, decided_at timestamp, reason string"


def test_decisions_newest_counts_and_nothing_without_one(spark):
    queue = spark.createDataFrame([(i, "A", True, "HIGH", "") for i in "1234"], J)
    dec = spark.createDataFrame([("1", "approved", "k", at(1), ""), ("2", "approved", "k", at(1), ""), ("2", "rejected", "k", at(2), "no"),
                                 ("3", "rejected", "k", at(1), None)], DEC)
    assert rows(correct.approved(queue, dec), "record_id", "approved_by") == [("1", "k")]
    assert rows(correct.feedback(queue, dec), "record_id", "rejection_reason") == [("2", "no"), ("3", "Reviewer rejected")]


def test_cells_from_three_spellings(spark):
    df = spark.createDataFrame([
        ("1", "A", {"a": "1", "b": None}, None, None), ("2", "A", {"column": "a", "value": "2"}, None, None),
        ("3", "A", None, "c", "3"), ("4", "A", {}, None, None), ("", "A", {"a": "1"}, None, None), ("5", "A", {"": "1"}, None, None)],
        "record_id string, rule_id string, suggested_correction map<string,string>, correction_column string, correction_value string")
    assert rows(correct.correction_cells(df), "record_id", "column_name", "value") == [
        ("1", "a", "1"), ("1", "b", None), ("2", "a", "2"), ("3", "c", "3")]


def test_apply_log_and_rollback(spark):
    df = spark.createDataFrame([("1", 5, "x"), ("2", 6, "y"), ("3", 7, "z")], "record_id string, n int, t string")
    cells = spark.createDataFrame([("1", "A", "n", "50"), ("1", "B", "n", "51"), ("1", "A", "t", None), ("2", "A", "n", "many"),
                                   ("2", "A", "gone", "1"), ("9", "A", "n", "1")],
                                  "record_id string, rule_id string, column_name string, value string")
    after = correct.apply_corrections(df, cells)
    assert rows(after) == [("1", 51, None), ("2", 6, "y"), ("3", 7, "z")] and after.dtypes == df.dtypes
    log = rows(correct.correction_log(df, cells, "run"), "record_id", "column_name", "original_value", "corrected_value", "status")
    assert log == [("1", "n", "5", "51", "success"), ("1", "t", "x", None, "success"), ("2", "gone", None, "1", "failed"),
                   ("2", "n", "6", "many", "failed")]
    assert rows(correct.rollback(after, correct.snapshot(df, cells))) == rows(df)


def test_quarantine(spark):
    df = spark.createDataFrame([("1", 5), ("2", None)], "record_id string, n int")
    bad = spark.createDataFrame([("2",), ("2",)], "record_id string")
    (q,) = correct.quarantine(df, bad, "run", "why", "2024-01-01").collect()
    assert json.loads(q["original_data"]) == {"record_id": "2", "n": None} and q["status"] == "quarantined"
    clean, out = correct.split_quarantined(df, bad)
    assert rows(clean) == [("1", 5)] and rows(out) == [("2", None)]
    assert rows(correct.flag_quarantined(df, bad, "why", "2024-01-01"), "record_id", "_quarantined", "_quarantine_reason") == [
        ("1", False, None), ("2", True, "why")]


def test_merge_rules(spark):
    old = rules_df(spark, DEFAULT_RULES[:2])
    new = rules_df(spark, DEFAULT_RULES[1:4]).unionByName(rules_df(spark, DEFAULT_RULES[3:4]))
    out = merge_rules(old, new, "2024-01-01")
    assert out.count() == 4 and out.filter("_generated_at is not null").count() == 2


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_detect_key_counts_every_column(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", None), (3, None, None)], "id long, name string, other long")
    assert {r["column_name"]: (r["row_count"], r["present_count"], r["distinct_count"], r["is_unique"], r["is_key"]) for r in schema.detect_key(df).collect()} == {
        "id": (3, 3, 3, True, True), "name": (3, 2, 1, False, False), "other": (3, 1, 1, False, False)}


def test_a_small_catalog_is_broadcast_though_its_size_was_not_known(spark):
    """Else the rows of each of a few tables meet in one task."""
    catalog = spark.sparkContext.parallelize([("parcels", ["a"], ["b"], 5, "certified", {"x": "a.y"})]).toDF(
        "table_name string, upstream_tables array<string>, downstream_tables array<string>, query_volume_7d long, certification_status string, "
        "column_lineage map<string,string>")
    rows = spark.range(20).selectExpr("id", "CASE WHEN id % 4 > 0 THEN 'parcels' ELSE 'other' END AS table_name")
    found = lineage.lookup(rows, catalog)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(table_name" not in plan
    assert found.filter("lineage_status = 'success'").count() == 15 and found.count() == 20


def test_last_verdicts_without_an_order_need_no_sort(spark):
    data = [("a", "R", True), ("a", "R", False), ("b", "R", None), ("b", "R", False), ("c", "R", None), (None, "R", False)]
    said = spark.createDataFrame(data, "record_id string, rule_id string, is_error boolean")
    last = reconcile.last_answer(said)
    assert sorted(map(tuple, last.collect()), key=str) == sorted([("a", "R", True), ("b", "R", False), ("c", "R", None), (None, "R", False)], key=str)
    assert "SortAggregate" not in last._jdf.queryExecution().executedPlan().toString()
