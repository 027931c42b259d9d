"""Rules over rows: families, dedup, rates, plans."""

import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from plain import rows
from parcels import NUMBER, SCHEMA, TOTAL, expected, records
from tamis.functions.cells import DEFAULT_TIME_FORMATS
from tamis.operators import suspects as sus
from tamis.plans import DEFAULT_RULES, DELIVERY_RULES, Rule, number_generated, parse_rules, rule_errors, rules_df, rules_from_df
from tamis.plans.rules import by_column, by_error_type, by_tool, load_rules, relations


@pytest.fixture(scope="module")
def parcels(spark):
    return spark.createDataFrame(records(), SCHEMA).cache()


def ids(df, where):
    return sorted({int(r[0]) for r in df.filter(where).select("record_id").collect()})


def one_rule(spark, data, schema, kind, columns, params, tool="range_check"):
    df = spark.createDataFrame([(str(i), *v) for i, v in enumerate(data)], f"record_id string, {schema}")
    found = sus.find_suspects(df, [Rule("R", kind, columns, tool, params)])
    return [int(r[0]) for r in rows(found, "record_id")]


@pytest.mark.parametrize("kind", ["out_of_range", "format_inconsistency", "temporal_violation", "cross_column_inconsistency"])
def test_seeds_are_found_and_nothing_else(parcels, kind):
    assert ids(sus.find_first_suspects(parcels, DEFAULT_RULES), F.col("error_type") == kind) == expected(kind)


def test_boundary_weights_do_not_violate(parcels):
    found = sus.find_first_suspects(parcels, DEFAULT_RULES)
    assert not set(ids(found, "rule_id = 'R001-weight_kg_range'")) & {NUMBER[n] for n in ("lightest allowed", "heaviest allowed", "no weight")}


def test_two_columns_of_a_rule_give_one_suspect_the_first(parcels):
    short = F.col("record_id") == str(NUMBER["hour and minute"])
    every = sus.find_suspects(parcels, DEFAULT_RULES).filter(short)
    assert rows(every, "target_columns") == [(["arrival_time"],), (["dispatch_time"],)]
    first = sus.find_first_suspects(parcels, DEFAULT_RULES).filter(short)
    assert rows(first, "target_columns") == [(["dispatch_time"],)]


def test_suspect_fields(parcels):
    found = {(r["record_id"], r["rule_id"]): r for r in sus.find_first_suspects(parcels, DEFAULT_RULES).collect()}
    weight = found[str(NUMBER["piano"]), "R001-weight_kg_range"]
    assert weight["current_values"] == {"weight_kg": "212.5"}
    assert weight["reason"] == "min:0.01, max:30.0" and weight["severity"] == "critical"
    time = found[str(NUMBER["late night"]), "R003-dispatch_before_arrival"]
    assert time["current_values"] == {"dispatch_time": "22:10:05", "arrival_time": "06:45:00"}
    assert time["reason"] == "dispatch_time < arrival_time"
    flag = found[str(NUMBER["street as lot"]), "R004-address_road_yn_match"]
    assert flag["reason"] == "Address is road type but road_addr_yn=0" and flag["severity"] == "warning"


def test_unparsable_times_are_reported_apart(parcels):
    got = rows(sus.parse_failures(parcels, DEFAULT_RULES), "record_id", "column_name", "value")
    assert got == [(str(NUMBER["hour and minute"]), "dispatch_time", "09:40")]


def test_missing_columns_are_skipped(spark):
    df = spark.createDataFrame([("1", "LOST")], "record_id string, status_code string")
    assert rows(sus.find_suspects(df, DELIVERY_RULES), "rule_id") == [("R001-status_code_enum",)]


def test_no_rules_give_no_suspects(spark):
    df = spark.createDataFrame([("1",)], "record_id string")
    out = sus.find_suspects(df, [])
    assert out.columns[0] == "record_id" and out.count() == 0


def test_allowed_values_are_type_strict(spark):
    assert one_rule(spark, [("1",), ("0",), ("x",), (None,)], "c string", "out_of_range", ("c",),
                    {"allowed_values": [0, 1]}) == [0, 1, 2]
    assert one_rule(spark, [(1.0,), (0.0,), (0.5,)], "c double", "out_of_range", ("c",), {"allowed_values": [0, 1]}) == [2]
    assert one_rule(spark, [(True,), (False,)], "c boolean", "out_of_range", ("c",), {"allowed_values": [1]}) == [1]
    assert one_rule(spark, [(1,), (2,)], "c int", "out_of_range", ("c",), {"allowed_values": ["1"]}) == [0, 1]
    assert one_rule(spark, [(1,), (2,)], "c int", "out_of_range", ("c",), {"allowed_values": []}) == []
    assert one_rule(spark, [(2 ** 60 + 1,), (2 ** 60,)], "c bigint", "out_of_range", ("c",),
                    {"allowed_values": [2 ** 60 + 1]}) == [1]


def test_numeric_range(spark):
    nan = float("nan")
    assert one_rule(spark, [(1.0,), (0.9,), (2.1,), (nan,), (None,), (2.0,)], "c double", "out_of_range", ("c",),
                    {"min_value": 1, "max_value": 2}) == [1, 2]
    assert one_rule(spark, [("1.5",), (" 1.5 ",), ("abc",), ("3d",), ("nan",), ("",)], "c string", "out_of_range", ("c",),
                    {"min_value": 1, "max_value": 2}) == [2, 3, 5]


def test_not_null(spark):
    df = spark.createDataFrame([("1", None), ("2", 5)], "record_id string, c int")
    rule = Rule("N", "out_of_range", ("c",), "range_check", {"min_value": 1, "nullable": False})
    assert rows(sus.find_suspects(df, [rule]), "record_id", "current_values") == [("1", {"c": "null"})]


def test_temporal_mixed_formats_and_ties(spark):
    data = [("10:00:00", "10:00:00"), ("9:5:0", "10:00:00"), ("2024-01-01 10:00:00", "10:00:00"),
            ("10:00:00", "2024-01-01T00:00:00"), (None, "10:00:00"), ("bad", "10:00:00"),
            ("20240101000000", "2024-01-01 00:00:01")]

    def parse(text):
        for f in DEFAULT_TIME_FORMATS:
            try:
                return datetime.strptime(text, f)
            except (ValueError, TypeError):
                pass

    want = [i for i, (a, b) in enumerate(data) if parse(a) and parse(b) and parse(a) >= parse(b)]
    assert one_rule(spark, data, "a string, b string", "temporal_violation", ("a", "b"), {}, "timestamp_compare") == want
    assert one_rule(spark, data[:1], "a string, b string", "temporal_violation", ("a", "b"), {"strict": False},
                    "timestamp_compare") == []


def test_conditional_check_against_plain_python(spark):
    rng = random.Random(3)
    data = [(rng.choice(["a", "b", None]), rng.choice([0.0, 1.0, 2.5, None, float("nan")])) for _ in range(200)]
    ops = {"eq": lambda x, v: x == v, "neq": lambda x, v: x != v, "gt": lambda x, v: x is not None and x > v,
           "gte": lambda x, v: x is not None and x >= v, "lt": lambda x, v: x is not None and x < v,
           "lte": lambda x, v: x is not None and x <= v, "nope": lambda x, v: True}
    for op, ok in ops.items():
        for when in (["a"], ["a", None]):
            cond = {"when_column": "w", "when_values": when, "check_column": "c", "check_op": op, "check_value": 1}
            want = [i for i, (w, c) in enumerate(data) if w in when and not ok(c, 1)]
            got = one_rule(spark, data, "w string, c double", "cross_column_inconsistency", ("w", "c"),
                           {"conditions": [cond]}, "value_condition")
            assert got == sorted(want, key=str) or sorted(got) == want, op


def test_conditional_unlike_types(spark):
    cond = {"when_column": "w", "when_values": ["a"], "check_column": "c", "check_op": "gt", "check_value": 0}
    assert one_rule(spark, [("a", "5"), ("b", "5")], "w string, c string", "cross_column_inconsistency", ("w", "c"),
                    {"conditions": [cond]}, "value_condition") == [0]


def test_columns_that_should_differ(parcels):
    rule = Rule("A", "cross_column_inconsistency", ("sender_name", "receiver_name"), "custom_check",
                {"check_type": "equality", "should_differ": True})
    assert ids(sus.find_suspects(parcels, [rule]), "true") == [NUMBER["to oneself"]]


def test_custom_checks(spark):
    df = spark.createDataFrame([("1", "hub A", "A"), ("2", "hub B", "A"), ("3", None, "A"), ("4", "hub C", None)], "record_id string, x string, y string")

    def found(tool, params):
        rule = Rule("C", "cross_column_inconsistency", ("x", "y"), tool, params)
        return [r["record_id"] for r in sus.find_suspects(df, [rule]).orderBy("record_id").collect()]

    within = {"when_column": "y", "when_values": ["A"], "check_column": "x", "check_op": "contains", "check_value": "hub A"}
    assert found("value_condition", {"conditions": [within]}) == ["2"]
    assert found("value_condition", {"conditions": [within | {"check_op": "contains_column", "check_value": "y"}]}) == ["2"]
    assert found("custom_check", {"condition": "x == None OR y == None"}) == ["3", "4"]
    assert found("custom_check", {"predicate": lambda t: ~t.text("x").contains("A")}) == ["2", "4"]
    bad = Rule("B", "cross_column_inconsistency", ("x", "y"), "custom_check", {"condition": "x.strip() == y"})
    assert [i for i, _ in rule_errors([bad], df.schema)] == ["B"]


def test_address_flag_with_missing_values(spark):
    rule = Rule("A", "cross_column_inconsistency", ("address", "flag"), "address_classify")
    df = spark.createDataFrame([("1", None, 1), ("2", "", 1), ("3", "테헤란로 152", None), ("4", "역삼동 8", 0)],
                               "record_id string, address string, flag int")
    got = rows(sus.find_suspects(df, [rule]), "record_id", "severity", "reason")
    assert [g[0] for g in got] == ["1", "3"]
    assert got[0][1] == "info" and got[1][2] == "Address is road type but flag=None"


def test_repeated_ids_are_deduplicated(spark):
    df = spark.createDataFrame([("1", i % 7 + 10) for i in range(500)] + [("2", 11)], "record_id string, c int").repartition(4)
    rule = Rule("R", "out_of_range", ("c",), "range_check", {"max_value": 5})
    got = rows(sus.find_first_suspects(df, [rule], unique_key=False), "record_id", "current_values")
    assert got == [("1", {"c": "10"}), ("2", {"c": "11"})]


def test_rates(parcels):
    got = {(r["rule_id"], r["columns"]): r for r in sus.rule_rates(parcels, DEFAULT_RULES).collect()}
    tracking = got["R002-tracking_id_format", "tracking_id"]
    assert (tracking["violation_count"], tracking["total_checked"], tracking["alert"]) == (3, TOTAL - 1, False)
    assert got["R003-dispatch_before_arrival", "dispatch_time,arrival_time"]["total_checked"] == TOTAL - 1


def test_statistics(parcels):
    found = sus.find_first_suspects(parcels, DEFAULT_RULES)
    total = found.count()
    both = sus.counts_by_type_and_severity(found).collect()
    assert sum(r["n"] for r in both if r["error_type"]) == total == sum(r["n"] for r in both if r["severity"])
    assert abs(sum(r["percent"] for r in sus.type_share(found).collect()) - 100) < 0.01


def test_search(parcels):
    assert ids(sus.rows_matching(parcels, "윤가람"), "true") == [NUMBER["to oneself"]]
    assert ids(sus.rows_matching(parcels, "qx77"), "true") == [NUMBER["letters in number"]]


# --- rule sets ----------------------------------------------------------------

def test_rule_sets():
    assert len(DEFAULT_RULES) == 9 and len(DELIVERY_RULES) == 14
    assert {r.rule_id for r in by_column(DEFAULT_RULES, "road_addr_yn")} == {
        "R001-road_addr_yn_enum", "R004-address_road_yn_match"}
    assert len(by_error_type(DEFAULT_RULES, "out_of_range")) == 3 and len(by_tool(DEFAULT_RULES, "regex_validate")) == 3
    assert [(r["kind"], r["source_column"]) for r in relations(DEFAULT_RULES)] == [
        ("temporal", "dispatch_time"), ("cross_column", "address"), ("cross_column", "payment_method")]


def test_rules_from_text_and_table(spark, tmp_path):
    text = '{"rules": [{"rule_id": "X", "error_type": "out_of_range", "target_columns": ["c"], "validation_tool": ' \
           '"range_check", "params": {"max_value": 3}}]}'
    (rule,) = parse_rules(text)
    assert rule.params == {"max_value": 3} and rule.enabled and rule.severity == "warning"
    pytest.importorskip("yaml")
    assert parse_rules("rules:\n- {rule_id: X, error_type: out_of_range, target_columns: [c], validation_tool: range_check}")
    with pytest.raises(ValueError):
        parse_rules("{}")
    path = tmp_path / "rules.json"
    path.write_text(text)
    assert load_rules(spark, str(path)) == [rule]
    assert load_rules(spark, str(tmp_path / "absent"), default_if_missing=True) == list(DEFAULT_RULES) == load_rules(spark)
    for bad in (tmp_path / "absent", tmp_path / "typo.json"):
        (tmp_path / "typo.json").write_text(text.replace("out_of_range", "out_of_rang"))
        with pytest.raises(Exception):
            load_rules(spark, str(bad))
    assert sorted(rules_from_df(rules_df(spark, DEFAULT_RULES)), key=lambda r: r.rule_id) == sorted(
        DEFAULT_RULES, key=lambda r: r.rule_id)
    many = [rule.__class__(f"R{i}", "out_of_range", ("c",), "range_check", {"max_value": i}) for i in range(6000)]
    assert len(rules_from_df(rules_df(spark, many))) == 6000


def test_a_broken_rule_stops_no_other(parcels):
    broken = Rule("bad", "format_inconsistency", ("tracking_id",), "regex_validate", {"pattern": "("})
    empty = Rule("idle", "cross_column_inconsistency", ("weight_kg",), "custom_check", {})
    assert [i for i, _ in rule_errors([broken, empty, *DEFAULT_RULES], parcels.schema)] == ["bad", "idle"]
    assert sus.find_suspects(parcels, [broken, *DEFAULT_RULES]).count() == sus.find_suspects(parcels, DEFAULT_RULES).count()


def test_a_rule_may_name_a_column_twice(parcels):
    rule = Rule("twice", "cross_column_inconsistency", ("status_code", "status_code"), "value_condition",
                {"conditions": [{"when_column": "status_code", "when_values": ["LIMBO"], "check_column": "status_code", "check_op": "eq",
                                 "check_value": "PICKUP", "reason": "r"}]})
    assert [r["current_values"] for r in sus.find_suspects(parcels, [rule]).collect()] == [{"status_code": "LIMBO"}]


def test_disabled_rules_do_not_run(parcels):
    from dataclasses import replace

    assert sus.find_suspects(parcels, [replace(r, enabled=False) for r in DEFAULT_RULES]).count() == 0


def test_generated_rule_ids():
    raw = {"error_type": "out_of_range", "target_columns": ["c"], "validation_tool": "range_check"}
    out = number_generated([{**raw, "rule_id": "x"}, {**raw, "rule_id": "AUTO-77"}, {**raw, "enabled": False}])
    assert [r.rule_id for r in out] == ["AUTO-001", "AUTO-77", "AUTO-003"]
    clash = number_generated([{**raw, "rule_id": "AUTO-002"}, raw, {**raw, "rule_id": "AUTO-002"}])
    assert [r.rule_id for r in clash] == ["AUTO-002", "AUTO-003", "AUTO-004"]
    assert all(r.enabled and r.severity == "warning" for r in out)


# --- plans --------------------------------------------------------------------

def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_all_rules_in_one_scan_without_shuffle_or_python(spark, sf):
    rules = [Rule(f"L{i}", "out_of_range", ("l_quantity", "l_tax"), "range_check", {"max_value": 40 + i % 5}) for i in range(30)]
    text = plan(sus.find_first_suspects(spark.read.parquet(f"{sf}/lineitem.parquet"), rules, "l_orderkey"))
    assert text.count("FileScan") == 1
    assert "Exchange" not in text and "Python" not in text
    scan = re.search(r"ReadSchema: struct<(.*?)>", text).group(1)
    assert sorted(c.split(":")[0] for c in scan.split(",")) == ["l_orderkey", "l_quantity", "l_tax"]


def test_checks_are_evaluated_once(spark, sf):
    rule = Rule("T", "temporal_violation", ("o_orderpriority", "o_orderstatus"), "timestamp_compare")
    text = plan(sus.find_first_suspects(spark.read.parquet(f"{sf}/orders.parquet"), [rule], "o_orderkey"))
    assert text.count("gettimestamp") == 8  # four formats for each of two columns


def test_more_checks_than_bits_in_a_word(spark):
    """One rule over 130 columns between rules over a few: masks span words, one suspect per rule."""
    n, rng = 130, random.Random(9)
    data = [[rng.choice([0] * 30 + [9]) for _ in range(n)] for _ in range(40)] + [[0] * n, [9] * n]
    df = spark.createDataFrame([(str(i), *row) for i, row in enumerate(data)],
                               "record_id string, " + ", ".join(f"c{i} int" for i in range(n)))

    def rule(name, columns):
        return Rule(name, "out_of_range", tuple(f"c{i}" for i in columns), "range_check", {"max_value": 5})

    spans = {"a": range(0, 7), "wide": range(n), "b": range(50, 120), **{f"r{i}": [i] for i in range(0, n, 3)}}
    rules = [rule(name, columns) for name, columns in spans.items()]
    want_all, want_first = [], []
    for i, row in enumerate(data):
        for name, columns in spans.items():
            bad = [f"c{c}" for c in columns if row[c] > 5]
            want_all += [(str(i), name, [c]) for c in bad]
            want_first += [(str(i), name, [c]) for c in bad[:1]]
    key = ("record_id", "rule_id", "target_columns")
    assert rows(sus.find_suspects(df, rules), *key) == sorted(want_all, key=repr)
    assert rows(sus.find_first_suspects(df, rules), *key) == sorted(want_first, key=repr)
