"""Many rules through the index against the same rules as expressions."""

import random

import pytest
from pyspark.sql import functions as F

from tamis.operators import suspects as sus
from tamis.plans import Rule, rule_index
from tamis.plans.checks import Table

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def df(spark):
    rng = random.Random(11)
    numbers = [None, NAN, INF, -INF, -0.0, 0.0, 1.0, 2.5, 7.0, 1e6]
    texts = [None, "", "a", "é", "Z", "😀", "1", " 2.5 ", "1_000", "nan", "7", "x1", "a\x01b", "FF", "F\n"]
    rows = [(i, rng.choice(numbers), rng.choice([None, -3, 0, 1, 7, 9, 2 ** 60]), rng.choice(texts), rng.choice([None, True, False])) for i in range(400)]
    return spark.createDataFrame(rows, "record_id long, d double, n long, s string, b boolean").repartition(3)


def rules():
    rng = random.Random(5)
    out = []

    def add(kind, columns, params, tool="range_check"):
        out.append(Rule(f"{kind[:3]}-{len(out)}", kind, columns, tool, params, rng.choice(["critical", "warning"])))

    for i in range(12):
        add("out_of_range", ("d",), {"min_value": i - 4})
        add("out_of_range", ("d", "n"), {"max_value": i + 0.5, "min_value": -i, "nullable": bool(i % 3)})
        add("out_of_range", ("s",), {"max_value": i * 100})
        add("out_of_range", ("n",), {"allowed_values": [0, i, 1.0, "7", None, True], "nullable": bool(i % 4)})
        add("out_of_range", ("d",), {"allowed_values": [2.5, i, -0.0], "max_value": 6})
        add("out_of_range", ("s",), {"allowed_values": rng.sample(["a", "é", "Z", "😀", "", "a\x01b", "1", 1, "1_000", "zz"], 5)})
        add("out_of_range", ("s",), {"allowed_values": [1, None]})  # no text is allowed
        add("format_inconsistency", ("s",), {"pattern": ["[a-z]+", r"\d+|[^0-9]*", "(?i)f+|.*", r".?\Z", "[[a]|x1"][i % 5]})
        add("format_inconsistency", ("s",), {"pattern": f".{{0,{i}}}", "nullable": False}, "regex_validate")
        for op in ("gt", "gte", "lt", "lte"):
            add("cross_column_inconsistency", ("s", "d"), {"conditions": [
                {"when_column": "s", "when_values": ["a", "é", None], "check_column": "d", "check_op": op, "check_value": i - 2, "reason": f"{op} {i}"},
                {"when_column": "b", "when_values": [True], "check_column": "n", "check_op": op, "check_value": i}]}, "value_condition")
    # what the index leaves alone
    add("format_inconsistency", ("s",), {"pattern": r"(.)\1"})
    add("format_inconsistency", ("s",), {"pattern": "("})
    add("out_of_range", ("b",), {"allowed_values": [True]})
    add("out_of_range", ("lost",), {"min_value": 3, "nullable": False})
    add("out_of_range", ("d",), {"min_value": "three"})
    add("out_of_range", ("d",), {"allowed_values": []})
    add("cross_column_inconsistency", ("s", "d"), {"conditions": [{"when_column": "s", "when_values": ["a"], "check_column": "d", "check_op": "eq", "check_value": 1}]}, "value_condition")
    return out


def found(df):
    return sorted((r["record_id"], r["rule_id"], r["error_type"], tuple(r["target_columns"]), tuple(sorted(r["current_values"].items())), r["reason"], r["severity"])
                  for r in df.collect())


@pytest.mark.parametrize("find", [sus.find_suspects, sus.find_first_suspects])
def test_as_by_expressions(df, find, monkeypatch):
    table = Table(df.schema)
    rest, many = rule_index.split_rules(rules(), table)
    assert len(rest) == 6 and len(many) == len(rules()) - 6
    got = found(find(df, rules()))
    monkeypatch.setattr(rule_index, "FEW", 10 ** 9)
    assert rule_index.split_rules(rules(), table)[1] == []
    assert got == found(find(df, rules())) and len(got) > 10_000


def test_rates_as_by_expressions(df, monkeypatch):
    got = sorted(map(tuple, sus.rule_rates(df, rules(), 0.5).drop("check_no").collect()))
    monkeypatch.setattr(rule_index, "FEW", 10 ** 9)
    assert got == sorted(map(tuple, sus.rule_rates(df, rules(), 0.5).drop("check_no").collect()))


def test_the_plan_does_not_grow_with_the_rules(spark, df):
    def nodes(n):
        many = [Rule(f"r{i}", "out_of_range", ("d",), "range_check", {"max_value": i}) for i in range(n)]
        text = sus.find_suspects(df, many)._jdf.queryExecution().optimizedPlan().toString()
        return len([line for line in text.splitlines() if "Project" in line or "Filter" in line or "Generate" in line])

    assert nodes(4096) <= nodes(64) + 8  # a projection for each doubling
    assert sus.find_suspects(df, [Rule(f"r{i}", "out_of_range", ("d",), "range_check", {"max_value": i}) for i in range(4000)]).filter(
        F.col("record_id") == -1).count() == 0


def test_empty_tables_and_no_rules(df):
    assert found(sus.find_suspects(df.limit(0), rules())) == [] and sus.rule_rates(df, []).collect() == []
    assert {r["violation_count"] for r in sus.rule_rates(df.limit(0), rules()).collect()} == {0}
