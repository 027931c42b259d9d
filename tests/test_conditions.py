"""Textual conditions against Python's own reading of them."""

import itertools

import pytest

from tamis.operators.profile import condition_counts
from tamis.plans import condition_column

ROWS = list(itertools.product(["x", "y", "", None], [0, 1, 5, None], [0.0, 1.5, None, float("nan")], [True, False, None]))
SCHEMA = "a string, b int, c double, d boolean"
CONDITIONS = [
    "a == 'x'", "a != 'x'", "a == None", "b == c", "b == d", "a == b", "b > 1", "c <= 1.5 AND b >= 1", "a > 'x'", "a > 1",
    "b > 1 OR a == 'x'", "a == 'x' OR b > 1", "not b", "not a == 'x'", "a", "c", "d and b", "a in ['x', 'z']",
    "b not in (1, 5)", "0 < b < 5", "b + 1 == c * 2", "b % 2 == 1", "c / b > 1", "-b < 0", "b is None", "zz == 1", "b == 1 OR zz == 1",
    "a == 'x' AND (b == 1 OR c == 0)", "missing == None",
]


def python(cond, row):
    names = dict(zip("abcd", row)) | {"missing": None}
    try:
        return bool(eval(cond.replace(" AND ", " and ").replace(" OR ", " or "), {"__builtins__": {}}, names))
    except Exception:
        return False


@pytest.mark.parametrize("cond", CONDITIONS)
def test_condition(spark, cond):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], "i int, " + SCHEMA)
    col = condition_column(cond, df.schema, ["a", "b", "c", "d", "missing"])
    got = {r[0] for r in df.filter(col).select("i").collect()}
    want = {i for i, r in enumerate(ROWS) if python(cond, r)}
    assert got == want, [(ROWS[i], i in got) for i in sorted(got ^ want)][:5]


@pytest.mark.parametrize("text", ["__import__('os')", "a.upper() == 'X'", "[x for x in a]", "f(1) == 1", "a[0] == 'x'"])
def test_nothing_else_is_understood(spark, text):
    df = spark.createDataFrame([("x",)], "a string")
    with pytest.raises(ValueError):
        condition_column(text, df.schema)


def test_broken_text_matches_nothing(spark):
    df = spark.createDataFrame([("x",)], "a string")
    assert df.filter(condition_column("a == ", df.schema)).count() == 0


def test_counts_in_one_pass(spark):
    df = spark.createDataFrame([("x", 1), ("y", 2), (None, 3)], "a string, b int")
    targets = [{"condition": "a == 'x'", "columns": ["a"]}, {"condition": "b > 1", "columns": ["b"], "description": "big"},
               {"condition": "b > 1", "columns": ["a"]}, {"condition": "", "columns": ["a"]}]
    assert [tuple(r) for r in condition_counts(df, targets).collect()] == [
        ("a == 'x'", "", 1), ("b > 1", "big", 2), ("b > 1", "", 0)]
