"""Mergeable profiles and heavy hitters against exact figures."""

import datetime as dt
import random
from collections import Counter
from functools import reduce

import pytest
from pyspark.sql import DataFrame, functions as F

from tamis.operators import profile, sketches
from tamis.sinks import append_log
from tamis.session import fresh_path

SCHEMA = "n long, d double, s string, t timestamp, b boolean, void string, part int"
EXACT = ["total_count", "null_count", "null_rate", "min_value", "max_value", "mean_value", "stddev_value"]


@pytest.fixture(scope="module")
def df(spark):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    rows = [(rng.randint(0, 10 ** 6) if i % 10 else None, 1e9 + rng.random() if i % 7 else float("nan") if i % 3 else None,
             rng.choice(["12", "x", "7.5", "hot", "hot", f"v{i}"]), start + dt.timedelta(minutes=i % 500), bool(i % 2), None, i % 3 + (i % 3 == 2) * 5) for i in range(6000)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def by_name(rows, columns):
    return {r["column_name"]: tuple(r[c] for c in columns) for r in rows}


def test_merged_states_profile_the_whole(spark, df):
    path, columns = fresh_path(spark, "states"), df.columns[:-1]
    for part in (0, 1, 7, 99):  # the last one is empty
        append_log(sketches.profile_state(df.filter(F.col("part") == part), columns, frequent=64), path)
    merged = sketches.merge_states(spark.read.parquet(path), frequent=64)
    got = sketches.profile_from_state(merged, quantiles=[0.1, 0.5], top_n=2).collect()
    whole = profile.profile_columns(df.drop("part")).collect()
    want = by_name(whole, EXACT)
    for name, values in by_name(got, EXACT).items():
        assert values[:5] == want[name][:5]
        assert all(a == pytest.approx(b, rel=1e-9, abs=1e-3, nan_ok=True) if b is not None else a is None for a, b in zip(values[5:], want[name][5:])), name
    for name, (u,) in by_name(got, ["unique_count"]).items():
        assert abs(u - by_name(whole, ["unique_count"])[name][0]) <= 1 + sketches.DISTINCT_ERROR * u, name
    ordered = sorted(r["n"] for r in df.filter("n IS NOT NULL").collect())
    for q, value in zip((0.1, 0.5), by_name(got, ["q10", "q50"])["n"]):
        assert abs(sum(x <= value for x in ordered) / len(ordered) - q) <= sketches.RANK_ERROR
    assert by_name(got, ["q10", "q50"])["t"] == (None, None) and by_name(got, ["q50"])["void"] == (None,)
    top = {r["column_name"]: r["top_values"] for r in got}
    n_hot = df.filter("s = 'hot'").count()
    assert top["s"][0]["item"] == "hot" and abs(top["s"][0]["count"] - n_hot) <= 6000 * 2.7 / 64 and top["void"] == []


def test_states_by_table_and_in_any_order(spark, df):
    parts = [sketches.profile_state(df.filter(F.col("part") == p), ["n", "s"]).withColumn("table_name", F.lit("ab"[p % 2])) for p in (0, 1, 7)]
    merged = sketches.merge_states(reduce(DataFrame.unionByName, reversed(parts)), by=["table_name"])
    got = {(r["table_name"], r["column_name"]): r["total_count"] for r in sketches.profile_from_state(merged, keep=["table_name"]).collect()}
    assert got == {("a", "n"): 2000, ("a", "s"): 2000, ("b", "n"): 4000, ("b", "s"): 4000}
    again = sketches.merge_states(sketches.merge_states(parts[1].unionByName(parts[2]), by=["table_name"]).unionByName(parts[0]))
    straight = sketches.merge_states(reduce(DataFrame.unionByName, parts))
    assert by_name(sketches.profile_from_state(again).collect(), EXACT[:5]) == by_name(sketches.profile_from_state(straight).collect(), EXACT[:5])


def test_deviation_around_a_far_mean(spark):
    """Sums of squares would lose all digits here."""
    parts = [spark.range(a, a + 100).selectExpr("cast(id AS double) + 1e12 AS x") for a in (0, 100, 5000)]
    merged = sketches.merge_states(reduce(DataFrame.unionByName, [sketches.profile_state(p) for p in parts]))
    want = reduce(DataFrame.unionByName, parts).agg(F.stddev_pop("x")).head()[0]
    assert sketches.profile_from_state(merged).head()["stddev_value"] == pytest.approx(want, rel=1e-6)


def test_state_of_nothing(spark, df):
    merged = sketches.merge_states(sketches.profile_state(df.limit(0), ["n", "s", "t"]))
    assert {(r["total_count"], r["unique_count"], r["min_value"], r["mean_value"]) for r in sketches.profile_from_state(merged, quantiles=[0.5]).collect()} == {(0, 0, None, None)}


# --- heavy hitters ---------------------------------------------------------------------

@pytest.mark.parametrize("share", [0.3, 0.05, 0.01])
def test_heavy_hitters(spark, share):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 2, 2, 2, 10 ** 12 + i]), rng.choice(["", "a", "a", f"u{i}", f"u{i % 30}", None]), rng.choice([0.5, -0.0, 0.0, float("nan"), i / 7])) for i in range(5000)]
    df = spark.createDataFrame(rows, "n long, s string, d double").repartition(5)
    got = {(r["column_name"], r["value"]): r["n"] for r in sketches.heavy_hitters(df, share=share).collect()}
    texts = ((c, {0.0: "0.0"}.get(v, "nan" if v != v else str(v))) for r in rows for c, v in zip("nsd", r) if v is not None)
    want = {k: n for k, n in Counter(texts).items() if n >= share * 5000}
    fold = {k: n for k, n in got.items() if k != ("d", "-0.0")}
    if ("d", "-0.0") in got:  # -0.0 and 0.0 differ as text
        fold["d", "0.0"] = fold.get(("d", "0.0"), 0) + got["d", "-0.0"]
    want = {k: n for k, n in want.items() if k != ("d", "0.0")}
    assert {k: n for k, n in fold.items() if k != ("d", "0.0")} == want
    for r in sketches.heavy_hitters(df, ["n", "s"], share=share, exact=False).collect():
        true = sum(str(x) == r["value"] for x in (row["ns".index(r["column_name"])] for row in rows) if x is not None)
        assert abs(r["n"] - true) <= r["error"] <= share * 5000 / 3 + 1


def test_no_value_is_shuffled(spark):
    df = spark.range(10_000).selectExpr("id", "cast(id % 3 AS string) AS s")
    text = sketches.heavy_hitters(df, share=0.1, exact=False)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in text and "SinglePartition" in text  # one sketch per task
    exact = sketches.heavy_hitters(df, share=0.1)
    assert sorted(map(tuple, exact.collect())) == [("s", "0", 3334), ("s", "1", 3333), ("s", "2", 3333)]
    assert sketches.heavy_hitters(df.limit(0), share=0.1).collect() == []
