"""Tables kept in order: pages by number and by key, what they read, and what they write."""

import datetime as dt
import glob
import random

import pytest
from pyspark.sql import functions as F

from tamis.operators import pages
from tamis.session import fresh_path, shared_folder

KEYS = ["-amount", "name"]


def ordered(rows):
    """Descending amounts with NULLs last, then names with NULLs first."""
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = [(rng.choice([None, *range(40)]), rng.choice([None, "", "a", "é", "z'"]) if i % 9 else None, i) for i in range(900)]
    return out + [(17, "hot", 10_000 + i) for i in range(450)]  # a third of all rows has one key


@pytest.fixture(scope="module")
def path(spark, rows):
    df = spark.createDataFrame(rows, "amount int, name string, n int").repartition(5)
    return pages.write_ordered(df, fresh_path(spark, "ordered"), KEYS, files=12)


def key(r):
    return (r["amount"], r["name"])


def test_pages_by_number(spark, path, rows):
    want, got = ordered(rows), []
    for i in range(0, 6):
        page = pages.page(spark, path, 250, i).collect()
        assert all((r["total_count"], r["chunk_count"]) == (1350, 6) for r in page)
        assert [r["row_no"] for r in page] == list(range(i * 250 + 1, min((i + 1) * 250, 1350) + 1))
        got += page
    assert [key(r) for r in got] == [r[:2] for r in want] and {r["n"] for r in got} == {r[2] for r in rows}
    assert pages.page(spark, path, 250, 6).collect() == [] and pages.page(spark, path, 250, 60).collect() == []


def test_a_hot_key_is_dealt_over_files(spark, path):
    index = pages.read_index(spark, path).orderBy("part").collect()
    assert sum(r["rows"] for r in index) == 1350 and max(r["rows"] for r in index) < 300
    assert [r["before"] for r in index] == [sum(x["rows"] for x in index[:i]) for i in range(len(index))]
    assert sum(r["first"]["k0"] == 17 == r["last"]["k0"] for r in index) >= 2


def test_pages_by_key(spark, path, rows):
    want = ordered(rows)
    for after in [(40, "x"), (39, None), (17, "a"), (17, "hot"), (3, "é"), (0, "z'"), (None, None), (None, "a"), (None, "zz")]:
        left = [r[:2] for r in want if ordered([r, (*after, 0)])[0][:2] == after and r[:2] != after]
        for size in (1, 120, 2000):
            got = pages.page_at_key(spark, path, after, size).collect()
            assert [key(r) for r in got] == left[:size], (after, size)
            assert [r["row_no"] for r in got] == list(range(1351 - len(left), 1351 - len(left) + len(got)))
    with pytest.raises(ValueError, match="ordered by"):
        pages.page_at_key(spark, path, (1,), 10)


def test_a_page_reads_its_files_and_writes_nothing(spark, path):
    def written():
        return set(glob.glob(shared_folder(spark) + "/**/*", recursive=True))

    before = written()
    middle = pages.page(spark, path, 20, 30)
    assert middle.count() == 20 and 1 <= len(middle.inputFiles()) <= 2
    after = pages.page_at_key(spark, path, (12, "a"), 20)
    assert after.count() == 20 and 1 <= len(after.inputFiles()) <= 2
    assert pages.page(spark, path, 20, 31).count() == 20
    assert written() == before


def test_staged_rows_are_deleted(spark):
    path = pages.write_ordered(spark.range(100).repartition(3), fresh_path(spark, "ordered"), ["id"], files=2)
    assert not glob.glob(shared_folder(spark) + "/tamis/unordered-*")
    assert [r["id"] for r in pages.page(spark, path, 7, 3).collect()] == list(range(21, 28))


def test_empty_tables_and_other_types(spark):
    empty = spark.createDataFrame([], "when timestamp, part int, file string, before long")
    path = pages.write_ordered(empty, fresh_path(spark, "ordered"), ["when"])
    assert pages.page(spark, path, 5, 0).collect() == [] and pages.page_at_key(spark, path, (None,), 5).collect() == []
    # columns named like those of the index
    at = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=h) for h in range(50)]
    named = spark.createDataFrame([(t, i, "f", i * 2) for i, t in enumerate(at)], empty.schema).repartition(4)
    path = pages.write_ordered(named, fresh_path(spark, "ordered"), ["when"], files=5)
    got = pages.page_at_key(spark, path, (at[30],), 4).collect()
    assert [(r["when"], r["part"], r["before"], r["row_no"]) for r in got] == [(at[i], i, 2 * i, i + 1) for i in range(31, 35)]
    assert [r["part"] for r in pages.page(spark, path, 10, 4).collect()] == list(range(40, 50))


def test_without_staging_the_order_is_the_same(spark, rows):
    where = fresh_path(spark, "plain")
    spark.createDataFrame(rows, "amount int, name string, n int").repartition(4).write.parquet(where)
    path = pages.write_ordered(spark.read.parquet(where), fresh_path(spark, "ordered"), KEYS, rows_per_file=100, staged=False)
    assert pages.read_index(spark, path).count() >= 10
    got = pages.page(spark, path, 2000, 0)
    assert [key(r) for r in got.collect()] == [r[:2] for r in ordered(rows)]
    assert got.agg(F.count_distinct("row_no")).head()[0] == 1350
