"""Cell semantics against Python itself."""

import math
import random
import re
from datetime import datetime

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F, types as T

from tamis.functions import (address_kind, clean_record_id, csv_cell_type, float_text, full_match, mask_prefix,
                             parse_time, record_key_json, to_number)
from tamis.functions.cells import DEFAULT_TIME_FORMATS

TEXTS = ["1", " 1 ", "1.5", "-2e3", "1_000", "1__0", "_1", "3d", "3f", "0x1", "inf", "-Infinity", "nan", "", " ", "abc",
         ".5", "5.", "+.5e-2", "1e", "１２", "\t7\n", "1,5", "--1", "1e400", "NaN", "infinit"]


def column(spark, values, kind):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def apply(spark, values, kind, make):
    return [r[1] for r in sorted(column(spark, values, kind).select("i", make(F.col("x"))).collect())]


def test_to_number_reads_what_float_reads(spark):
    def python(v):
        try:
            return float(v)
        except ValueError:
            return None

    texts = [t for t in TEXTS if t.isascii()]
    got = apply(spark, texts, "string", lambda c: to_number(c, T.StringType()))
    for text, g in zip(texts, got):
        want = python(text)
        assert (g is None and want is None) or g == want or (math.isnan(g) and math.isnan(want)), (text, g, want)


def test_to_number_of_typed_columns(spark):
    assert apply(spark, [True, False, None], "boolean", lambda c: to_number(c, T.BooleanType())) == [1.0, 0.0, None]
    assert apply(spark, [datetime(2024, 1, 1)], "timestamp", lambda c: to_number(c, T.TimestampType())) == [None]


def test_float_text_prints_like_python(spark):
    rng = random.Random(5)
    values = [0.0, -0.0, 1.5, 1e7, 12345678.9, -2.5e10, 1e15, 9999999999999998.0, 1e16, 1.5e16, 1e22, 0.001, 0.00012345,
              0.0001, 1e-5, -1.25e-7, 1e100, 1e-100, float("nan"), float("inf"), -float("inf")]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-12, 24) for _ in range(2000)]
    got = apply(spark, values, "double", float_text)
    assert all(float(g) == v or v != v for v, g in zip(values, got))
    unlike = [(v, g) for v, g in zip(values, got) if repr(v) != g]
    assert len(unlike) <= 10 and all(abs(v) > 1e16 or abs(v) < 1e-3 for v, g in unlike), unlike


def test_parse_time_like_strptime(spark):
    texts = ["2024-01-02 03:04:05", "2024-1-2 3:4:5", "2024-01-02T03:04:05", "20240102030405", "03:04:05", "3:4:5", "24:00:00",
             "12:60:00", "12:00:60", "2024-02-30 00:00:00", "14:30", "", "x", "2024-01-02  03:04:05", "2024-01-02 03:04:05 ",
             "20240230000000", "0000-01-01 00:00:00"]

    def python(text):
        for f in DEFAULT_TIME_FORMATS:
            try:
                return datetime.strptime(text, f).isoformat()
            except ValueError:
                pass

    show = lambda c: F.date_format(parse_time(c), "yyyy-MM-dd'T'HH:mm:ss")
    assert apply(spark, texts, "string", show) == [python(t) for t in texts]


def test_parse_time_does_not_depend_on_the_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        df = column(spark, ["2024-03-10 02:30:00", "02:30:00"], "string")
        seconds = []
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            seconds.append([r[0] for r in df.select(F.unix_micros(parse_time(F.col("x")))).collect()])
        assert seconds[0] == seconds[1]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_parse_time_with_own_formats(spark):
    got = apply(spark, ["02/01/2024", "2024-01"], "string",
                lambda c: F.date_format(parse_time(c, ["%d/%m/%Y", "%Y-%m"]), "yyyy-MM-dd"))
    assert got == ["2024-01-02", "2024-01-01"]


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text(alphabet="019-A\n:", max_size=8), min_size=40, max_size=40))
def test_full_match_like_fullmatch(spark, texts):
    for pattern in (r"^\d{1,4}$", r"\d+-\d+", r"[01]?\d:\d|A", r"(?P<a>\d)(?P=a)"):
        got = apply(spark, texts, "string", lambda c: full_match(c, pattern))
        assert got == [re.fullmatch(pattern, t) is not None for t in texts]


def test_full_match_knows_unicode_digits_and_newlines(spark):
    assert apply(spark, ["１２", "12\n", "12"], "string", lambda c: full_match(c, r"^\d+$")) == [True, False, True]


def test_bad_pattern_fails_on_the_driver(spark):
    with pytest.raises(re.error):
        full_match(F.col("x"), "(")


@pytest.mark.parametrize("pattern", [r"[[a]", r"[a&&b]", r"[]x]", r"[^]&]+", r"a[\]b]\[", r"x{1,2}&&"])
def test_classes_read_as_in_python(spark, pattern):
    texts = ["[", "a", "b", "&", "&&", "]", "x", "a][", "x&&"]
    assert apply(spark, texts, "string", lambda c: full_match(c, pattern)) == [re.fullmatch(pattern, t) is not None for t in texts]


def test_address_kind(spark):
    texts = ["강릉시 솔밭로 41", "광주광역시 남구 은행동 6-1", "전주시 한옥로3가 12", "None", "부산 10-2"]
    assert apply(spark, texts, "string", address_kind) == ["road", "jibun", "ambiguous", "ambiguous", "jibun"]


def test_small_functions(spark):
    assert apply(spark, ["12345", "123456", "", None], "string", mask_prefix) == ["****", "12345****", "****", None]
    assert apply(spark, ["{'record_id': '31'}", '{"record_id": "7"}', "5"], "string", clean_record_id) == ["31", "7", "5"]
    assert apply(spark, ["1", "1.5", "a", "", None, " 7"], "string", csv_cell_type) == [
        "integer", "float", "string", "null", "null", "integer"]
    df = spark.createDataFrame([(1, None)], "b int, a string")
    assert df.select(record_key_json("b", "a")).head()[0] == '{"a":null,"b":1}'
