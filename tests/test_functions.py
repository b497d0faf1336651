"""Literal cases of scalar functions and semantics."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import core as C
from quillon.functions import datetime as D
from quillon.functions import json as J
from quillon.functions import semantics as S
from quillon.functions.printf import format_text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("text", "start", "count", "want"), [
    ("hello", 0, 3, "he"), ("hello", -3, 2, "ll"), ("hello", -7, 4, "h" "e"), ("hello", 3, -2, "he"), ("hello", 0, -1, ""), ("hello", 6, 1, ""), ("hello", 2, None, "ello"), ("", 1, 1, ""), (None, 1, 1, None),
])
def test_substr(spark, text, start, count, want):
    assert one(spark, C.substr(F.lit(text).cast("string"), start, count)) == want


@pytest.mark.parametrize(("a", "b", "div", "mod"), [(7, 2, 3, 1), (-7, 2, -3, -1), (7, -2, -3, 1), (1, 0, None, None), (S.INT_MIN, -1, None, 0), (9223372036854775807, 10, 922337203685477580, 7), (None, 1, None, None)])
def test_division(spark, a, b, div, mod):
    x, y = F.lit(a).cast("long"), F.lit(b).cast("long")
    assert one(spark, S.int_div(x, y)) == div
    assert one(spark, S.modulo(x, y)) == mod


@pytest.mark.parametrize(("text", "integer", "real"), [("12abc", 12, 12.0), (" -3.5e1x", -3, -35.0), ("abc", 0, 0.0), ("", 0, 0.0), ("99999999999999999999", 9223372036854775807, 1e20), (".5", 0, 0.5)])
def test_casts(spark, text, integer, real):
    assert one(spark, S.cast_integer(F.lit(text))) == integer
    assert one(spark, S.cast_real(F.lit(text))) == real


@pytest.mark.parametrize(("value", "text"), [(1.0, "1.0"), (1e8, "100000000.0"), (1e20, "1.0e+20"), (0.1, "0.1"), (1 / 3, "0.333333333333333"), (1.5e-10, "1.5e-10")])
def test_real_text(value, text):
    assert S.format_real(value) == text


@pytest.mark.parametrize(("declared", "kind"), [("INTEGER", "INTEGER"), ("VARCHAR(10)", "TEXT"), ("BLOB", "BLOB"), ("", "BLOB"), ("DOUBLE", "REAL"), ("DECIMAL(10,2)", "NUMERIC"), ("POINT", "INTEGER")])
def test_affinity(declared, kind):
    assert S.affinity(declared) == kind


@pytest.mark.parametrize(("text", "pattern", "want"), [("abc", "a*", True), ("abc", "A*", False), ("a]c", "a[]]c", True), ("abc", "a[^b]c", False), ("a.c", "a.c", True), ("abc", "a.c", False), ("abc", "[", False)])
def test_glob(spark, text, pattern, want):
    assert one(spark, S.glob(F.lit(text), pattern)) is want


@pytest.mark.parametrize(("modifiers", "want"), [
    (("+1 month",), "2024-03-02 10:20:30"), (("start of month", "+1 month", "-1 day"), "2024-01-31 00:00:00"), (("weekday 3",), "2024-01-31 10:20:30"), (("weekday 0",), "2024-02-04 10:20:30"),
    (("+1 year",), "2025-01-31 10:20:30"), (("-25 hours",), "2024-01-30 09:20:30"), (("+01:30",), "2024-01-31 11:50:30"), (("+0001-01-01",), "2025-03-04 10:20:30"), (("no such",), None),
])
def test_date_modifiers(spark, modifiers, want):
    assert one(spark, D.datetime(F.lit("2024-01-31 10:20:30"), *modifiers)) == want


@pytest.mark.parametrize(("form", "args", "want"), [
    ("%5d|%-5d|%05d", [42, 42, 42], "   42|42   |00042"), ("%s %q %Q", ["a", "b'c", None], "a b''c NULL"), ("%.3f", [2.0], "2.000"), ("%g", [1e10], "1e+10"), ("%x %X %o", [255, 255, 8], "ff FF 10"),
    ("%d%%", ["12abc"], "12%"), ("%s", [None], ""), ("%,d", [1234567], "1,234,567"), ("%c", ["hello"], "h"), ("%5.2s|", ["abc"], "   ab|"),
])
def test_printf(form, args, want):
    assert format_text(form, args) == want


@pytest.mark.parametrize(("text", "want"), [('{"a":[1,2.50,{"b":null}]}', None), ("[1, 2 ,3]", "[1,2,3]"), ("{a:1,'b':.5,}", '{"a":1,"b":0.5}'), ("0x1F", "31"), ('"\\u00e9"', '"é"'), ("{}", "{}")])
def test_json_dump(text, want):
    assert J.parse(text).dump() == (want or text)


@pytest.mark.parametrize("text", ["", "[1,", "{", '{"a"}', "nope", "[1 2]", '"open', "01"])
def test_json_malformed(text):
    with pytest.raises(J.Malformed):
        J.parse(text)


values = st.recursive(st.none() | st.booleans() | st.integers(-(10**9), 10**9) | st.text(max_size=5), lambda v: st.lists(v, max_size=4) | st.dictionaries(st.text(max_size=3), v, max_size=4), max_leaves=12)


@given(values)
def test_json_round_trip(value):
    import json

    text = json.dumps(value, ensure_ascii=False)
    assert json.loads(J.parse(text).dump()) == value


@given(values)
def test_json_tree_ids_are_unique(value):
    import json

    ids = [r[4] for r in J.walk(J.parse(json.dumps(value)), "$", True)]
    assert len(ids) == len(set(ids)) and ids == sorted(ids)
