"""The traps of the scalar functions, by hand."""

import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import json_parse as J
from plumbline.functions import scalar as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,want", [("00:00:01.5", 1.5), ("25:61:00.1239", 25 * 3600 + 61 * 60 + 0.123), ("00:00:10", None), ("0:0:1.5.6", None), ("a:b:c.1", None), ("1:2.3", None), (None, None)])
def test_parse_timestamp(spark, text, want):
    got = one(spark, S.parse_timestamp(F.lit(text).cast("string")))
    assert got == pytest.approx(want) if want is not None else got is None


@pytest.mark.parametrize("seconds,want", [(10.0, "00:00:09.999"), (-3.0, "00:00:00.000"), (0.0, "00:00:00.000"), (3661.5, "01:01:01.499"), (90000.25, "25:00:00.249")])
def test_format_timestamp(spark, seconds, want):
    assert one(spark, S.format_timestamp(F.lit(seconds))) == want


@pytest.mark.parametrize("text,want", [("0:0:1.5", True), ("24:00:00.0", False), ("23:59:60.0", False), ("23:59:59.1234567", False), ("00:00:01", False)])
def test_valid_timestamp(spark, text, want):
    assert one(spark, S.valid_timestamp(F.lit(text))) is want


@pytest.mark.parametrize("pred,truth,want", [
    ("2", "2.05", True), ("3", "2", False), ('"00:00:01.5"', '"00:00:02"', True), ('"00:00:01"', '"00:00:02"', False), ('" Yes "', '"yes"', True), ("true", "true", True), ("true", "1", True), ("true", "2", False),
    ("5", '"5"', False), ('"1e2"', '"100"', True), ('"nan"', '"nan"', False), ("[1, 2]", "[1, 2]", True), ("[1]", "[2]", False), ("null", "null", True),
])
def test_values_close(spark, pred, truth, want):
    assert one(spark, F.coalesce(S.values_close(F.parse_json(F.lit(pred)), F.parse_json(F.lit(truth))), F.lit(False))) is want


@pytest.mark.parametrize("text,choices,want", [("B. x", ["a", "b"], 1), ("(c) xyz", ["q", "r"], None), ("I say Dog then cat", ["cat", "dog"], 1), ("cat", ["cat", "cat"], 0), ("zzz", ["a!"], None), ("", ["a"], None), ("x a", ["", "a"], 1)])
def test_match_choice(spark, text, choices, want):
    assert one(spark, S.match_choice(F.lit(text), F.array(*map(F.lit, choices)))) == want


@pytest.mark.parametrize("answer,prediction,want", [("", "anything", True), ("N/A", "N/A", False), (None, "x", False), ("x", None, False), (" ab ", "cabd", True), ("AB", "ab", False)])
def test_is_correct(spark, answer, prediction, want):
    assert one(spark, S.is_correct(F.lit(answer).cast("string"), F.lit(prediction).cast("string"))) is want


def test_json_payloads():
    assert J.payload('```json\n{"a": 1}\n``` tail') == {"a": 1}
    assert J.payload('so {"a": "}"} {"b": 2}') == {"a": "}"}
    assert J.payload("[1]") == {"tool_calls": [1]}
    assert J.payload('{bad} {"b": 2}') is None
    assert J.payload("no") is None and J.payload(None) is None
    assert J.turn_of('```json\n{"a": 1}\n```') == {"a": 1} and J.turn_of('say ```{"a": 1}```') is None and J.turn_of('{"a": 1} x') is None
    assert J.calls_of('{"tool_calls": [{"tool_name": "x", "parameters": {"b": 1, "a": 2}}]}') == [("x", '{"a": 2, "b": 1}')]
    assert J.calls_of('{"tool_calls": [{"tool_name": "x"}, {"tool_name": 3}]}') is None


@given(st.recursive(st.none() | st.booleans() | st.text(max_size=5), lambda x: st.dictionaries(st.text(max_size=4), x, max_size=3), max_leaves=6))
def test_first_object_round_trip(value):
    text = json.dumps({"v": value})
    assert J.first_object("prose " + text + " more }") == text


def test_extract_calls_column(spark):
    df = spark.createDataFrame([('{"tool_calls": [{"tool_name": "x", "parameters": {}}]}',), ("bad",), (None,)], "t string")
    got = [r[0] for r in df.select(J.extract_calls("t")).collect()]
    assert got[0][0]["tool_name"] == "x" and got[1] is None and got[2] is None
