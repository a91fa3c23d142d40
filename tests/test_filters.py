import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pointsmith.operators import filters, search

ROWS = [
    ("1", {"a": 1, "s": "Red Fox", "t": ["x", "y"], "o": {"b": {"c": 5}}, "diet": [{"food": "leaf", "raw": True}, {"food": "meat", "raw": False}]}),
    ("2", {"a": 2.0, "s": "blue", "t": ["z"], "o": {"b": {"c": 6}}, "diet": [{"food": "leaf", "raw": False}]}),
    ("3", {"a": "1", "s": None, "t": [], "o": {}}),
    ("x", {"b": True}),
]


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame([(i, json.dumps(p)) for i, p in ROWS], "id string, payload string").cache()


def ids(points, flt):
    return [r["id"] for r in search.filtered(points, flt, filters.Json("payload")).orderBy("id").collect()]


@pytest.mark.parametrize(
    "condition, expected",
    [
        ({"key": "a", "match": {"value": 1}}, ["1"]),
        ({"key": "a", "match": {"value": "1"}}, ["3"]),
        ({"key": "a", "match": {"value": 2}}, ["2"]),
        ({"key": "a", "match": {"any": [1, "1"]}}, ["1", "3"]),
        ({"key": "b", "match": {"value": True}}, ["x"]),
        ({"key": "b", "match": {"value": 1}}, []),
        ({"key": "s", "match": {"value": None}}, ["3"]),
        ({"key": "t", "match": {"value": "x"}}, ["1"]),
        ({"key": "t", "match": {"any": ["x", "z"]}}, ["1", "2"]),
        ({"key": "s", "match": {"text": "fox BLUE"}}, ["1", "2"]),
        ({"key": "s", "match": {"text": "  "}}, []),
        ({"key": "a", "range": {"gte": 1, "lt": 2}}, ["1"]),
        ({"key": "a", "range": {}}, ["1", "2"]),
        ({"key": "o.b.c", "range": {"gt": 5}}, ["2"]),
        ({"key": "diet[].food", "match": {"value": "meat"}}, ["1"]),
        ({"nested": {"key": "diet", "filter": {"must": [{"key": "food", "match": {"value": "leaf"}}, {"key": "raw", "match": {"value": True}}]}}}, ["1"]),
        ({"nested": {"key": "diet", "filter": {"must": [{"key": "food", "range": {"gt": 1}}]}}}, []),
        ({"has_id": [1, "x"]}, ["1", "x"]),
        ({"key": "a", "geo": {}}, []),
        ({"should": [{"key": "a", "match": {"value": 1}}, {"has_id": ["x"]}]}, ["1", "x"]),
        ({"field": "a", "value": 1, "operator": "ne"}, ["2", "3", "x"]),
        ({"field": "a", "value": 1, "operator": "gt"}, ["2"]),
    ],
)
def test_conditions(points, condition, expected):
    assert ids(points, {"must": [condition]}) == expected
    # The complement holds the rest: logic is two-valued.
    assert ids(points, {"must_not": [condition]}) == sorted({i for i, _ in ROWS} - set(expected))


def test_no_filter(points):
    assert len(ids(points, None)) == len(ids(points, {})) == 4


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(lo=st.integers(-3, 3), hi=st.integers(-3, 3))
def test_typed_and_json_agree(spark, lo, hi):
    df = spark.createDataFrame([(str(i), i) for i in range(-3, 4)] + [("n", None)], "id string, a int").withColumn("payload", F.to_json(F.struct("a")))
    flt = {"must": [{"key": "a", "range": {"gte": lo}}], "must_not": [{"key": "a", "match": {"value": hi}}]}
    typed = {r["id"] for r in search.filtered(df, flt).collect()}
    assert typed == {r["id"] for r in search.filtered(df, flt, filters.Json("payload")).collect()} == {str(i) for i in range(lo, 4) if i != hi}


def test_pushed_to_scan(spark, data):
    df = search.filtered(spark.read.parquet(f"{data}/embeddings.parquet"), {"must": [{"key": "label", "match": {"value": 2}}]})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(label,2)" in plan
