"""JSON of any shape against plain recursion over parsed values."""

import json

import pytest
from pyspark.sql import functions as F

from tandemlens.functions.variants import capped_json, text_of

VALUES = [
    None, True, 3, 2.5, "", "plain", 'a "quoted" \\ line\n', [], ["one"], [5], [None], [[1, 2]], list(range(25)),
    ["a", 1, None, True, {"k": 1}], {}, {"text": "inner"}, {"text": {"text": ["x", "y"]}}, {"text": None}, {"a": 1, "b": [1, 2]},
    {"text": list("abcdefghijklm")}, {"o": {"p": {"q": {"r": [{"s": {"t": {"u": [[[["deep"]]]]}}}, 7]}}}, "z": [[1] * 12] * 11},
    {"é\n": {"k\"": {"a": {"b": {"c": None, "d": False, "e": "s"}}}}},
]


def compact(value):
    return json.dumps(value, separators=(",", ":"), sort_keys=True, ensure_ascii=False)


def plain(value):
    if isinstance(value, str):
        return value
    return "" if value is None else compact(value)


def text(value):
    if isinstance(value, dict) and "text" in value:
        return text(value["text"])
    if isinstance(value, list):
        return " ".join(plain(x) for x in value[:10])
    return plain(value)


def cut(value, items, depth):
    if value is None:
        return None
    if depth < 0:
        return plain(value)
    if isinstance(value, dict):
        return {k: cut(v, items, depth - 1) for k, v in value.items()}
    if isinstance(value, list):
        return [cut(v, items, depth - 1) for v in value[:items]]
    return value


@pytest.fixture(scope="module")
def rows(spark):
    raw = [(i, json.dumps(v, ensure_ascii=False)) for i, v in enumerate(VALUES)] + [(99, "{broken"), (98, None)]
    return spark.createDataFrame(raw, "i int, raw string").select("i", F.try_parse_json("raw").alias("v"))


def test_text_of_every_shape(rows):
    got = dict(rows.select("i", text_of(F.col("v")).alias("t")).collect())
    assert got == {i: text(v) for i, v in enumerate(VALUES)} | {98: "", 99: ""}


@pytest.mark.parametrize("depth", [0, 2, 3, 5, 10])
def test_cut_by_depth_and_length(rows, depth):
    got = dict(rows.select("i", capped_json(F.col("v"), 10, depth).alias("t")).collect())
    for i, v in enumerate(VALUES):
        assert got[i] == compact(cut(v, 10, depth)), (i, v)
    assert got[98] == got[99] == "null"
