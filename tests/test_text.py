"""Text and array functions against plain Python."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tandemlens.functions import arrays, text, vectors

TEXT = st.text(alphabet="ab \t\n\x0b\x1c\x85\xa0 　é", max_size=20)
FEW = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@FEW
@given(st.lists(TEXT, min_size=1, max_size=30))
def test_words_follow_python_split(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    c = F.col("t")
    rows = df.select(
        text.words(c).alias("w"), text.word_count(c).alias("n"), text.strip(c).alias("s"), text.is_blank(c).alias("b")
    ).collect()
    for t, r in zip(texts, rows):
        assert r.w == t.split()
        assert r.n == len(t.split())
        assert r.s == t.strip()
        assert r.b == (not t.strip())


@FEW
@given(
    st.lists(
        st.tuples(st.lists(st.sampled_from(["x", "y", " "]), max_size=6), st.integers(-8, 8), st.integers(-8, 8)),
        min_size=1,
        max_size=30,
    )
)
def test_spans_follow_python_slices(spark, cases):
    df = spark.createDataFrame(cases, "t array<string>, s int, e int")
    t, s, e = F.col("t"), F.col("s"), F.col("e")
    rows = df.select(
        arrays.span_text(t, s, e).alias("strict"), arrays.span_text_loose(t, s, e).alias("loose")
    ).collect()
    for (tokens, start, end), r in zip(cases, rows):
        n = len(tokens)
        strict = None
        if start >= 0 and end > start and end <= n:
            strict = " ".join(tokens[start:end]).strip() or None
        assert r.strict == strict
        assert r.loose == (" ".join(tokens[start:end]) if start < n and end <= n else None)


def test_pad_and_mask(spark):
    df = spark.createDataFrame([([1, 2],), ([],), (list(range(12)),)], "a array<int>")
    rows = df.select(
        arrays.pad_or_cut(F.col("a"), 5, F.lit(0)).alias("p"), arrays.attention_mask(F.col("a"), 5).alias("m")
    ).collect()
    assert [r.p for r in rows] == [[1, 2, 0, 0, 0], [0] * 5, [0, 1, 2, 3, 4]]
    assert [r.m for r in rows] == [[1, 1, 0, 0, 0], [0] * 5, [1] * 5]


def test_answers(spark):
    df = spark.createDataFrame([([],), ([""],), (None,), ([" ", "x"],)], "a array<string>")
    assert [r[0] for r in df.select(arrays.any_answer(F.col("a"))).collect()] == [False, False, False, True]
    assert df.select(arrays.non_empty(F.col("a"))).collect()[3][0] == [" ", "x"]


def test_capped_values(spark):
    df = spark.createDataFrame([(list(range(20)), ([["a"] * 12],))], "a array<int>, s struct<x: array<array<string>>>")
    row = df.select(
        *[arrays.capped(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields]
    ).first()
    assert row.a == list(range(10)) and row.s.x == [["a"] * 10]
    assert df.select(arrays.list_as_text(F.col("s.x")[0])).first()[0] == " ".join(["a"] * 10)


def test_html_sniff_and_display(spark):
    df = spark.createDataFrame([("<!DOCTYPE html>",), ("x" * 101 + "<html",), ("y" * 201,)], "t string")
    rows = df.select(text.looks_like_html(F.col("t")), text.shorten(F.col("t"))).collect()
    assert [r[0] for r in rows] == [True, False, False]
    assert rows[2][1] == "y" * 200 + "..."


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([0.5**0.5, 0.0])
