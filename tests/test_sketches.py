"""Sketches of splits against exact counts; collation by the table function against plain padding."""

import random

import pytest
from pyspark.sql import functions as F

from tandemlens.operators.collation import collate
from tandemlens.operators.sketches import BOUND, distinct_sketches, overlap_estimates, union_estimates


@pytest.fixture(scope="module")
def stored(spark):
    rng = random.Random(3)
    rows = [("a", i, "x") for i in range(20_000)] + [("b", i, None) for i in range(15_000, 30_000)]
    rows += [(None, rng.randrange(50), "y") for _ in range(3000)] + [("b", 16_000, "x")] * 2000  # a hot value
    df = spark.createDataFrame(rows, "split string, v int, w string").repartition(6)
    return distinct_sketches(df, ["v", "w"], ["split"])


def test_union_of_splits_is_within_its_error(stored):
    whole = {r.column: r.distinct for r in union_estimates(stored).collect()}
    assert abs(whole["v"] - 30_000) <= 30_000 * BOUND and whole["w"] == 2
    each = {(r.split, r.column): r.distinct for r in union_estimates(stored, ["split"]).collect()}
    assert abs(each["a", "v"] - 20_000) <= 20_000 * BOUND
    assert abs(each["b", "v"] - 15_000) <= 15_000 * BOUND
    assert (each[None, "v"], each["b", "w"], each["a", "w"]) == (50, 1, 1)


def test_overlap_of_splits(stored):
    v = {(r.a, r.b): r for r in overlap_estimates(stored, "split").filter("column = 'v'").collect()}["a", "b"]
    assert abs(v.shared - 5000) <= 30_000 * BOUND
    assert abs(v.only_a - 15_000) <= 30_000 * BOUND and abs(v.only_b - 10_000) <= 30_000 * BOUND
    assert abs(v.jaccard - 1 / 6) <= 2 * BOUND


def test_column_without_values(spark):
    df = spark.createDataFrame([("a", None), ("b", None)], "split string, v string")
    sketches = distinct_sketches(df, ["v"], ["split"])
    assert union_estimates(sketches).first().distinct == 0
    assert overlap_estimates(sketches, "split").first().jaccard == 0.0
    assert distinct_sketches(df.limit(0), ["v"], ["split"]).count() == 0


def test_collation(spark):
    rng = random.Random(1)
    rows = [(i % 7, i, [rng.randrange(1, 99) for _ in range(rng.randrange(0, 9))]) for i in range(100)]
    rows += [(9, 200, None), (9, 201, []), (None, 202, [5])]
    got = {r.batch: r for r in collate(spark.createDataFrame(rows, "b bigint, at int, v array<bigint>"), "b", "at", "v", 6).collect()}
    assert set(got) == {*range(7), 9, None}
    for b, r in got.items():
        own = [(v or [])[:6] for x, _, v in sorted(rows, key=lambda x: x[1]) if x == b]
        width = max(map(len, own))
        assert (r.n, r.width) == (len(own), width)
        assert r.ids == [v + [0] * (width - len(v)) for v in own]
        assert r["mask"] == [[1] * len(v) + [0] * (width - len(v)) for v in own]


def test_collation_of_nothing(spark):
    assert collate(spark.createDataFrame([], "b bigint, at int, v array<bigint>"), "b", "at", "v", 6).count() == 0
