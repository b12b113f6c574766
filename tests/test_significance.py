"""Replicates against plain loops."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tandemlens.functions.digests import md5_of_numbered
from tandemlens.operators import significance

KEYS = ["1", "", None, "abc", "é日", "x" * 49, "x" * 50, "x" * 53, "y" * 54, "z" * 200, "123456789"]
ROWS = [(k, 0.1 * i, None if i == 4 else 1.0 - 0.07 * i * i) for i, k in enumerate(KEYS)]


def digest(key, n):
    return hashlib.md5(f"{'' if key is None else key + ':'}{n}".encode()).digest()


@pytest.mark.parametrize("prefix", [b"", b"7:", b"1234567:", b"p" * 50, b"p" * 51, b"p" * 52, b"p" * 120])
def test_md5_of_numbered(prefix):
    first, second = md5_of_numbered(prefix, 1234)
    want = [hashlib.md5(prefix + str(n).encode()).digest() for n in range(1, 1235)]
    assert [int(a).to_bytes(4, "little") + int(b).to_bytes(4, "little") for a, b in zip(first, second)] == [w[:8] for w in want]


@pytest.fixture
def no_explode(monkeypatch):
    """A row a replicate is what took the time."""
    monkeypatch.setattr(F, "explode", lambda *_: pytest.fail("a row for each replicate"))


def test_randomization(spark, no_explode):
    df = spark.createDataFrame(ROWS, "k string, a double, b double").repartition(3)
    got = significance.randomization_test(df, "k", "a", "b", 300).first()
    diffs = [(k, None if b is None else b - a) for k, a, b in ROWS]
    known = [d for _, d in diffs if d is not None]
    hits = 0
    for n in range(1, 301):
        kept = [d if digest(k, n)[0] >= 128 else 0.0 for k, d in diffs]
        kept = [d for d in kept if d is not None]
        hits += abs(sum(kept) / len(kept)) >= abs(sum(known) / len(known))
    assert got.observed_diff == pytest.approx(sum(known) / len(known))
    assert got.p_value == pytest.approx(hits / 300)


def test_bootstrap(spark, no_explode):
    df = spark.createDataFrame(ROWS, "k string, a double, b double").repartition(3)
    got = significance.bootstrap_interval(df, "k", "b", 100, 0.5)
    means = []
    for n in range(1, 101):
        drawn = [int(digest(k, n).hex()[:13], 16) / 2**52 for k, _, _ in ROWS]
        weights = [sum(u >= s for s in significance.poisson_steps()) for u in drawn]
        total = sum(w * b for w, (_, _, b) in zip(weights, ROWS) if b is not None)
        means.append(total / sum(weights) if sum(weights) else 0.0)
    want = spark.createDataFrame([(m,) for m in means], "m double").agg(F.percentile("m", F.lit(0.25)), F.percentile("m", F.lit(0.75)))
    assert tuple(got.select("lower", "upper").first()) == pytest.approx(tuple(want.first()))
    assert got.first().replicates == 100


def test_no_rows(spark):
    none = spark.createDataFrame([], "k string, a double, b double")
    got = significance.randomization_test(none, "k", "a", "b", 20).first()
    assert (got.observed_diff, got.p_value) == (None, None)
    assert significance.bootstrap_interval(none, "k", "a", 20).first().replicates == 0
