"""Measures between vector spaces against numpy on all rows at once."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandemlens.operators import representation
from tandemlens.operators.representation import cross_predictability, moments, mutual_information, representation_report

SCHEMA = "g string, i int, x array<double>, y array<double>"


def made(n=300, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 6)) * [1, 50, 0.01, 3, 1, 1]
    y = x[:, :4] @ rng.standard_normal((4, 3)) + 5 * rng.standard_normal((n, 3)) + 1000
    return x, y


def frame(spark, x, y, groups="ab"):
    rows = [(groups[i % len(groups)], i, [float(v) for v in a], [float(v) for v in b]) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, SCHEMA).repartition(7)


def cka_of(x, y):
    """By the similarity matrices of all pairs of rows."""
    h = np.eye(len(x)) - 1 / len(x)
    k, m = h @ x @ x.T @ h, h @ y @ y.T @ h
    return np.sum(k * m) / math.sqrt(np.sum(k * k) * np.sum(m * m))


def cca_of(x, y):
    """By orthonormal bases of the centred columns."""
    q, r = (np.linalg.qr(v - v.mean(axis=0))[0] for v in (x, y))
    return np.linalg.svd(q.T @ r, compute_uv=False)


@pytest.mark.parametrize("fan_in", [64, 2])
def test_report_equals_numpy(spark, monkeypatch, fan_in):
    monkeypatch.setattr(representation, "FAN_IN", fan_in)
    x, y = made()
    found = {r.g: r for r in representation_report(frame(spark, x, y), "x", "y", ["g"]).collect()}
    for start, g in enumerate("ab"):
        a, b = x[start::2], y[start::2]
        assert found[g].n == 150
        assert found[g].cka == pytest.approx(cka_of(a, b), abs=1e-9)
        assert found[g].canonical_correlations == pytest.approx(cca_of(a, b).tolist(), abs=1e-8)
        values = np.linalg.eigvalsh(np.cov(np.hstack([a, b]).T))
        assert found[g].effective_rank == pytest.approx(values.sum() ** 2 / (values**2).sum(), rel=1e-9)


def test_singular_spaces_have_as_many_correlations_as_their_rank(spark):
    x, y = made()
    wide = np.hstack([x, x[:, :2] * 3, np.ones((len(x), 1))])  # two copies and a constant
    both = representation_report(frame(spark, wide, y), "x", "y").first()
    assert both.canonical_correlations == pytest.approx(cca_of(x, y).tolist(), abs=1e-6)
    still = representation_report(frame(spark, np.ones((9, 2)), y[:9]), "x", "y").first()
    assert (still.cka, still.canonical_correlations) == (None, [])


def test_nulls_and_bad_components_are_left_out(spark):
    x, y = made(40)
    rows = [(None if i % 2 else "a", i, list(map(float, a)), list(map(float, b))) for i, (a, b) in enumerate(zip(x, y))]
    bad = [("a", 1, None, [1.0] * 3), ("a", 2, [1.0] * 6, [math.nan] * 3), (None, 3, [None] * 6, [1.0] * 3)]
    bad += [("a", 4, [math.inf] * 6, [1.0] * 3)]
    found = {r.g: r for r in representation_report(spark.createDataFrame(rows + bad, SCHEMA), "x", "y", ["g"]).collect()}
    assert found["a"].n == found[None].n == 20
    assert found[None].cka == pytest.approx(cka_of(x[1::2], y[1::2]), abs=1e-9)
    assert representation_report(spark.createDataFrame([], SCHEMA), "x", "y", ["g"]).count() == 0


def test_other_lengths_fail(spark):
    rows = [("a", 1, [1.0, 2.0], [1.0]), ("a", 2, [1.0], [1.0])]
    with pytest.raises(Exception, match="different lengths"):
        moments(spark.createDataFrame(rows, SCHEMA), "x", "y")


def test_means_far_from_zero_keep_their_digits(spark):
    x, y = made()
    near = representation_report(frame(spark, x, y), "x", "y").first()
    far = representation_report(frame(spark, x + 1e7, y - 1e8), "x", "y").first()
    assert far.cka == pytest.approx(near.cka, abs=1e-6)


def test_ridge_equals_fit_on_all_rows(spark):
    x, y = made()
    row = cross_predictability(frame(spark, x, y), "x", "y", F.col("i") % 3 == 0, penalty=2.0).first()
    held = np.arange(len(x)) % 3 == 0
    assert (row.n_train, row.n_test) == ((~held).sum(), held.sum())
    for one, other, name in ((x, y, "x_to_y"), (y, x, "y_to_x")):
        a, b = one[~held], other[~held]
        c = a - a.mean(axis=0)
        w = np.linalg.solve(c.T @ c + 2.0 * np.eye(c.shape[1]), c.T @ (b - b.mean(axis=0)))
        guess = b.mean(axis=0) + (one[held] - a.mean(axis=0)) @ w
        rest = other[held] - other[held].mean(axis=0)
        assert row[name] == pytest.approx(1 - ((other[held] - guess) ** 2).sum() / (rest**2).sum(), abs=1e-8)


def test_ridge_without_a_fold_is_null(spark):
    x, y = made(20)
    row = cross_predictability(frame(spark, x, y, "a"), "x", "y", F.lit(None).cast("boolean"), ["g"]).first()
    assert tuple(row) == ("a", 20, 0, None, None)


def information(pairs, bins=8):
    """From equal-frequency bins and joint counts, entropy by entropy."""
    n, bin_of = len(pairs), []
    for side in zip(*pairs):
        order = sorted(side)
        edges = [order[math.ceil(n * i / bins) - 1] for i in range(1, bins)]
        bin_of.append([sum(e < v for e in edges) for v in side])
    count = lambda keys: np.unique(np.array(keys), axis=0, return_counts=True)[1]
    h = lambda c: -sum(p * math.log(p) for p in c / n)
    one, other, both = count(bin_of[0]), count(bin_of[1]), count(list(zip(*bin_of)))
    mutual = h(one) + h(other) - h(both)
    return len(both), mutual, mutual - (len(both) - len(one) - len(other) + 1) / (2 * n)


def test_information_with_hot_values_and_gaps(spark):
    rng = np.random.default_rng(4)
    a = rng.standard_normal(500)
    pairs = [(float(v), float(v + rng.standard_normal())) for v in a]
    hot = [(0.0 if i % 3 else p[0], 7.0 if i % 2 else p[1]) for i, p in enumerate(pairs)]
    rows = [("plain", *p) for p in pairs] + [("hot", *p) for p in hot] + [(None, *p) for p in pairs[:100]]
    rows += [("plain", None, 1.0), ("hot", 1.0, math.nan), ("one", 3.0, 4.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(5)
    found = {r.g: (r.n, r.cells, r.mutual_information, r.corrected) for r in mutual_information(df, "x", "y", ["g"]).collect()}
    for g, want in (("plain", pairs), ("hot", hot), (None, pairs[:100])):
        assert found[g] == pytest.approx((len(want), *information(want)), abs=1e-9)
    assert found["one"] == (1, 1, 0.0, 0.0)
    alone = mutual_information(df.filter("g = 'hot'"), "x", "y", bins=5).first()
    assert tuple(alone)[1:] == pytest.approx(information(hot, 5), abs=1e-9)
    assert mutual_information(df.limit(0), "x", "y", ["g"]).count() == 0
