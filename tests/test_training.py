"""Training of the fusion head against numpy, and runs that are taken up again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandemlens.operators import fusion, training
from tandemlens.operators.training import State, adamw, gradient, saved, scored, train


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((400, 5))
    return x, (x @ [2.0, -1, 0, 0.5, 0] + 0.3 + 0.3 * rng.standard_normal(400) > 0).astype(float)


@pytest.fixture(scope="module")
def rows(spark, data):
    made = [(i, [float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(*data))]
    made += [(900, None, 1.0), (901, [1.0] * 5, None)]
    return spark.createDataFrame(made, "k bigint, features array<double>, label double").repartition(6)


def test_gradient_equals_numpy(rows, data):
    x, y = data
    w = np.array([0.5, -0.2, 0.1, 0, 3, -1])
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    mean, loss, n = gradient(rows.filter("k < 900"), w)
    assert n == 400 and mean == pytest.approx(np.append(x.T @ (p - y), (p - y).sum()) / 400, abs=1e-12)
    assert loss == pytest.approx(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)), abs=1e-9)


def test_optimiser_by_hand():
    state = adamw(State(np.array([1.0]), np.zeros(1), np.zeros(1)), np.array([30.0]), 0.1)
    assert state.first[0] == pytest.approx(0.1, rel=1e-6)  # the gradient's norm was cut to 1
    assert state.weights[0] == pytest.approx(1.0 * (1 - 0.1 * 1e-5) - 0.1, rel=1e-6)


def test_it_learns_and_a_run_is_taken_up_again(spark, rows, data, tmp_path):
    whole, losses = train(rows, "k", epochs=4, batches=3, rate=0.1)
    assert losses[0] > losses[-1] and whole.step == 12
    path = f"file://{tmp_path}/state"
    first, _ = train(rows, "k", epochs=2, batches=3, rate=0.1, path=path)
    assert saved(spark, path).epoch == first.epoch == 2
    again, more = train(rows, "k", epochs=4, batches=3, rate=0.1, path=path)
    assert len(more) == 2 and again.weights == pytest.approx(whole.weights, abs=1e-9)
    done, none = train(rows, "k", epochs=4, batches=3, rate=0.1, path=path)
    assert none == [] and done.weights.tolist() == again.weights.tolist()
    hits = rows.filter("k < 900").select(((scored(F.col("features"), whole) > 0.5) == (F.col("label") > 0.5)).alias("ok"))
    assert hits.filter("ok").count() > 340


def test_nothing_to_learn_from(rows):
    state, losses = train(rows.limit(0), "k", epochs=2, batches=2, rate=0.1)
    assert state.weights.tolist() == [0.0] and losses == []


def test_weights_that_are_too_large_are_refused(spark, monkeypatch):
    monkeypatch.setattr(fusion, "MOST_BYTES", 1000)
    with pytest.raises(ValueError, match="bytes of weights"):
        fusion.fused("tensor_bilinear", fusion.pattern_weights("tensor_bilinear", 16))
