"""Fusion operators on Spark against one-row numpy, the loss and the stream evaluator."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandemlens.operators import fusion
from tandemlens.plans import experiment
from tandemlens.streaming import evaluators

H = 6


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=H).tolist(), rng.normal(size=H).tolist()) for i in range(40)]
    return rows, spark.createDataFrame(rows, "id int, kg array<double>, dense array<double>")


@pytest.mark.parametrize("kind", sorted(fusion.KINDS))
def test_batches_do_not_change_a_row(pairs, kind):
    rows, df = pairs
    weights = fusion.pattern_weights(kind, H)
    got = {r.id: r.f for r in df.repartition(3).select("id", fusion.fused(kind, weights)("kg", "dense").alias("f")).collect()}
    for i, kg, dense in rows:
        one = fusion.KINDS[kind](np.array([kg]), np.array([dense]), weights)[0]
        assert got[i] == pytest.approx(one.tolist())


def test_bilinear_step_size_does_not_matter():
    rng = np.random.default_rng(1)
    kg, dense = rng.normal(size=(9, H)), rng.normal(size=(9, H))
    layer = fusion.pattern_weights("tensor_bilinear", H)["bilinear"]
    want = np.einsum("ni,kij,nj->nk", kg, layer.w.reshape(-1, H, H), dense) + layer.b
    assert np.allclose(fusion._bilinear(kg, dense, layer), want)
    assert np.allclose(fusion._bilinear(kg, dense, layer, cells=100), want)


def test_equal_gates_halve_both_sides():
    weights = fusion.pattern_weights("hierarchical_gating", H)
    zero = {k: fusion.Layer(np.zeros_like(v.w), np.zeros_like(v.b)) for k, v in weights.items()}
    eye = np.hstack([np.eye(H), np.eye(H)])
    zero["fuse1"] = fusion.Layer(eye, np.zeros(H))
    zero["fuse2"] = fusion.Layer(np.eye(H), np.zeros(H))
    out = fusion.hierarchical_gating(np.full((1, H), 2.0), np.full((1, H), 4.0), zero)
    assert out[0].tolist() == pytest.approx([3.0] * H)


def test_loss_of_a_single_pair_is_zero(spark):
    df = spark.createDataFrame([(0, [1.0] * H, [2.0] * H)], "batch long, kg array<double>, dense array<double>")
    loss = fusion.info_nce(df, fusion.pattern_weights("contrastive", H)).first().loss
    assert loss == pytest.approx(0.0)


def test_configs_and_parameter_counts():
    assert experiment.config("large")["fused"] == 512
    assert fusion.n_parameters("qa_head", 4) == 4 * 5 + 5
    assert experiment.parameters("standard") > experiment.parameters("lightweight") > 0
    with pytest.raises(ValueError):
        experiment.config("huge")
    with pytest.raises(ValueError):
        fusion.shapes("unknown", 4)


def test_stream_over_several_files_equals_the_batch(spark, tmp_path):
    schema = "g string, s double, y int"
    df = spark.range(1000).select(
        F.concat(F.lit("g"), F.col("id") % 3).alias("g"),
        ((F.col("id") * 7 % 100) / 100.0).alias("s"),
        (F.col("id") % 2).cast("int").alias("y"),
    )
    df.repartition(5).write.parquet(str(tmp_path / "in" / "part.parquet"))
    stream = evaluators.table_stream(spark, str(tmp_path / "in"), "part", schema, files_per_trigger=1)
    got = evaluators.binary_metrics_stream(stream, F.col("s"), F.col("y"), ["g"]).collect()
    from tandemlens.operators.binary import binary_metrics

    assert {tuple(r) for r in got} == {tuple(r) for r in binary_metrics(df, "s", "y", ["g"]).collect()}


def test_fused_vectors_stay_in_arrow(spark):
    from pyspark.util import PythonEvalType

    apply = fusion.fused("cross_attention", fusion.pattern_weights("cross_attention", 4))
    assert apply.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF
