"""The complementarity experiment: train several models, align their predictions, compare.

A trainable stand-in (logistic regression on Spark) takes the place of the neural
classifier; the fusion operators feed it their fused vectors.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemlens.functions.vectors import as_double
from tandemlens.operators import complementarity, fusion, graph
from tandemlens.plans.catalog import query, rounded
from tandemlens.plans.neural import HIDDEN
from tandemlens.session import durable
from tandemlens.sources.tables import table

# The three model sizes.
CONFIGS = {
    "lightweight": {
        "hidden": 512,
        "gnn": "gcn",
        "gnn_layers": 2,
        "heads": 8,
        "fusion": "cross_attention",
        "fused": 256,
        "temperature": 0.1,
        "entities": 50_000,
        "relations": 500,
    },
    "standard": {
        "hidden": 768,
        "gnn": "gat",
        "gnn_layers": 3,
        "heads": 12,
        "fusion": "hierarchical_gating",
        "fused": 384,
        "temperature": 0.1,
        "entities": 100_000,
        "relations": 1_000,
    },
    "large": {
        "hidden": 1_024,
        "gnn": "sage",
        "gnn_layers": 4,
        "heads": 16,
        "fusion": "tensor_bilinear",
        "fused": 512,
        "temperature": 0.05,
        "entities": 200_000,
        "relations": 2_000,
    },
}


def config(size: str = "lightweight") -> dict:
    if size not in CONFIGS:
        raise ValueError(f"unknown model size: {size}, expected one of {list(CONFIGS)}")
    return dict(CONFIGS[size])


def train_and_score(rows: DataFrame, vector: str) -> DataFrame:
    """(example_id, score) on the test split, from a model fitted on the training split."""
    ready = rows.select("example_id", "train", "label", array_to_vector(vector).alias("features"))
    fitted = LogisticRegression(maxIter=15, regParam=1e-5, tol=1e-5).fit(ready.where("train"))
    scored = fitted.transform(ready.where("NOT train"))
    return scored.select("example_id", vector_to_array("probability")[1].alias("score"))


def run(rows: DataFrame, kinds: list[str], hidden: int) -> DataFrame:
    """Aligned test scores of the two single models and of every fusion kind.

    `rows` holds (example_id, train, label, kg, dense). Scores are joined by
    example id, so every model is judged on its own rows.
    """
    fused = [
        fusion.fused(k, fusion.pattern_weights(k, hidden))("kg", "dense").alias(k) for k in kinds
    ]
    vectors = durable(rows.select("*", *fused), "experiment")
    scores = [(name, train_and_score(vectors, name)) for name in ["kg", "dense", *kinds]]
    labels = vectors.where("NOT train").select("example_id", F.col("label").cast("int").alias("label"))
    return complementarity.align(scores, labels, "example_id")


@query()
def complementarity_experiment(spark, root):
    """Is the vector's label even? Each hash half of the rows serves as training or test set."""
    vectors = table(spark, root, "embeddings").select(
        F.col("vec_id").alias("example_id"),
        (F.xxhash64("vec_id") >= 0).alias("train"),
        (F.col("label") % 2).cast("double").alias("label"),
        (F.col("vec_id") % 50).alias("node"),
        as_double(F.col("embedding")).alias("dense"),
    )
    # The graph side of a row is its node's neighbourhood: the mean of the training vectors there.
    near = graph.mean_vectors(vectors.where("train"), "node", "dense", HIDDEN).withColumnRenamed("x", "kg")
    rows = graph.attach_embeddings(vectors, near, "node").drop("node")
    kinds = list(fusion.KINDS)
    return rounded(complementarity.experiment_summary(run(rows, kinds, HIDDEN), kinds), 3)


def parameters(size: str) -> int:
    """Trainable values of the fusion operator of a model size."""
    c = config(size)
    return fusion.n_parameters(c["fusion"], c["hidden"], c["fused"])
