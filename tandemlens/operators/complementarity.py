"""How often two predictors are right together, alone or not at all."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandemlens.operators.binary import decide


def align(predictions: Sequence[tuple[str, DataFrame]], labels: DataFrame, on: str) -> DataFrame:
    """Join the score tables of several models and the labels by example id."""
    frames = [df.select(on, F.col("score").alias(name)) for name, df in predictions]
    return reduce(lambda left, right: left.join(right, on), frames, labels)


def _rate(flag: Column) -> Column:
    return F.avg(flag.cast("double"))


def correct_flags(df: DataFrame, models: Sequence[str], label: str = "label") -> DataFrame:
    """Add a boolean `<model>_ok` per model."""
    return df.select(
        "*", *[(decide(F.col(m)) == F.col(label)).alias(f"{m}_ok") for m in models]
    )


def complementarity(df: DataFrame, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """Accuracies, the four-way split of kg and dense, oracle bound and fusion gaps."""
    kg, dense, fusion = F.col("kg_ok"), F.col("dense_ok"), F.col("fusion_ok")
    rates = correct_flags(df, ["kg", "dense", "fusion"], label).groupBy(*by).agg(
        F.count("*").alias("_n"),
        _rate(kg).alias("kg_accuracy"),
        _rate(dense).alias("dense_accuracy"),
        _rate(fusion).alias("fusion_accuracy"),
        _rate(kg & ~dense).alias("kg_only_correct_rate"),
        _rate(dense & ~kg).alias("dense_only_correct_rate"),
        _rate(kg & dense).alias("both_correct_rate"),
        _rate(~kg & ~dense).alias("both_wrong_rate"),
        _rate(kg != dense).alias("complementarity_score"),
        _rate(kg | dense).alias("oracle_accuracy"),
    )
    best_single = F.greatest("kg_accuracy", "dense_accuracy")
    return rates.where(F.col("_n") > 0).drop("_n").select(
        "*",
        (F.col("fusion_accuracy") - best_single).alias("fusion_improvement"),
        (F.col("oracle_accuracy") - F.col("fusion_accuracy")).alias("fusion_vs_oracle_gap"),
    )


def experiment_summary(
    df: DataFrame, fusions: Sequence[str], by: Sequence[str] = (), label: str = "label"
) -> DataFrame:
    """Agreement, potential improvement and the best and mean of several fusion models."""
    kg, dense = F.col("kg_ok"), F.col("dense_ok")
    rates = correct_flags(df, ["kg", "dense", *fusions], label).groupBy(*by).agg(
        F.count("*").alias("_n"),
        _rate(decide(F.col("kg")) == decide(F.col("dense"))).alias("dense_kg_agreement"),
        _rate(kg != dense).alias("complementarity_ratio"),
        _rate(dense).alias("dense_accuracy"),
        _rate(kg).alias("kg_accuracy"),
        _rate(kg | dense).alias("oracle_accuracy"),
        *[_rate(F.col(f"{m}_ok")).alias(f"_{m}") for m in fusions],
    )
    accuracies = [F.col(f"_{m}") for m in fusions]
    best = F.array_max(F.array(*accuracies))
    best_single = F.greatest("dense_accuracy", "kg_accuracy")
    return rates.where(F.col("_n") > 0).select(
        *by,
        "dense_kg_agreement",
        "complementarity_ratio",
        "dense_accuracy",
        "kg_accuracy",
        "oracle_accuracy",
        (F.col("oracle_accuracy") - best_single).alias("potential_improvement"),
        best.alias("best_fusion_accuracy"),
        (reduce(lambda a, b: a + b, accuracies) / len(accuracies)).alias("avg_fusion_accuracy"),
        (best - best_single).alias("fusion_improvement"),
    )


def correct_sets(df: DataFrame, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """Sizes of the set expressions over the examples two models get right."""
    a, b = F.col("kg_ok"), F.col("dense_ok")
    return correct_flags(df, ["kg", "dense"], label).groupBy(*by).agg(
        F.count_if(a & ~b).alias("kg_minus_dense"),
        F.count_if(b & ~a).alias("dense_minus_kg"),
        F.count_if(a & b).alias("intersection"),
        F.count_if(~a & ~b).alias("neither"),
        F.count_if(a | b).alias("union_size"),
        F.count_if(a != b).alias("symmetric_difference"),
    )
