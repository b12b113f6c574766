"""Binary classification metrics in one aggregation pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandemlens.functions.vectors import ratio
from tandemlens.operators.ordered import running_totals
from tandemlens.session import durable

THRESHOLD = 0.5


def decide(score: Column, threshold: float = THRESHOLD) -> Column:
    """Class 1 strictly above the threshold; a score of exactly 0.5 is class 0."""
    return (score > threshold).cast("int")


def confusion(score: Column, label: Column) -> list[Column]:
    """Aggregate columns n, n_right, tp, fp, fn."""
    pred = decide(score)
    return [
        F.count("*").alias("n"),
        F.count_if(pred == label).alias("n_right"),
        F.count_if((pred == 1) & (label == 1)).alias("tp"),
        F.count_if((pred == 1) & (label == 0)).alias("fp"),
        F.count_if((pred == 0) & (label == 1)).alias("fn"),
    ]


def binary_metrics(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """accuracy, precision, recall, f1; an undefined ratio is 0, empty input gives no row."""
    return metrics_from_counts(df.groupBy(*by).agg(*confusion(F.col(score), F.col(label))), by)


def metrics_from_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.where(F.col("n") > 0).select(
        *by,
        ratio(F.col("n_right"), F.col("n")).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def roc_auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve with tied scores counted half; one class only gives 0."""
    per_score = df.groupBy(*by, score).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    per_score = durable(per_score, "per-score")  # counted first, then ranked
    ranked = running_totals(per_score, by, [F.col(score)], sums={"neg_upto": F.col("neg")})
    below = F.col("neg_upto") - F.col("neg") / 2
    sums = ranked.groupBy(*by).agg(
        F.sum("pos").alias("p"),
        F.sum("neg").alias("q"),
        F.sum(F.col("pos") * below).alias("wins"),
    )
    pairs = F.col("p").cast("double") * F.col("q")
    return sums.where(F.col("p").isNotNull()).select(*by, ratio(F.col("wins"), pairs).alias("auc"))
