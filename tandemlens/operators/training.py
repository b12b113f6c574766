"""Mini-batch training of a fusion head: logistic in both vectors and their product, by AdamW with clipped gradients.

Rows are dealt to batches by a hash of their key and written once, so a batch is the same rows on every run and after
any lost executor. A step is one job: tasks sum the gradients of their rows, Spark adds those up by position, and only
as many numbers as the model has come to the driver. After each epoch the state is written; a run that finds one goes on
from there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemlens.functions.vectors import as_double, dot, sigmoid
from tandemlens.session import durable

# Settings of the optimiser.
WEIGHT_DECAY = 1e-5
MAX_NORM = 1.0
BETAS = (0.9, 0.999)
EPS = 1e-8


@dataclass(frozen=True)
class State:
    """Weights (bias last), both moments, and how many steps and epochs they have seen."""

    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray
    step: int = 0
    epoch: int = 0

    @classmethod
    def zero(cls, size: int) -> State:
        return cls(*np.zeros((3, size)))


def fusion_features(kg: Column, dense: Column) -> Column:
    """Both vectors side by side, and their product coordinate by coordinate."""
    return F.concat(as_double(kg), as_double(dense), F.zip_with(as_double(kg), as_double(dense), lambda a, b: a * b))


def adamw(state: State, gradient: np.ndarray, rate: float) -> State:
    """One step: the gradient's norm is cut to MAX_NORM, the decay acts on the weights directly."""
    size = np.linalg.norm(gradient)
    gradient = gradient * min(1.0, MAX_NORM / (size + 1e-6))
    step, (b1, b2) = state.step + 1, BETAS
    first = b1 * state.first + (1 - b1) * gradient
    second = b2 * state.second + (1 - b2) * gradient**2
    move = (first / (1 - b1**step)) / (np.sqrt(second / (1 - b2**step)) + EPS)
    weights = state.weights * (1 - rate * WEIGHT_DECAY) - rate * move
    return replace(state, weights=weights, first=first, second=second, step=step)


def gradient(rows: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, float, int]:
    """Mean gradient and loss over `rows` (features, label), and their number."""
    held = rows.sparkSession.sparkContext.broadcast(weights)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        total = np.zeros(len(w) + 2)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            y = batch.column(1).to_numpy()
            logit = x @ w[:-1] + w[-1]
            off = 1 / (1 + np.exp(-np.clip(logit, -500, 500))) - y
            total[:-3] += x.T @ off
            total[-3:] += off.sum(), np.sum(np.logaddexp(0, logit) - y * logit), len(y)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["pos", "value"])

    parts = rows.select("features", "label").mapInArrow(sums, "pos int, value double")
    added = parts.groupBy("pos").agg(F.sum("value").alias("value")).collect()  # a number for each weight, and two more
    held.destroy()
    total = np.zeros(len(weights) + 2)
    for row in added:
        total[row["pos"]] = row["value"]
    n = max(int(total[-1]), 1)
    return total[:-2] / n, float(total[-2]) / n, int(total[-1])


def saved(spark: SparkSession, path: str) -> State | None:
    """The state of the last whole epoch written below `path`, if there is one."""
    try:
        last = spark.read.parquet(path).orderBy(F.desc("epoch")).limit(1).collect()
    except AnalysisException:  # nothing there yet
        return None
    if not last:
        return None
    row = last[0]
    return State(*(np.array(row[c]) for c in ("weights", "first", "second")), row["step"], row["epoch"])


def save(spark: SparkSession, path: str, state: State) -> None:
    row = (*(v.tolist() for v in (state.weights, state.first, state.second)), state.step, state.epoch)
    schema = "weights array<double>, first array<double>, second array<double>, step int, epoch int"
    spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(path)


def train(
    rows: DataFrame, key: str, epochs: int, batches: int, rate: float, path: str | None = None
) -> tuple[State, list[float]]:
    """The state after `epochs` epochs over `rows` (key, features, label), and the mean loss of each epoch run.

    Rows without features or label are left out; features have one length. An empty table leaves the zero state.
    With a `path`, epochs whose state is found there are not run again.
    """
    spark = rows.sparkSession
    dealt = rows.filter("features IS NOT NULL AND label IS NOT NULL").select(
        F.pmod(F.xxhash64(key), F.lit(batches)).cast("int").alias("batch"), "features", F.col("label").cast("double").alias("label")
    )
    dealt = durable(dealt, "training-rows")
    size = dealt.agg(F.max(F.size("features")).alias("n")).first()["n"]
    state = (saved(spark, path) if path else None) or State.zero((size or 0) + 1)
    losses = []
    while state.epoch < epochs and size:
        lost, seen = 0.0, 0
        for batch in range(batches):
            mean, loss, n = gradient(dealt.filter(F.col("batch") == batch), state.weights)
            if n:
                state, lost, seen = adamw(state, mean, rate), lost + loss * n, seen + n
        state = replace(state, epoch=state.epoch + 1)
        losses.append(lost / max(seen, 1))
        if path:
            save(spark, path, state)
    return state, losses


def scored(features: Column, state: State) -> Column:
    """Probability of a positive label."""
    weights = F.lit(state.weights[:-1].tolist()).cast("array<double>")
    return sigmoid(dot(features, weights) + float(state.weights[-1]))
