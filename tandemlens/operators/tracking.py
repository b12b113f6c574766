"""Experiment tracking as relations: metric series, best-so-far, schedules and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandemlens.operators.complementarity import complementarity
from tandemlens.operators.ordered import running_totals

EARLY_STOP_SHARE = 0.95  # fixed value: stop below this share of the previous best
LR_FACTOR = 0.5  # fixed value: learning-rate factor on a plateau
LR_PATIENCE = 3  # fixed value: epochs without improvement that are tolerated
LR_THRESHOLD = 1e-4  # fixed value: relative improvement that counts


def auto_step(log: DataFrame, order: Sequence[Column], step: Column | None = None) -> DataFrame:
    """Step of every logged value: the given one, else how many the metric had before."""
    counted = running_totals(log, ["metric"], order, rank="_seen")
    auto = F.col("_seen") - 1
    return counted.withColumn("step", auto if step is None else F.coalesce(step, auto)).drop("_seen")


def global_step(epoch: Column, batch: Column, batches: Column) -> Column:
    return epoch * batches + batch


def final_and_best(log: DataFrame, order: Column, by: Sequence[str] = ("metric",)) -> DataFrame:
    """Last logged and largest value per metric."""
    return log.groupBy(*by).agg(
        F.max_by("value", order).alias("final"), F.max("value").alias("best")
    )


def best_so_far(epochs: DataFrame, value: str, order: Column) -> DataFrame:
    """Mark every epoch that strictly beats all earlier ones, and carry the best value."""
    seen = running_totals(epochs, ["metric"], [order], prior_max={"_prior": F.col(value)})
    prior = F.col("_prior")
    return seen.select(
        *epochs.columns,
        (prior.isNull() | (F.col(value) > prior)).alias("is_best"),
        F.greatest(F.col(value), prior).alias("best_value"),
    )


def best_epoch(epochs: DataFrame, value: str, epoch: str) -> DataFrame:
    """(metric, best_metric, best_epoch); the earliest epoch wins a tie."""
    top = F.max_by(epoch, F.struct(F.col(value), -F.col(epoch)))
    return epochs.groupBy("metric").agg(
        F.max(value).alias("best_metric"), top.alias("best_epoch")
    )


def early_stop(epochs: DataFrame, value: str, epoch: str) -> DataFrame:
    """Compare each epoch's best value with that of the epoch before.

    The previous epoch is found by an equi-join on epoch + 1, not by a window.
    """
    best = epochs.groupBy(epoch).agg(F.max(value).alias("best"))
    before = best.select((F.col(epoch) + 1).alias(epoch), F.col("best").alias("previous_best"))
    joined = best.join(before, epoch, "left")
    previous = F.coalesce("previous_best", F.lit(0.0))
    return joined.select(
        epoch, "best", "previous_best", (F.col("best") < previous * EARLY_STOP_SHARE).alias("stop")
    )


def plateau_schedule(epochs: DataFrame, value: str, epoch: str, start_lr: float) -> DataFrame:
    """Learning rate after each epoch when it is cut on a plateau (larger is better).

    The rule is a state machine over a metric's epochs, so each metric's epoch
    means (already aggregated: one row per epoch) are folded in order.
    """
    state = F.struct(
        F.lit(None).cast("double").alias("best"),
        F.lit(0).alias("bad"),
        F.lit(float(start_lr)).alias("lr"),
    )
    row_type = "array<struct<epoch:bigint,lr:double>>"

    def advance(acc: Column, row: Column) -> Column:
        last = acc["state"]
        better = last["best"].isNull() | (row["v"] > last["best"] * (1.0 + LR_THRESHOLD))
        bad = F.when(better, F.lit(0)).otherwise(last["bad"] + 1)
        cut = bad > LR_PATIENCE
        lr = F.when(cut, last["lr"] * LR_FACTOR).otherwise(last["lr"])
        new = F.struct(
            F.when(better, row["v"]).otherwise(last["best"]).alias("best"),
            F.when(cut, F.lit(0)).otherwise(bad).alias("bad"),
            lr.alias("lr"),
        )
        seen = F.struct(row["e"].alias("epoch"), lr.alias("lr"))
        return F.struct(new.alias("state"), F.concat(acc["rows"], F.array(seen)).alias("rows"))

    series = epochs.groupBy("metric").agg(
        F.array_sort(
            F.collect_list(F.struct(F.col(epoch).cast("long").alias("e"), F.col(value).alias("v")))
        ).alias("s")
    )
    start = F.struct(state.alias("state"), F.array().cast(row_type).alias("rows"))
    folded = F.aggregate("s", start, advance, lambda acc: acc["rows"])
    return series.select("metric", F.inline(folded))


def merge_config(log: DataFrame) -> DataFrame:
    """Settings logged over time as (key, value, seq) rows; the last value of a key holds."""
    return log.groupBy("key").agg(F.max_by("value", "seq").alias("value"))


def level_counts(log: DataFrame) -> DataFrame:
    """Messages per level; anything but error and warning is info."""
    level = F.lower("level")
    name = F.when(level.isin("error", "warning"), level).otherwise("info")
    return log.groupBy(name.alias("level")).agg(F.count("*").alias("messages"))


def metric_report(log: DataFrame, order: Column) -> DataFrame:
    """Report lines: final and best value per metric with four decimals."""
    both = final_and_best(log, order)
    return both.select(
        "metric",
        F.format_string("%s: Final: %.4f Best: %.4f", "metric", "final", "best").alias("line"),
    )


def evaluation_report(metrics: DataFrame, group: str) -> DataFrame:
    """(group, place, line): a heading for each group, then one line for each of its metrics."""
    names = [c for c in metrics.columns if c != group]
    heading = F.struct(F.lit(0).alias("place"), F.format_string("== %s ==", group).alias("line"))
    lines = [
        F.struct(F.lit(i).alias("place"), F.format_string(f"{name}: %.4f", F.col(name)).alias("line"))
        for i, name in enumerate(names, 1)
    ]
    return metrics.select(group, F.inline(F.array(heading, *lines)))


def log_predictions(df: DataFrame, task: str, step: str) -> DataFrame:
    """Tidy metric rows (metric, step, value) of the complementarity block per task and step."""
    block = complementarity(df, [task, step])
    names = [
        "kg_accuracy",
        "dense_accuracy",
        "fusion_accuracy",
        "complementarity_score",
        "oracle_accuracy",
        "fusion_improvement",
    ]
    tall = block.select(task, step, *names).unpivot([task, step], names, "name", "value")
    return tall.select(F.concat_ws("_", task, "name").alias("metric"), step, "value")


def model_info(name: Column, total: Column, trainable: Column) -> list[Column]:
    """Columns of a model record; four bytes per parameter."""
    return [
        name.alias("model_name"),
        total.alias("total_parameters"),
        trainable.alias("trainable_parameters"),
        (total * 4 / (1024 * 1024)).alias("model_size_mb"),
    ]
