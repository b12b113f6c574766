"""Metric-series queries over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandemlens.operators import tracking
from tandemlens.operators.ordered import running_totals
from tandemlens.plans.catalog import query, rnd, rounded
from tandemlens.plans.inputs import (
    EPOCHS_SQL,
    METRICS_SQL,
    PREDICTIONS_SQL,
    epoch_means,
    metric_log,
    predictions,
)

BY_TIME_SQL = "PARTITION BY metric ORDER BY ts, event_id"


@query(
    f"""
SELECT metric, round(max_by(value, {{'t': ts, 'e': event_id}}) + 0e0, 6) AS final, round(max(value), 6) AS best
FROM {METRICS_SQL} GROUP BY metric"""
)
def best_final_metric(spark, root):
    return rounded(tracking.final_and_best(metric_log(spark, root), F.struct("ts", "event_id")))


@query(
    f"""
SELECT metric, event_id, row_number() OVER ({BY_TIME_SQL}) - 1 AS step FROM {METRICS_SQL}"""
)
def auto_step(spark, root):
    log = metric_log(spark, root).select("metric", "event_id", "ts")
    stepped = tracking.auto_step(log, [F.col("ts"), F.col("event_id")])
    return stepped.select("metric", "event_id", "step")


@query(
    f"""
SELECT metric, epoch, round(mean_value, 6) AS mean_value,
  coalesce(mean_value > max(mean_value) OVER (PARTITION BY metric ORDER BY epoch
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best,
  round(max(mean_value) OVER (PARTITION BY metric ORDER BY epoch), 6) AS best_value
FROM {EPOCHS_SQL}"""
)
def best_so_far(spark, root):
    marked = tracking.best_so_far(epoch_means(spark, root), "mean_value", F.col("epoch"))
    return rounded(marked.drop("batches"))


@query(
    f"""
SELECT metric, event_id, coalesce(value > max(value) OVER ({BY_TIME_SQL}
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best FROM {METRICS_SQL}"""
)
def best_value_marks(spark, root):
    """The same over every single logged value; the series are as long as the table."""
    log = metric_log(spark, root).select("metric", "event_id", "value", "ts")
    seen = running_totals(
        log, ["metric"], [F.col("ts"), F.col("event_id")], prior_max={"prior": F.col("value")}
    )
    is_best = F.col("prior").isNull() | (F.col("value") > F.col("prior"))
    return seen.select("metric", "event_id", is_best.alias("is_best"))


@query(
    f"""
SELECT metric, round(max(mean_value), 6) AS best_metric, min(epoch) FILTER (mean_value = top)
  AS best_epoch
FROM (SELECT *, max(mean_value) OVER (PARTITION BY metric) AS top FROM {EPOCHS_SQL})
GROUP BY metric"""
)
def best_epoch(spark, root):
    return rounded(tracking.best_epoch(epoch_means(spark, root), "mean_value", "epoch"))


@query(
    f"""
WITH b AS (SELECT epoch, max(mean_value) AS best FROM {EPOCHS_SQL} GROUP BY epoch),
l AS (SELECT *, lag(best) OVER (ORDER BY epoch) AS previous_best FROM b)
SELECT epoch, round(best, 6) AS best, round(previous_best, 6) AS previous_best,
  best < coalesce(previous_best, 0) * 0.95 AS stop FROM l"""
)
def early_stop_lag(spark, root):
    return rounded(tracking.early_stop(epoch_means(spark, root), "mean_value", "epoch"))


@query(
    f"""
WITH RECURSIVE m AS (SELECT metric, epoch, mean_value AS v,
    row_number() OVER (PARTITION BY metric ORDER BY epoch) AS n FROM {EPOCHS_SQL}),
s AS (
  SELECT metric, epoch, n, v AS best, 0 AS bad, 0.001e0 AS lr FROM m WHERE n = 1
  UNION ALL
  SELECT m.metric, m.epoch, m.n, CASE WHEN m.v > s.best * (1e0 + 1e-4) THEN m.v ELSE s.best END,
    CASE WHEN m.v > s.best * (1e0 + 1e-4) OR s.bad + 1 > 3 THEN 0 ELSE s.bad + 1 END,
    CASE WHEN m.v <= s.best * (1e0 + 1e-4) AND s.bad + 1 > 3 THEN s.lr * 0.5e0 ELSE s.lr END
  FROM s JOIN m ON m.metric = s.metric AND m.n = s.n + 1)
SELECT metric, epoch, round(lr, 12) AS lr FROM s"""
)
def lr_plateau(spark, root):
    schedule = tracking.plateau_schedule(epoch_means(spark, root), "mean_value", "epoch", 0.001)
    return rounded(schedule, 12)


@query(f"SELECT metric, epoch, batches, round(mean_value, 6) AS mean_value FROM {EPOCHS_SQL}")
def train_epoch_means(spark, root):
    return rounded(epoch_means(spark, root))


@query(
    f"""
WITH b AS (SELECT metric, event_id, date_diff('day', DATE '2024-01-01', cast(ts AS date)) AS epoch,
    row_number() OVER (PARTITION BY metric, cast(ts AS date) ORDER BY ts, event_id) - 1 AS batch
  FROM {METRICS_SQL}),
n AS (SELECT max(batch) + 1 AS batches FROM b)
SELECT metric, event_id, epoch * batches + batch AS global_step FROM b, n"""
)
def global_step(spark, root):
    """epoch * batches per epoch + batch, with the longest epoch as the epoch length."""
    epoch = F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long")
    log = metric_log(spark, root).select("metric", "event_id", "ts", epoch.alias("epoch"))
    placed = running_totals(log, ["metric", "epoch"], [F.col("ts"), F.col("event_id")])
    sizes = log.groupBy("metric", "epoch").agg(F.count("*").alias("n"))
    batches = sizes.agg(F.max("n").alias("batches")).scalar()
    step = tracking.global_step(F.col("epoch"), F.col("rank") - 1, batches)
    return placed.select("metric", "event_id", step.alias("global_step"))


@query(
    f"""
SELECT CASE WHEN lower(level) IN ('error', 'warning') THEN lower(level) ELSE 'info' END AS level,
  count(*) AS messages FROM {METRICS_SQL} GROUP BY 1"""
)
def log_levels(spark, root):
    return tracking.level_counts(metric_log(spark, root))


@query(
    f"""
SELECT metric, format('{{}}: Final: {{:.4f}} Best: {{:.4f}}', metric, max_by(value, {{'t': ts, 'e': event_id}}),
  max(value)) AS line FROM {METRICS_SQL} GROUP BY metric"""
)
def metric_report(spark, root):
    return tracking.metric_report(metric_log(spark, root), F.struct("ts", "event_id"))


@query(
    f"""
WITH p AS (SELECT task, step, (kg > 0.5) = (label = 1) AS k, (dense > 0.5) = (label = 1) AS d,
    (fusion > 0.5) = (label = 1) AS f FROM {PREDICTIONS_SQL}),
b AS (SELECT task, step, avg(k::int) AS kg, avg(d::int) AS de, avg(f::int) AS fu,
    avg((k <> d)::int) AS c, avg((k OR d)::int) AS o FROM p GROUP BY ALL)
SELECT task || '_kg_accuracy' AS metric, step, round(kg, 6) AS value FROM b
UNION ALL SELECT task || '_dense_accuracy', step, round(de, 6) FROM b
UNION ALL SELECT task || '_fusion_accuracy', step, round(fu, 6) FROM b
UNION ALL SELECT task || '_complementarity_score', step, round(c, 6) FROM b
UNION ALL SELECT task || '_oracle_accuracy', step, round(o, 6) FROM b
UNION ALL SELECT task || '_fusion_improvement', step, round(fu - greatest(kg, de), 6) FROM b"""
)
def prediction_log(spark, root):
    return rounded(tracking.log_predictions(predictions(spark, root), "task", "step"))


@query(
    f"""
SELECT metric, round(count(*) / (epoch(max(ts)) - epoch(min(ts))) * 3600, 6) AS per_hour,
  round((epoch(max(ts)) - epoch(min(ts))) / 60, 6) AS minutes FROM {METRICS_SQL} GROUP BY metric"""
)
def throughput(spark, root):
    """Logged values per hour and the length of the series in minutes."""
    ends = metric_log(spark, root).groupBy("metric").agg(
        F.count("*").alias("n"), (F.max("ts") - F.min("ts")).alias("span")
    )
    seconds = F.expr("cast(cast(span AS INTERVAL SECOND) AS DECIMAL(20, 6))").cast("double")
    return ends.select(
        "metric",
        rnd(F.col("n") / seconds * 3600).alias("per_hour"),
        rnd(seconds / 60).alias("minutes"),
    )
