"""Streaming queries over the given tables as file sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandemlens.plans.catalog import query, rnd, rounded
from tandemlens.sources.schemas import EVENTS
from tandemlens.streaming import evaluators


@query(
    """
WITH s AS (SELECT event_type, least(value / 100e0, 1e0) > 0.5 AS pred, user_id % 2 = 1 AS label
  FROM events),
c AS (SELECT event_type, avg((pred = label)::int) AS a, count(*) FILTER (pred AND label) AS tp,
    count(*) FILTER (pred AND NOT label) AS fp, count(*) FILTER (NOT pred AND label) AS fn
  FROM s GROUP BY event_type)
SELECT event_type, round(a, 6) AS accuracy,
  round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1
FROM c"""
)
def streaming_binary_metrics(spark, root):
    stream = evaluators.table_stream(spark, root, "events", EVENTS)
    score = F.least(F.col("value") / 100.0, F.lit(1.0))
    label = (F.col("user_id") % 2).cast("int")
    return rounded(evaluators.binary_metrics_stream(stream, score, label, ["event_type"]))


@query(
    """
SELECT event_type AS metric, count(*) AS n, max(event_id) AS last_step,
  round(avg(value), 6) AS mean_value FROM events GROUP BY event_type"""
)
def streaming_metric_log(spark, root):
    stream = evaluators.table_stream(spark, root, "events", EVENTS)
    log = evaluators.append_stream(evaluators.metric_stream(stream), "metric-log", "metric")
    return log.groupBy("metric").agg(
        F.count("*").alias("n"),
        F.max("step").alias("last_step"),
        rnd(F.avg("value")).alias("mean_value"),
    )


@query(
    """
SELECT lang, count(*) AS n, cast(sum(length(text)) AS bigint) AS chars FROM documents
GROUP BY lang"""
)
def streaming_document_scan(spark, root):
    """Bounded-memory pass over a table, file by file."""
    schema = "doc_id BIGINT, text STRING, lang STRING"
    stream = evaluators.table_stream(spark, root, "documents", schema, files_per_trigger=1)
    back = evaluators.append_stream(stream, "documents", "lang")
    return back.groupBy("lang").agg(
        F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")
    )
