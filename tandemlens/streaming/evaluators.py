"""Streams over file sources: incremental metrics, metric logs and bounded scans.

Checkpoints and results live in the shared scratch folder. Each micro-batch of the
evaluator rewrites its whole (small) count table, so a replayed batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemlens.operators.binary import confusion, metrics_from_counts
from tandemlens.session import scratch_path


def table_stream(
    spark: SparkSession, root: str, name: str, schema: str, files_per_trigger: int = 64
) -> DataFrame:
    """A table's files as a stream, a bounded number per micro-batch; a file or a folder of parts.

    The file source takes a single file only by a pattern, so the name is given as one.
    """
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(f"{root.rstrip('/')}/{name}.parque[t]")
    )


def binary_metrics_stream(
    stream: DataFrame, score: Column, label: Column, by: Sequence[str]
) -> DataFrame:
    """Drain what is available and return the metrics of everything seen so far.

    The state is one row of counts per group, whatever the length of the stream.
    """
    spark = stream.sparkSession
    target = scratch_path(spark, "stream-counts")
    counts = stream.groupBy(*by).agg(*confusion(score, label))
    spark.createDataFrame([], counts.schema).write.parquet(target)  # what an empty stream leaves

    def publish(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(target)

    run = (
        counts.writeStream.outputMode("complete")
        .option("checkpointLocation", scratch_path(spark, "stream-state"))
        .trigger(availableNow=True)
        .foreachBatch(publish)
        .start()
    )
    run.awaitTermination()
    return metrics_from_counts(spark.read.schema(counts.schema).parquet(target), by)


def append_stream(stream: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Append every new row to Parquet exactly once, and return the table so far."""
    spark = stream.sparkSession
    target = scratch_path(spark, name)
    run = (
        stream.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", scratch_path(spark, f"{name}-state"))
        .partitionBy(*partition_by)
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


def metric_stream(events: DataFrame) -> DataFrame:
    """Events as tidy metric rows keyed by their id."""
    return events.select(
        F.col("event_type").alias("metric"), F.col("event_id").alias("step"), "value", "ts"
    )
