"""Writers: JSON, JSON lines per split, numbered batches, Parquet and text reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemlens.operators.limits import batches


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def json_lines_per_split(df: DataFrame, path: str, split: str = "split") -> None:
    """One folder of JSON lines per split, so that a read of one split touches only its files."""
    df.write.mode("overwrite").partitionBy(split).json(path)


def parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def numbered_batches(df: DataFrame, path: str, size: int, order: str, parts: int | None = None) -> None:
    """Batches of exactly `size` rows in order, one file each, with the batch's number in every row.

    Ranges of whole batches are dealt to tasks, and a task begins a new file after `size` rows, so there are as many
    files as batches in one folder. Spark commits a task's files together: one that fails leaves none.
    """
    numbered = batches(df, size, [F.col(order)])
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = numbered.repartitionByRange(parts, "batch").sortWithinPartitions("batch", "place").drop("place")
    rows.write.mode("overwrite").option("maxRecordsPerFile", size).json(path)


def summary_document(df: DataFrame, path: str, **fields) -> None:
    """Counts per split and in total as one JSON document."""
    splits = df.groupBy("split").agg(F.count("*").alias("n"))
    # One row per split reaches the aggregate, so the map stays small.
    document = splits.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", "n")))).alias("splits"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_examples"),
    )
    extra = [F.lit(v).alias(k) for k, v in fields.items()]
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("processing_date")
    document.select(*extra, "*", stamp).coalesce(1).write.mode("overwrite").json(path)


def report(lines: DataFrame, path: str, order: str) -> None:
    """Text report from (order, line) rows."""
    lines.orderBy(order).select("line").coalesce(1).write.mode("overwrite").text(path)


def save_model(model, folder: str, epoch: int, is_best: bool) -> None:
    """Checkpoint of a fitted model, and the copy under `best_model` when it is the best so far."""
    model.write().overwrite().save(f"{folder}/checkpoint_epoch_{epoch}")
    if is_best:
        model.write().overwrite().save(f"{folder}/best_model")


def metric_append(df: DataFrame, path: str) -> None:
    """Tidy metric rows, appended."""
    df.write.mode("append").partitionBy("metric").parquet(path)
