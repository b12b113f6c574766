"""The provided Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def spread(df: DataFrame) -> DataFrame:
    """Rows of an input with fewer splits than cores (one row group, one gzip file) dealt out.

    For CPU-heavy work on text. An input with enough splits stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}, expected one of {TABLES}")
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")
