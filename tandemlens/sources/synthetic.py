"""Repeatable synthetic examples for smoke tests of the evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EDGES_PER_EXAMPLE = 5  # fixed value: random edges that come with an example


def _uniform(seed: int, name: str) -> Column:
    """Number in [0, 1) that depends on the row id only, not on partitions."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(name), F.col("example_id")), F.lit(2**31)) / float(
        2**31
    )


def examples(
    spark: SparkSession, n: int, entities: int = 100, seed: int = 0
) -> DataFrame:
    """Scores of a dense and a graph model; each decides the label of about half the rows."""
    rows = spark.range(n).withColumnRenamed("id", "example_id")
    scored = rows.select(
        "example_id",
        F.floor(_uniform(seed, "entity") * entities).cast("long").alias("entity_id"),
        (_uniform(seed, "dense") - 0.5).alias("dense_score"),
        (_uniform(seed, "kg") - 0.5).alias("kg_score"),
        (_uniform(seed, "mask") > 0.5).alias("dense_favoured"),
    )
    favoured = F.when(F.col("dense_favoured"), F.col("dense_score")).otherwise(F.col("kg_score"))
    return scored.withColumn("label", (favoured > 0).cast("int"))


def edges(spark: SparkSession, n: int, entities: int = 100, seed: int = 0) -> DataFrame:
    """(example_id, src, dst): a few random edges per example."""
    slots = F.explode(F.sequence(F.lit(1), F.lit(EDGES_PER_EXAMPLE))).alias("slot")
    rows = spark.range(n).select(F.col("id").alias("example_id"), slots)

    def node(name: str) -> Column:
        drawn = F.xxhash64(F.lit(seed), F.lit(name), "example_id", "slot")
        return F.pmod(drawn, F.lit(entities)).cast("long").alias(name)

    return rows.select("example_id", node("src"), node("dst"))
