"""Distinct counts from stored sketches that merge: one pass a split, any union or overlap of splits later.

A sketch of a split is a few kilobytes whatever its rows, is written once and read instead of the rows. HyperLogLog
sketches give counts of unions; theta sketches also those of overlaps and differences, at a larger size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandemlens.session import durable

#: Binary logarithm of a sketch's size: the standard error is about 1.04 / sqrt(2^12), 1.6 % (theta: 1.6 %).
LOG_SIZE = 12
#: Errors beyond three standard errors are to be expected in one of 370 estimates.
BOUND = 3 * 1.04 / 2 ** (LOG_SIZE / 2)


def distinct_sketches(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by, column, rows, hll, theta): sketches of each column's values in each split, written to the shared folder.

    Values are compared as text, nulls do not count; a column without values has empty sketches. A split whose
    key is null is one like any other.
    """
    tall = df.select(*by, F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])))
    value = F.col("v")
    return durable(
        tall.groupBy(*by, "column").agg(
            F.count(value).alias("rows"),
            F.hll_sketch_agg(value, LOG_SIZE).alias("hll"),
            F.theta_sketch_agg(value, LOG_SIZE).alias("theta"),
        ),
        "sketches",
    )


def union_estimates(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, column, distinct): estimated distinct values over all splits of each group, from sketches alone."""
    return sketches.groupBy(*by, "column").agg(F.hll_sketch_estimate(F.hll_union_agg("hll")).alias("distinct"))


def overlap_estimates(sketches: DataFrame, split: str) -> DataFrame:
    """(column, a, b, shared, only_a, only_b, jaccard): estimates for every two splits a < b of each column.

    Splits are few (a name each); their sketches are joined, never their rows.
    """
    one = sketches.select("column", F.col(split).alias("a"), F.col("theta").alias("x"))
    other = sketches.select("column", F.col(split).alias("b"), F.col("theta").alias("y"))
    size = lambda sketch: F.theta_sketch_estimate(sketch)
    pairs = one.join(other, "column").filter("a < b").select(
        "column",
        "a",
        "b",
        size(F.theta_intersection("x", "y")).alias("shared"),
        size(F.theta_difference("x", "y")).alias("only_a"),
        size(F.theta_difference("y", "x")).alias("only_b"),
        size(F.theta_union("x", "y")).alias("either"),
    )
    jaccard = F.when(F.col("either") > 0, F.col("shared") / F.col("either")).otherwise(F.lit(0.0))
    return pairs.withColumn("jaccard", jaccard).drop("either")


def within(estimate: Column, exact: Column, scale: Column | None = None) -> Column:
    """Whether an estimate is as near as its size promises; the error of an overlap is relative to `scale`, the union."""
    return F.abs(estimate - exact) <= F.ceil((exact if scale is None else scale) * BOUND)
