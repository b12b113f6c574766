"""Connected components of undirected links, by minimum labels with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemlens.session import durable


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component, for every node with a link.

    `links` has the columns a and b, of one orderable type. In each round a node takes the
    smallest label among its neighbours and then its label's label, so paths shorten by more
    than half. Each round is written to the shared folder. The shortcut looks labels up by a
    key that a large component shares; it is a skewed join against one row per key.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = durable(both.filter("a <> b").distinct(), "links")
    labels = durable(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels"
    )
    while True:
        heard = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("heard"))
        )
        lower = labels.join(heard, "node").select(
            "node", F.col("label").alias("before"), F.least("label", "heard").alias("label")
        )
        lower = durable(lower, "lower")
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = lower.join(jump, "label").select("node", "before", F.least("label", "next").alias("label"))
        after = durable(after, "labels")
        labels = after.select("node", "label")
        if after.filter(F.col("before") != F.col("label")).isEmpty():
            return labels
