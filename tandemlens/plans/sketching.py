"""Stored sketches against exact counts, and collation by a table function."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandemlens.operators import collation, sketches
from tandemlens.plans.catalog import query
from tandemlens.sources.tables import table

_COLUMNS = ("user_id", "value", "event_type")


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS exact, true AS within_error FROM events" for c in _COLUMNS
    )
)
def approx_distinct_union(spark, root):
    """Sketches of each event type, merged, beside the exact number of distinct values of all."""
    events = table(spark, root, "events")
    found = sketches.union_estimates(sketches.distinct_sketches(events, _COLUMNS, ["event_type"]))
    exact = events.agg(*[F.count_distinct(c).alias(c) for c in _COLUMNS]).unpivot([], list(_COLUMNS), "column", "exact")
    near = sketches.within(F.col("distinct"), F.col("exact"))
    return found.join(exact, "column").select("column", "exact", near.alias("within_error"))


@query(
    """
WITH u AS (SELECT DISTINCT event_type, user_id FROM events),
p AS (SELECT x.event_type AS a, y.event_type AS b, count(*) AS shared FROM u x JOIN u y USING (user_id)
  WHERE x.event_type < y.event_type GROUP BY ALL)
SELECT a, b, shared, true AS shared_within, true AS jaccard_within FROM p"""
)
def approx_distinct_overlap(spark, root):
    """Users that two event types share, from their sketches, beside the exact number."""
    events = table(spark, root, "events").select("event_type", F.col("user_id").cast("string").alias("user_id"))
    found = sketches.overlap_estimates(sketches.distinct_sketches(events, ["user_id"], ["event_type"]), "event_type")
    users = events.distinct()
    sizes = users.groupBy("event_type").count()
    pairs = users.withColumnRenamed("event_type", "a").join(users.withColumnRenamed("event_type", "b"), "user_id")
    exact = pairs.filter("a < b").groupBy("a", "b").agg(F.count("*").alias("exact"))
    exact = exact.join(sizes.toDF("a", "n_a"), "a").join(sizes.toDF("b", "n_b"), "b")
    both = found.join(exact, ["a", "b"]).withColumn("either", F.col("n_a") + F.col("n_b") - F.col("exact"))
    near = sketches.within(F.col("shared"), F.col("exact"), F.col("either"))
    jaccard = F.abs(F.col("jaccard") - F.col("exact") / F.col("either")) <= 2 * sketches.BOUND
    return both.select("a", "b", F.col("exact").alias("shared"), near.alias("shared_within"), jaccard.alias("jaccard_within"))


@query(
    r"""
WITH t AS (SELECT doc_id, doc_id // 16 AS batch, list_transform(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\x0B\x0C]+'),
    lambda w: len(w)::BIGINT)[1:64] AS ids FROM documents),
b AS (SELECT batch, count(*) AS n, max(len(ids)) AS width FROM t GROUP BY batch)
SELECT batch, n, width, sum(len(ids))::BIGINT AS filled, md5(string_agg(array_to_string(
    list_resize(ids, width, 0), ','), ';' ORDER BY doc_id)) AS digest FROM t JOIN b USING (batch) GROUP BY batch, n, width"""
)
def collated_batches(spark, root):
    """Word lengths of whole batches of sixteen documents, padded to the longest of 64 at most."""
    docs = table(spark, root, "documents")
    cut = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^ \t\n\r\x0B\x0C]+"), F.lit(0))
    lengths = F.transform(cut, lambda w: F.length(w).cast("long"))
    rows = docs.select("doc_id", F.expr("doc_id div 16").alias("batch"), lengths.alias("ids"))
    made = collation.collate(rows, "batch", "doc_id", "ids", 64)
    filled = F.aggregate(F.flatten("mask"), F.lit(0).cast("long"), lambda x, y: x + y)
    text = F.array_join(F.transform("ids", lambda r: F.array_join(r.cast("array<string>"), ",")), ";")
    return made.select("batch", "n", "width", filled.alias("filled"), F.md5(text).alias("digest"))
