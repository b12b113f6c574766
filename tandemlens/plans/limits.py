"""Queries for batches, caps and samples, where the limit is the feature."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandemlens.functions.arrays import pad_or_cut
from tandemlens.functions.text import words
from tandemlens.operators import limits
from tandemlens.operators.ordered import top_per_group
from tandemlens.plans.catalog import query
from tandemlens.sources.tables import table


@query(
    """
SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 + 1 AS batch,
  (row_number() OVER (ORDER BY o_orderkey) - 1) % 1000 AS place FROM orders"""
)
def batch_assignment(spark, root):
    orders = table(spark, root, "orders").select("o_orderkey")
    return limits.batches(orders, 1000, [F.col("o_orderkey")])


@query(
    """
SELECT o_orderpriority, o_orderkey,
  (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) // 500 + 1 AS batch
FROM orders"""
)
def batch_assignment_per_split(spark, root):
    orders = table(spark, root, "orders").select("o_orderpriority", "o_orderkey")
    numbered = limits.batches(orders, 500, [F.col("o_orderkey")], ["o_orderpriority"])
    return numbered.drop("place")


@query(
    """SELECT doc_id, lang FROM (SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 500)
WHERE lang = 'fr'"""
)
def limit_before_filter(spark, root):
    docs = table(spark, root, "documents").select("doc_id", "lang")
    return limits.limit_then_filter(docs, 500, "doc_id", F.col("lang") == "fr")


@query("SELECT doc_id, lang FROM documents WHERE lang = 'fr' ORDER BY doc_id LIMIT 50")
def limit_after_filter(spark, root):
    docs = table(spark, root, "documents").select("doc_id", "lang")
    return limits.filter_then_limit(docs, 50, "doc_id", F.col("lang") == "fr")


@query(
    """
SELECT o_orderstatus, o_orderkey FROM orders
QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey)
  <= CASE o_orderstatus WHEN 'F' THEN 3000 WHEN 'O' THEN 300 ELSE 9223372036854775807 END"""
)
def cap_per_split(spark, root):
    orders = table(spark, root, "orders").select("o_orderstatus", "o_orderkey")
    caps = {"F": 3000, "O": 300}
    return limits.cap_per_split(orders, "o_orderstatus", caps, F.col("o_orderkey"))


@query(
    """
SELECT source, doc_id, r AS sample_no FROM (SELECT source, doc_id,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 5"""
)
def head_per_group(spark, root):
    docs = table(spark, root, "documents").select("source", "doc_id")
    return top_per_group(docs, ["source"], [F.col("doc_id")], 5, "sample_no")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 1000")
def head_sample(spark, root):
    orders = table(spark, root, "orders").select("o_orderkey", "o_custkey")
    return limits.first_n(orders, 1000, "o_orderkey")


@query(
    """
WITH f AS (SELECT source, count(*) AS n,
    sum(count(*)) OVER (ORDER BY source) - count(*) AS before FROM documents GROUP BY source),
r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place
  FROM documents)
SELECT source, doc_id FROM r JOIN f USING (source) WHERE place <= greatest(120 - before, 1)"""
)
def break_after_batch(spark, root):
    docs = table(spark, root, "documents").select("source", "doc_id")
    return limits.break_after_batch(docs, "source", F.col("doc_id"), 120)


@query(
    """
SELECT conv_id, turn, row_number() OVER (ORDER BY ('0x' || substr(md5('7:' || k), 1, 15))::bigint, k)
  - 1 AS position FROM (SELECT conv_id, turn, conv_id * 1000 + turn AS k FROM conversations)"""
)
def shuffle_order(spark, root):
    turns = table(spark, root, "conversations").select(
        "conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("k")
    )
    return limits.shuffled(turns, 7, "k").drop("k")


@query(
    """
SELECT source, doc_id FROM documents
WHERE source IN (SELECT DISTINCT source FROM documents ORDER BY source LIMIT 3)"""
)
def first_files(spark, root):
    return limits.first_files(table(spark, root, "documents").select("source", "doc_id"), "source", 3)


@query(
    """
SELECT conv_id, turn, len(w) AS n_words, 10::bigint AS width, coalesce(w[1], '') AS first,
  coalesce(w[10], '') AS last FROM (SELECT conv_id, turn,
  list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM conversations)"""
)
def pad_truncate(spark, root):
    tokens = words(F.col("text"))
    padded = table(spark, root, "conversations").select(
        "conv_id",
        "turn",
        F.size(tokens).alias("n_words"),
        pad_or_cut(tokens, 10, F.lit("")).alias("padded"),
    )
    return padded.select(
        "conv_id",
        "turn",
        "n_words",
        F.size("padded").alias("width"),
        F.col("padded")[0].alias("first"),
        F.col("padded")[9].alias("last"),
    )
