"""Extension: lexical retrieval queries, for a baseline that is only named on paper."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandemlens.operators import retrieval
from tandemlens.plans.catalog import query, rounded
from tandemlens.session import durable, fits_broadcast
from tandemlens.sources.tables import table

TOP = 10

_TERMS_SQL = r"unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+'))"

BM25_SQL = rf"""(
  WITH t AS (SELECT doc_id, {_TERMS_SQL} AS term FROM documents),
  tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
  dl AS (SELECT d.doc_id, coalesce(l.dl, 0) AS dl FROM documents d
    LEFT JOIN (SELECT doc_id, count(*) AS dl FROM t GROUP BY doc_id) l USING (doc_id)),
  n AS (SELECT count(*) AS n, avg(dl) AS mean FROM dl),
  df AS (SELECT term, ln(1 + (n - count(*) + 0.5e0) / (count(*) + 0.5e0)) AS idf FROM tf, n GROUP BY term, n),
  q AS (SELECT item_id AS query_id, term, count(*) AS qf FROM (SELECT item_id, {_TERMS_SQL} AS term FROM benchmark) GROUP BY ALL),
  s AS (SELECT query_id, doc_id, round(sum(qf * idf * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / mean))), 9) AS score
    FROM q JOIN df USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), n GROUP BY query_id, doc_id)
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= {TOP})"""


def _found(spark, root):
    index = retrieval.bm25_index(table(spark, root, "documents"), "doc_id", "text")
    return retrieval.bm25_search(index, table(spark, root, "benchmark"), TOP, "item_id")


@query(f"SELECT query_id, rank, doc_id, round(score, 6) AS score FROM {BM25_SQL}")
def bm25_top10(spark, root):
    """Whole benchmark items as queries against whole documents."""
    return rounded(_found(spark, root))


@query(
    f"""
SELECT count(*) AS n_queries, round(avg(hit), 6) AS hit_rate, round(avg(first), 6) AS mean_reciprocal_rank FROM (
  SELECT b.item_id, max(coalesce((contains(d.text, b.text))::int, 0)) AS hit,
    max(CASE WHEN contains(d.text, b.text) THEN 1e0 / s.rank ELSE 0 END) AS first
  FROM benchmark b LEFT JOIN {BM25_SQL} s ON s.query_id = b.item_id LEFT JOIN documents d USING (doc_id) GROUP BY b.item_id)"""
)
def bm25_passage_recall(spark, root):
    """How often a document that holds the item word for word is among the ten best, and how high."""
    items = table(spark, root, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("item"))
    texts = table(spark, root, "documents").select("doc_id", "text")
    found = durable(_found(spark, root), "found")  # counted, so that whole texts are not shuffled for it
    found = F.broadcast(found) if fits_broadcast(found) else found
    held = texts.join(found, "doc_id").join(items, "query_id")
    held = held.filter(F.contains("text", "item")).groupBy("query_id").agg(F.min("rank").alias("rank"))
    per_item = items.join(held, "query_id", "left")
    return rounded(
        per_item.agg(
            F.count("*").alias("n_queries"),
            F.avg(F.col("rank").isNotNull().cast("int")).alias("hit_rate"),
            F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mean_reciprocal_rank"),
        )
    )
