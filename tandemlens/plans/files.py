"""Queries that pass whole tables through the readers and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandemlens.plans.catalog import query, rnd
from tandemlens.plans.inputs import TRIPLES_SQL, qa_examples, triples
from tandemlens.plans.inputs import QA_SQL
from tandemlens.session import scratch_path
from tandemlens.sources import readers, sinks
from tandemlens.sources.tables import table


@query(
    f"""
SELECT split, count(*) AS n, count(answer) AS answered, cast(sum(length(question)) AS bigint)
  AS question_chars FROM {QA_SQL} GROUP BY split"""
)
def jsonl_roundtrip(spark, root):
    """QA records to JSON lines per split, and back through the explicit schema."""
    path = scratch_path(spark, "qa-jsonl")
    sinks.json_lines_per_split(qa_examples(spark, root), path)
    schema = "example_id BIGINT, question STRING, answers ARRAY<STRING>, split STRING"
    back = readers.json_lines(spark, path, schema)
    return back.groupBy("split").agg(
        F.count("*").alias("n"),
        F.count_if(F.size("answers") > 0).alias("answered"),
        F.sum(F.length("question")).alias("question_chars"),
    )


@query(
    """
SELECT count(*) FILTER (event_type <> 'error') AS records,
  count(*) FILTER (event_type = 'error') AS rejected,
  cast(sum(cast(props->>'$.k' AS bigint)) FILTER (event_type <> 'error') AS bigint) AS k_sum
FROM events"""
)
def jsonl_rejects(spark, root):
    """Malformed lines (error events, cut short) are counted, the others parsed."""
    broken = F.expr("left(props, length(props) - 1)")
    line = F.when(F.col("event_type") == "error", broken).otherwise(F.col("props"))
    lines = table(spark, root, "events").select(line.alias("value"))
    checked = readers.checked_lines(lines, "value", "k BIGINT")
    bad = F.col("rejected")
    return checked.agg(
        F.count_if(~bad).alias("records"),
        F.count_if(bad).alias("rejected"),
        F.sum(F.when(~bad, F.col("record.k"))).alias("k_sum"),
    )


@query(
    """
SELECT relevance, count(*) AS n FROM (
  SELECT CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END::bigint AS relevance, l_linenumber
  FROM lineitem) WHERE l_linenumber <> 1 GROUP BY relevance"""
)
def qrels_arity(spark, root):
    """Line items as judgement lines: four fields, three, or too few (first lines)."""
    flag, number = F.col("l_returnflag"), F.col("l_linenumber")
    grade = F.when(flag == "R", "2").when(flag == "A", "1").otherwise("0")
    short = F.concat_ws("\t", "l_orderkey", "l_partkey")
    three = F.concat_ws("\t", "l_orderkey", "l_partkey", grade)
    four = F.concat_ws("\t", "l_orderkey", F.lit("Q0"), "l_partkey", grade)
    line = F.when(number == 1, short).when(number == 2, three).otherwise(four)
    parsed = readers.parse_qrels(table(spark, root, "lineitem").select(line.alias("value")))
    return parsed.groupBy("relevance").agg(F.count("*").alias("n"))


@query(
    f"""
SELECT split, count(*) AS n, count(DISTINCT head) AS heads, count(DISTINCT tail) AS tails
FROM {TRIPLES_SQL} GROUP BY split"""
)
def kg_gzip_roundtrip(spark, root):
    """Triples to gzipped tab-separated lines per split, and back."""
    path = scratch_path(spark, "kg-tsv")
    lines = triples(spark, root).select(
        "split", F.concat_ws("\t", "head", "relation", "tail").alias("value")
    )
    lines.write.partitionBy("split").option("compression", "gzip").text(path)
    parts = [
        readers.kg_triples(spark, f"{path}/split={split}", split)
        for split in ("train", "valid", "test")
    ]
    back = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return back.groupBy("split").agg(
        F.count("*").alias("n"),
        F.count_distinct("head").alias("heads"),
        F.count_distinct("tail").alias("tails"),
    )


@query(
    """
SELECT batch, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM (
  SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 5000 + 1 AS batch
  FROM orders) GROUP BY batch"""
)
def batch_files(spark, root):
    """Numbered batch files of 5,000 records, and back."""
    path = scratch_path(spark, "batches")
    orders = table(spark, root, "orders").select("o_orderkey", "o_custkey")
    sinks.numbered_batches(orders, path, 5_000, "o_orderkey")
    back = readers.json_lines(spark, path, "o_orderkey BIGINT, o_custkey BIGINT, batch BIGINT")
    return back.groupBy("batch").agg(
        F.count("*").alias("n"),
        F.min("o_orderkey").alias("first"),
        F.max("o_orderkey").alias("last"),
    )


@query()
def file_sizes(spark, root):
    """Size of every file of the data folder."""
    sizes = readers.file_sizes(spark, root)
    return sizes.select(readers.stem(F.col("path")).alias("file"), rnd(F.col("size_mb")).alias("size_mb"))
