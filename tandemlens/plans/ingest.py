"""Corpus ingest end to end: read, normalise, write one layout, and report.

Every function writes JSON lines below `<out>/<task>/<dataset>/split=<split>` and
returns its status row. A failing read raises; nothing is made up in its place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemlens.operators import graph, qa, validate
from tandemlens.sources import readers, sinks


def _written(spark: SparkSession, df: DataFrame, out: str, task: str, dataset: str) -> DataFrame:
    """Write the records and return (name, task, status, examples, size_mb)."""
    path = f"{out}/{task}/{dataset}"
    sinks.json_lines_per_split(df, path)
    size = readers.file_sizes(spark, path).agg(F.sum("size_mb").alias("size_mb")).scalar()
    return spark.read.text(path).agg(
        F.lit(dataset).alias("name"),
        F.lit(task).alias("task"),
        F.lit("completed").alias("status"),
        F.count("value").alias("examples"),
        F.coalesce(size, F.lit(0.0)).alias("size_mb"),
    )


def retrieval(
    spark: SparkSession,
    folder: str,
    out: str,
    dataset: str,
    split: str = "test",
    cap: int | None = None,
) -> DataFrame:
    """corpus, queries and judgements to query-passage pairs, at most `cap` of them if given."""
    corpus, queries, qrels = readers.beir(spark, folder, split)
    pairs = qa.retrieval_pairs(queries, qrels, corpus).withColumn("dataset", F.lit(dataset))
    if cap is not None:
        pairs = qa.cap_pairs(pairs, "dataset", [F.col("query_id"), F.col("passage_id")], cap)
    return _written(spark, pairs.withColumn("split", F.lit(split)), out, "ir", dataset)


def questions(spark: SparkSession, files: dict[str, str], out: str, dataset: str) -> DataFrame:
    """Question files per split, with the passages of each question attached."""
    parts = []
    for split, path in files.items():
        asked, passages = readers.qa_keyed(spark, path)
        nested = qa.attach_children(asked, passages, "query_id", "pos", "passages")
        parts.append(nested.withColumn("split", F.lit(split)))
    return _written(spark, reduce(DataFrame.unionByName, parts), out, "qa", dataset)


def answered_questions(
    spark: SparkSession, files: dict[str, str], out: str, dataset: str, schema: str
) -> DataFrame:
    """Flat question records; those without a non-empty answer are dropped."""
    parts = [
        readers.json_lines(spark, path, schema).withColumn("split", F.lit(split))
        for split, path in files.items()
    ]
    records = qa.marco_record(reduce(DataFrame.unionByName, parts))
    return _written(spark, records, out, "qa", dataset)


def documents_with_tokens(
    spark: SparkSession, path: str, out: str, dataset: str, max_tokens: int | None = None
) -> DataFrame:
    """Nested Parquet to question, document fields and tokens, the first `max_tokens` if given."""
    rows = readers.nq_slice(spark, path, max_tokens).withColumn("split", F.lit("train"))
    return _written(spark, rows, out, "qa", dataset)


def knowledge_graph(
    spark: SparkSession,
    entities: str,
    relations: str,
    triples: dict[str, str],
    out: str,
    dataset: str,
    caps: dict[str, int] | None = None,
) -> DataFrame:
    """Labelled triples of all splits; `caps` limits the input lines of a split."""
    parts = []
    for split, path in triples.items():
        if caps and split in caps:
            lines = readers.numbered_lines(spark, path).where(F.col("pos") < caps[split])
            rows = readers.tsv_fields(lines, 3)
            names = ("head", "relation", "tail")
            fields = [F.col("parts")[i].alias(n) for i, n in enumerate(names)]
            parts.append(rows.select(*fields, F.lit(split).alias("split")))
        else:
            parts.append(readers.kg_triples(spark, path, split))
    labelled = graph.with_labels(
        reduce(DataFrame.unionByName, parts),
        readers.kg_names(spark, entities, "entity_id", "entity_name"),
        readers.kg_names(spark, relations, "relation_id", "relation_name"),
    )
    return _written(spark, labelled, out, "kg", dataset)


def report(statuses: list[DataFrame]) -> DataFrame:
    """Totals and readiness over the status rows of a run."""
    return validate.status_rollup(reduce(DataFrame.unionByName, statuses))
