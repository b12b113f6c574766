"""The pipeline stage by stage on planted documents, and its edge cases."""

import random

import corpus_pipeline
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from tandemlens.llm.registry import MODULES

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    """A small folder of tables with one case for each stage."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeiou", k=rng.randint(3, 8))) for _ in range(4000)]
    text = lambda n=80: " ".join(rng.choice(words) for _ in range(n))
    shared = "this line stands in very many of the documents"
    item = text(30)
    base = text(120)
    docs = {i: f"{text(40)}\n{text(40)}" for i in range(300)}
    for i in range(0, 120, 4):
        docs[i] = f"{text(20)} you worthless idiot {text(20)}"
    for i in (201, 203, 205, 207):
        docs[i] = f"{shared}\n{docs[i]}"
    docs[211] = docs[213] = base
    docs[217] = base + " more"
    docs[221] = f"{text(30)} {item} {text(30)}"
    docs[223] = f"{text(30)} {' '.join(item.split()[:14] + ['changed'] + item.split()[15:])}"
    folder = tmp_path_factory.mktemp("tables")
    rows = [(i, t, "en", "s", len(t)) for i, t in docs.items()] + [(None, None, None, None, None), (999, "", "en", None, 0)]
    spark.createDataFrame(rows, COLUMNS).withColumn("row", F.lit(1)).withColumn("n_lines", F.lit("x")).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(i < 120 and i % 4 == 0)) for i in range(200)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), docs, shared


def test_stages_decide_as_planted(spark, root):
    folder, docs, shared = root
    now = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = set(now.columns), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.durable(stage(spark, now, folder), name)
        assert set(now.columns) == columns
        kept[name] = {r.doc_id: r for r in now.collect()}
    toxic = {i for i in range(0, 120, 4)}
    assert set(kept["toxicity"]) == set(docs) - toxic | {None, 999}
    lines = kept["line_dedup"]
    assert [shared in lines[i].text for i in (201, 203, 205, 207)] == [False, False, False, True]
    assert lines[201].n_lines == "x" and lines[201].row == 1 and lines[5].text == docs[5]
    near = set(kept["near_dedup"])
    assert near & {211, 213, 217} in ({211}, {211, 217}) and {1, 5, 201, 999, None} <= near
    assert set(kept["near_dedup"]) - set(kept["decontamination"]) == {221, 223}
    pieces = corpus_pipeline.packing(spark, now, folder).collect()
    assert {r.doc_id for r in pieces} == set(kept["decontamination"])


def test_run_equals_its_stages(spark, root):
    folder = root[0]
    got = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} == set(got.columns)
    assert got.filter("doc_id IN (221, 223)").count() == 0 and got.count() > 200


def test_empty_tables_and_nulls(spark, root):
    folder = root[0]
    none = spark.read.parquet(f"{folder}/documents.parquet").filter("false")
    odd = spark.createDataFrame([(None, None, None, None, None)] * 3 + [(1, None, None, None, None)] * 2, COLUMNS)
    for docs in (none, odd):
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.durable(stage(spark, docs, folder), "stage")
        assert docs.count() == (4 if docs.filter("doc_id = 1").count() else 0)


def test_registration():
    names = set(queries())
    assert "pipeline" in names and len([n for n in names if n.startswith("op")]) >= len(MODULES)
    assert {"op1_chat_format", "op3_license_scan", "op5_line_dedup"} <= set(oracle_sql())
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
