"""The ingest functions on a small raw folder, and their report."""

import gzip
import json

from test_sources import write

from tandemlens.plans import ingest
from tandemlens.sources import readers, schemas


def test_raw_folder_to_report(spark, tmp_path):
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    write(raw / "ir" / "corpus.jsonl", '{"_id":"d1","text":"x"}\n')
    write(raw / "ir" / "queries.jsonl", '{"_id":"q1","text":"ask"}\n')
    write(raw / "ir" / "qrels" / "test.tsv", "q1\t0\td1\t1\nq1\t0\tnone\t1\n")
    keyed = {"query": {"1": {"query": "who", "answers": ["me"]}}, "passages": {}}
    write(raw / "qa" / "train.json", json.dumps(keyed))
    flat = '{"question":"a","answers":["x",""]}\n{"question":"b","answers":[""]}\n{"question":"c","answers":[]}\n'
    write(raw / "qa" / "flat.jsonl", flat)
    write(raw / "kg" / "e.txt.gz", "Q1\tone\nQ1\tother\n", gzip.open)
    write(raw / "kg" / "r.txt.gz", "P1\tknows\n", gzip.open)
    write(raw / "kg" / "train.txt.gz", "Q1\tP1\tQ2\nbad\nQ2\tP1\tQ1\n", gzip.open)
    write(raw / "kg" / "valid.txt.gz", "Q1\tP9\tQ1\n", gzip.open)
    status = [
        ingest.retrieval(spark, str(raw / "ir"), out, "scifact"),
        ingest.questions(spark, {"train": str(raw / "qa" / "train.json")}, out, "keyed"),
        ingest.answered_questions(spark, {"train": str(raw / "qa" / "flat.jsonl")}, out, "flat", schemas.QA_FLAT),
        ingest.knowledge_graph(
            spark,
            str(raw / "kg" / "e.txt.gz"),
            str(raw / "kg" / "r.txt.gz"),
            {s: str(raw / "kg" / f"{s}.txt.gz") for s in ("train", "valid")},
            out,
            "wiki",
            {"train": 2},
        ),
    ]
    assert [s.first().examples for s in status] == [1, 1, 1, 2]
    row = ingest.report(status).first()
    assert (row.total_datasets, row.total_examples, row.overall_ready) == (4, 5, True)
    kg = readers.json_lines(spark, f"{out}/kg/wiki", f"{schemas.KG_LABELLED}, split STRING")
    got = {(r.split, r.relation_label, r.tail_label) for r in kg.collect()}
    assert {g[:2] for g in got} == {("train", "knows"), ("valid", "P9")}
    assert {r.head_label for r in kg.collect()} == {"other"}
    flat_back = readers.json_lines(spark, f"{out}/qa/flat", schemas.QA_FLAT).collect()
    assert [(r.question, r.answers) for r in flat_back] == [("a", ["x"])]


def test_model_checkpoints(spark, tmp_path):
    from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
    from pyspark.ml.linalg import Vectors

    from tandemlens.sources import sinks

    rows = [(float(i % 2), Vectors.dense([float(i), 1.0])) for i in range(10)]
    model = LogisticRegression(maxIter=2).fit(spark.createDataFrame(rows, ["label", "features"]))
    sinks.save_model(model, str(tmp_path / "m"), 3, True)
    for name in ("checkpoint_epoch_3", "best_model"):
        assert LogisticRegressionModel.load(str(tmp_path / "m" / name)).numFeatures == 2
