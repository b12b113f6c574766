"""Readers and sinks on small files."""

import gzip
import json
import zipfile

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tandemlens.operators import graph, qa
from tandemlens.sources import readers, schemas, sinks, synthetic


def write(path, body, opener=open):
    path.parent.mkdir(parents=True, exist_ok=True)
    with opener(path, "wb") as f:
        f.write(body if isinstance(body, bytes) else body.encode())
    return str(path)


def test_json_lines_skip_blank_and_malformed(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", '{"head":"a","relation":"r","tail":"b"}\n\n{broken\n  \n{"head":"c"}\n')
    rows = readers.json_lines(spark, path, schemas.KG_TRIPLE).collect()
    assert [(r.head, r.tail) for r in rows] == [("a", "b"), ("c", None)]
    records, rejects = readers.json_lines_with_rejects(spark, path, schemas.KG_TRIPLE)
    assert records.count() == 2
    assert [r.line for r in rejects.collect()] == ["{broken"]
    with pytest.raises((PySparkException, Py4JJavaError)):
        readers.json_lines_strict(spark, path, schemas.KG_TRIPLE).collect()
    assert not readers.readable(spark, path, schemas.KG_TRIPLE)


def test_json_array_or_lines(spark, tmp_path):
    array = write(tmp_path / "array.json", json.dumps([{"entity_id": "1", "entity_name": "x"}] * 2, indent=2))
    lines = write(tmp_path / "lines.json", '{"entity_id":"1"}\nnope\n{"entity_id":"2"}\n{"entity_id":"3"}\n')
    assert readers.json_any(spark, array, schemas.KG_ENTITY).count() == 2
    assert readers.json_any(spark, lines, schemas.KG_ENTITY).count() == 3


def test_retrieval_folder(spark, tmp_path):
    write(tmp_path / "corpus.jsonl", '{"_id":"d1","title":"t","text":"x"}\n{"_id":"d2","text":"y"}\n')
    write(tmp_path / "queries.jsonl", '{"_id":"q1","text":"ask"}\n{"_id":"q2","text":"more"}\n')
    four = "q1\t0\td1\t1\nq1\t0\tmissing\t1\nshort\t1\nq9\t0\td2\t1\n"
    write(tmp_path / "qrels" / "test.tsv", four)
    write(tmp_path / "qrels" / "dev.tsv", "query-id\tcorpus-id\tscore\nq2\td2\t2\n")
    corpus, queries, qrels = readers.beir(spark, str(tmp_path))
    assert {r.title for r in corpus.collect()} == {"t", ""}
    pairs = qa.retrieval_pairs(queries, qrels, corpus).collect()
    assert [(r.query, r.passage_id, r.passage, r.relevance) for r in pairs] == [("ask", "d1", "x", 1)]
    dev = readers.qrels(spark, str(tmp_path / "qrels" / "dev.tsv")).collect()
    assert [tuple(r) for r in dev] == [("q2", "d2", 2)]


def test_passage_cap_counts_lines_before_the_filter(spark, tmp_path):
    path = write(tmp_path / "c.tsv", "0\ta\nbad\n2\tc\n3\td\n")
    assert [r.doc_id for r in readers.passages(spark, path, cap=3).collect()] == ["0", "2"]
    positions = readers.numbered_lines(spark, path).orderBy("pos").collect()
    assert [(r.pos, r.value) for r in positions] == [(0, "0\ta"), (1, "bad"), (2, "2\tc"), (3, "3\td")]


def test_gzipped_graph_files_and_latin1(spark, tmp_path):
    write(tmp_path / "entities.txt.gz", "Q1\tcafé\textra\nQ2\tb\nlonely\n", gzip.open)
    latin = write(tmp_path / "latin.txt.gz", "Q3\tcafé\nQ4\tplain\n".encode("latin-1"), gzip.open)
    triples = write(tmp_path / "triples.txt.gz", "Q1\tP1\tQ2\nQ1\tP1\n", gzip.open)
    utf8 = str(tmp_path / "entities.txt.gz")
    assert [tuple(r) for r in readers.kg_entities(spark, utf8).orderBy("entity_id").collect()] == [
        ("Q1", "café"),
        ("Q2", "b"),
    ]
    both = readers.kg_entities(spark, [utf8, latin])
    assert {r.entity_name for r in both.collect()} == {"café", "b", "plain"}
    rows = readers.kg_triples(spark, triples, "valid").collect()
    assert [tuple(r) for r in rows] == [("Q1", "P1", "Q2", "valid")]


def test_question_files_keyed_by_id(spark, tmp_path):
    body = {
        "query": {
            "1": {"query": "who", "query_type": "PERSON", "answers": ["me"]},
            "2": {"query": "what"},
        },
        "passages": {"1": [{"passage_text": "p", "is_selected": 1}, {"passage_text": "q", "url": "u"}]},
    }
    path = write(tmp_path / "train.json.gz", json.dumps(body), gzip.open)
    questions, passages = readers.qa_keyed(spark, path)
    nested = qa.attach_children(questions, passages, "query_id", "pos", "passages")
    rows = {r.query_id: r for r in nested.collect()}
    assert [(p.passage_text, p.is_selected, p.url) for p in rows["1"].passages] == [("p", 1, ""), ("q", 0, "u")]
    assert (rows["2"].passages, rows["2"].answers, rows["2"].query_type) == ([], [], "")


def test_token_slice_of_nested_parquet(spark, tmp_path):
    rows = [
        ("1", ("who",), ("T", None, (["a", "b", "c"],)), "{}"),
        ("2", (None,), ("T", "u", (["a"],)), "{}"),
        ("", ("x",), None, None),
        ("4", ("x",), None, None),
    ]
    spark.createDataFrame(rows, schemas.NQ_RAW).write.parquet(str(tmp_path / "nq"))
    got = readers.nq_slice(spark, str(tmp_path / "nq"), 2).orderBy("id").collect()
    assert [(r.id, r.document_title, r.document_url, r.document_tokens) for r in got] == [
        ("1", "T", "", ["a", "b"]),
        ("4", "", "", []),
    ]


def test_parquet_files_without_extension_and_corrupt_ones(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "x"))
    part = next((tmp_path / "x").glob("part-*.parquet"))
    target = tmp_path / "d"
    write(target / "sub" / "abc123", part.read_bytes())
    assert readers.parquet_files(spark, str(target)).count() == 5
    write(target / "zzz", b"not parquet at all")
    assert readers.parquet_files(spark, str(target)).count() == 5


def test_split_file_resolution():
    names = ["d/ms_train.jsonl", "d/ms_test.jsonl", "d/readme.md"]
    assert readers.resolve(names, "test") == "d/ms_test.jsonl"
    assert readers.resolve(names, "dev") == "d/ms_test.jsonl"
    with pytest.raises(FileNotFoundError):
        readers.resolve(["d/readme.md"], "train")


def test_zip_is_unpacked_once(tmp_path):
    with zipfile.ZipFile(tmp_path / "set.zip", "w") as z:
        z.writestr("set/a.txt", "x")
    args = (str(tmp_path / "set.zip"), str(tmp_path / "set"))
    assert readers.extract_if_absent(*args) and not readers.extract_if_absent(*args)


@pytest.mark.parametrize("parts", [None, 1, 2, 50])
def test_numbered_batches(spark, tmp_path, parts):
    folder = tmp_path / "b"
    sinks.numbered_batches(spark.range(1005).repartition(7), str(folder), 10, "id", parts)
    back = readers.json_lines(spark, str(folder), "id long, batch int").select("id", "batch", "_metadata.file_name")
    found = {}
    for r in back.collect():
        assert r.batch == r.id // 10 + 1
        found.setdefault(r.file_name, []).append((r.batch, r.id))
    assert sorted(len(f) for f in found.values()) == [5] + [10] * 100
    assert all(len({b for b, _ in f}) == 1 for f in found.values())
    assert [found[name][0][0] for name in sorted(found)] == list(range(1, 102))  # names are in the order of batches
    assert {p.name for p in folder.iterdir() if p.is_dir()} == set()


def test_a_failed_task_leaves_no_batch_file(spark, tmp_path):
    bad = spark.range(100).selectExpr("id", "CASE WHEN id = 95 THEN raise_error('stop') ELSE 'x' END AS v")
    with pytest.raises(Exception, match="stop"):
        sinks.numbered_batches(bad, str(tmp_path / "b"), 10, "id", 4)
    assert not list((tmp_path / "b").glob("part-*.json"))


def test_splits_summary_report_and_append(spark, tmp_path):
    df = spark.createDataFrame([("train", 1), ("train", 2), ("test", 3)], "split string, i int")
    sinks.json_lines_per_split(df, str(tmp_path / "s"))
    assert (tmp_path / "s" / "split=train").is_dir()
    sinks.summary_document(df, str(tmp_path / "sum"), dataset="demo")
    text = next((tmp_path / "sum").glob("part-*.json")).read_text()
    assert json.loads(text)["splits"] == {"train": 2, "test": 1} and '"total_examples":3' in text
    lines = spark.createDataFrame([(2, "b"), (1, "a")], "n int, line string")
    sinks.report(lines, str(tmp_path / "r"), "n")
    assert next((tmp_path / "r").glob("part-*.txt")).read_text() == "a\nb\n"
    log = spark.createDataFrame([("f1", 0, 0.5)], "metric string, step int, value double")
    for _ in range(2):
        sinks.metric_append(log, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2
    sinks.json_lines(df, str(tmp_path / "j"))
    sinks.parquet(df, str(tmp_path / "p"), "split")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3
    assert readers.file_sizes(spark, str(tmp_path / "j")).count() >= 1


def test_graph_edge_cases(spark):
    rows = [(0, "a", "r", "b"), (1, "b", "r", "a"), (2, "a", "", "c"), (3, "", "s", "a")]
    triples = spark.createDataFrame(rows, "pos long, head string, relation string, tail string")
    ents, rels = graph.vocabularies(triples)
    assert {tuple(r) for r in ents.collect()} == {("a", 1), ("b", 2), ("c", 3)}
    assert {tuple(r) for r in rels.collect()} == {("r", 1), ("s", 2)}
    edges = graph.undirected(graph.encode(triples, ents, rels))
    assert sorted((r.src, r.dst) for r in edges.collect()) == [(1, 2), (1, 2), (2, 1), (2, 1)]
    assert graph.undirected(graph.encode(triples.limit(0), ents, rels)).count() == 0


def test_synthetic_examples_do_not_depend_on_partitions(spark):
    one = {tuple(r) for r in synthetic.examples(spark, 200).collect()}
    two = {tuple(r) for r in synthetic.examples(spark, 200).repartition(3).collect()}
    assert one == two and 40 < sum(r[-1] for r in one) < 160
    assert synthetic.edges(spark, 10).count() == 50


def test_nq_record_needs_a_question_and_an_answer(spark):
    schema = (
        "example_id int, question string, tokens array<struct<token: string>>, "
        f"short_spans array<{schemas.SPAN}>, long_spans array<{schemas.SPAN}>, "
        "document_title string, document_url string"
    )
    tokens = [("a",), (" ",), ("c",)]
    rows = [
        (1, "q", tokens, [(0, 1), (1, 2), (2, 9)], [(0, 3)], "t", None),
        (2, "", tokens, [(0, 1)], [], "t", None),
        (3, "q", tokens, [(2, 2), (-1, 1)], [], "t", None),
    ]
    got = qa.nq_record(spark.createDataFrame(rows, schema)).collect()
    assert [(r.example_id, r.short_answers, r.long_answers) for r in got] == [("1", ["a"], ["a   c"])]
    assert (got[0].has_short_answer, got[0].has_long_answer, got[0].document_url) == (True, True, "")


def test_malformed_first_line_costs_that_line_only(spark, tmp_path):
    good = "".join(f'{{"k": {i}}}\n' for i in range(10))
    (tmp_path / "cut.jsonl").write_text('{"k": 99, "te\n' + good)
    (tmp_path / "bracket.jsonl").write_text("[oops\n" + good)
    (tmp_path / "whole.json").write_text('{\n "k": 50\n}\n')
    (tmp_path / "broken.json").write_text('{\n "k": 51,\n')
    got = sorted(r.k for r in readers.json_any(spark, str(tmp_path), "k bigint").collect())
    assert got == sorted([*range(10)] * 2 + [50])
