"""Null groups and splits, streams over folders, per-file formats, exact tests at large sizes."""

import math

import pytest
from pyspark.sql import functions as F

from tandemlens.operators import graph, limits, profile, qa, significance
from tandemlens.operators.ordered import lookup, running_totals
from tandemlens.sources import readers
from tandemlens.sources.schemas import EVENTS
from tandemlens.streaming import evaluators


def test_one_binomial_method_at_every_size():
    two = significance._two_sided
    for n in (1_999_999, 2_000_000, 2_000_001):
        assert two(3, n, 5e-6) == pytest.approx(0.0246133, rel=2e-5)
    assert two(5_000_000 - 1500, 10_000_000, 0.5) == pytest.approx(math.erfc(1499.5 / math.sqrt(2.5e6) / math.sqrt(2)), rel=1e-6)
    exact = sum(math.comb(40, i) for i in range(41) if math.comb(40, i) <= math.comb(40, 13)) / 2**40
    assert two(13, 40, 0.5) == pytest.approx(exact, rel=1e-10)
    assert two(0, 7, 0.0) == 1.0 and two(1, 7, 0.0) == 0.0 and two(7, 7, 1.0) == 1.0


def test_poisson_weights_have_the_whole_tail():
    steps = significance.poisson_steps()
    assert len(steps) > 14 and 1 - steps[-1] < 1e-15


def test_null_splits_and_groups_stay(spark):
    df = spark.createDataFrame(
        [("a", "q1", True), ("a", "q2", False), (None, None, False), (None, "q3", None), ("train", "q4", False)],
        "split string, question string, has_answer boolean",
    )
    assert limits.cap_per_split(df, "split", {"a": 1}, F.col("question")).count() == 4
    assert {r.question for r in qa.train_needs_answer(df).collect()} == {"q1", "q2", None, "q3"}
    assert {(r.split, r.unique_question) for r in profile.distinct_counts(df, ["question"], ["split"]).collect()} == {
        ("a", 2), (None, 1), ("train", 1),
    }
    rows = df.withColumn("answers", F.array(F.lit("x y")))
    got = {r.split: r.unique_question for r in profile.qa_profile(rows, ["split"]).collect()}
    assert got == {"a": 2, None: 1, "train": 1}


def test_null_group_and_key_on_the_hot_routes(skewed):
    rows = [(None if i % 2 else "b", i) for i in range(60)]
    df = skewed.createDataFrame(rows, "g string, i int")
    ranks = running_totals(df, ["g"], [F.col("i")], sums={"s": F.col("i")}).collect()
    assert len(ranks) == 60
    assert {r["rank"] for r in ranks if r.g is None} == set(range(1, 31))
    assert max(r.s for r in ranks if r.g is None) == sum(range(1, 60, 2))
    dim = skewed.createDataFrame([("b", 1.0), ("c", 2.0)], "g string, v double")
    assert lookup(df, dim, "g", "left").filter("v IS NULL").count() == 30
    assert lookup(df, dim, "g").count() == 30


def test_relation_is_not_shuffled(spark):
    triples = spark.createDataFrame([(i, f"h{i}", "r", f"t{i}") for i in range(20)], "pos bigint, head string, relation string, tail string")
    found = graph.encode(triples, *graph.vocabularies(triples))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(relation" not in plan and found.count() == 20


def test_attention_with_an_outlier(spark):
    nodes = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0]), (3, [5000.0, 9000.0])], "node bigint, x array<double>")
    edges = spark.createDataFrame([(1, 2), (3, 1)], "src bigint, dst bigint")
    x = F.col("x")
    got = {r.node: r.h for r in graph.gat_messages(edges, nodes, 2, 1, F.array(x[0]), F.array(x[1] * 0.0)).collect()}
    w = math.exp(1 - 3)
    assert got[2] == pytest.approx([(3 + w) / (1 + w), (4 + 2 * w) / (1 + w)])
    assert got[1] == pytest.approx([5000.0, 9000.0]) and got[3] == pytest.approx([5000.0, 9000.0])


@pytest.mark.parametrize(
    "answers,short,long,want",
    [(["  "], ["x"], [], False), ([], ["x"], [], True), (None, [], ["y"], True), (["a"], [], [], True), ([], [], [], False)],
)
def test_first_filled_answer_column_decides(spark, answers, short, long, want):
    schema = "answers array<string>, short_answers array<string>, long_answers array<string>"
    df = spark.createDataFrame([(answers, short, long)], schema)
    assert df.select(qa.has_valid_answer(df).alias("ok")).first().ok is want


def test_streams_read_files_and_folders(spark, tmp_path):
    events = spark.range(1000).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "id % 7 AS user_id", "'click' AS event_type",
        "double(id % 100) AS value", "'{}' AS props",
    )
    events.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    events.write.parquet(f"{tmp_path}/events_old.parquet")
    stream = evaluators.table_stream(spark, str(tmp_path), "events", EVENTS)
    log = evaluators.append_stream(evaluators.metric_stream(stream), "log", "metric")
    assert log.count() == 1000
    label = (F.col("user_id") % 2).cast("int")
    again = evaluators.table_stream(spark, str(tmp_path), "events", EVENTS)
    assert evaluators.binary_metrics_stream(again, F.col("value") / 100, label, ["event_type"]).count() == 1
    events.limit(0).write.parquet(f"{tmp_path}/none/events.parquet")
    empty = evaluators.table_stream(spark, f"{tmp_path}/none", "events", EVENTS)
    assert evaluators.binary_metrics_stream(empty, F.col("value"), label, ["event_type"]).count() == 0


def test_json_kind_is_decided_per_file(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"k": 1}, {"k": 2}]')
    (tmp_path / "b.json").write_text('\n{"k": 3}\nbroken\n{"k": 4}\n')
    (tmp_path / "c.json").write_text('{\n  "k": 5\n}\n')
    (tmp_path / "d.json").write_text("\n")
    got = sorted(r.k for r in readers.json_any(spark, str(tmp_path), "k bigint").collect())
    assert got == [1, 2, 3, 4, 5]


def test_bad_relevance_is_a_reject(spark):
    lines = spark.createDataFrame([("query-id\tcorpus-id\tscore",), ("q\td\t1",), ("q\td\t1.0",), ("q\t0\td\tx",)], "value string")
    rows, rejects = readers.parse_qrels_with_rejects(lines)
    assert [(r.query_id, r.relevance) for r in rows.collect()] == [("q", 1)]
    assert sorted(r.grade for r in rejects.collect()) == ["1.0", "x"]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        readers.parse_qrels(lines).collect()


def test_unreadable_parquet_files_are_named(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(f"{tmp_path}/x/good")
    (tmp_path / "x" / "bad.parquet").write_bytes(b"no parquet here")
    rows, rejects = readers.parquet_files_with_rejects(spark, f"{tmp_path}/x", "id bigint")
    assert rows.count() == 3
    assert any(r.path.endswith("bad.parquet") for r in rejects.collect())


def test_union_of_column_names(spark, tmp_path):
    spark.range(1).write.parquet(f"{tmp_path}/a")
    spark.range(1).withColumn("z", F.lit(1)).write.parquet(f"{tmp_path}/b")
    got = {r.column: r.n_files for r in readers.column_union(spark, [f"{tmp_path}/a", f"{tmp_path}/b"]).collect()}
    assert got == {"id": 2, "z": 1}


def test_durable_tables_can_be_released(spark):
    from tandemlens.session import durable, release

    release(spark)
    assert durable(spark.range(3), "gone").count() == 3
    assert release(spark) == 1 and release(spark) == 0
