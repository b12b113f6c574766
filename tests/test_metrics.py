"""Golden vectors, edge cases and identities of the metrics."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tandemlens.operators import binary, complementarity, ranking, significance, tracking, validate


def scores(spark, preds, labels):
    return spark.createDataFrame(list(zip(preds, labels)), "score double, label int")


def test_perfect_classifier(spark):
    df = scores(spark, [0.8, 0.3, 0.9, 0.1], [1, 0, 1, 0])
    assert tuple(binary.binary_metrics(df, "score", "label").first()) == (1.0, 1.0, 1.0, 1.0)
    assert binary.roc_auc(df, "score", "label").first().auc == 1.0


def test_score_of_one_half_is_class_zero_and_undefined_ratios_are_zero(spark):
    df = scores(spark, [0.5, 0.5], [1, 0])
    row = binary.binary_metrics(df, "score", "label").first()
    assert (row.accuracy, row.precision, row.recall, row.f1) == (0.5, 0.0, 0.0, 0.0)


def test_auc_of_one_class_is_zero_and_ties_count_half(spark):
    assert binary.roc_auc(scores(spark, [0.1, 0.9], [1, 1]), "score", "label").first().auc == 0.0
    assert binary.roc_auc(scores(spark, [0.4, 0.4], [1, 0]), "score", "label").first().auc == 0.5


def test_empty_input_gives_no_row(spark):
    df = scores(spark, [], [])
    assert binary.binary_metrics(df, "score", "label").count() == 0
    assert binary.roc_auc(df, "score", "label").count() == 0


def test_auc_against_pair_counting(spark):
    rng = random.Random(5)
    preds = [rng.randrange(30) / 30 for _ in range(200)]
    labels = [rng.randrange(2) for _ in preds]
    pos = [p for p, y in zip(preds, labels) if y]
    neg = [p for p, y in zip(preds, labels) if not y]
    wins = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert binary.roc_auc(scores(spark, preds, labels), "score", "label").first().auc == pytest.approx(wins)


def ranked(spark, rows):
    rows = [(*r, i) for i, r in enumerate(rows)]
    schema = "query_id string, doc_id string, score double, relevance int, pos int"
    return spark.createDataFrame(rows, schema)


def test_ranking_golden_vector(spark):
    df = ranked(spark, [("q1", "d1", 0.9, 1), ("q1", "d2", 0.7, 0), ("q2", "d3", 0.8, 1), ("q2", "d4", 0.6, 1)])
    at = {r.k: r for r in ranking.metrics_at_k(df).collect()}
    assert [round(at[k].precision, 6) for k in ranking.KS] == [1.0, 0.3, 0.15, 0.075]
    assert [at[k].recall for k in ranking.KS] == [0.75, 1.0, 1.0, 1.0]
    assert [at[k].ndcg for k in ranking.KS] == [1.0] * 4
    assert ranking.mean_average_precision(df).first().map == 1.0


def brute_force_ranking(rows, k):
    by_query = {}
    for q, _, s, rel in rows:
        by_query.setdefault(q, []).append((s, rel))
    p, r, n = [], [], []
    for results in by_query.values():
        results.sort(key=lambda x: -x[0])
        rels = [rel for _, rel in results]
        hits, total = sum(x > 0 for x in rels[:k]), sum(x > 0 for x in rels)
        gain = lambda xs: sum((2**x - 1) / math.log2(i + 2) for i, x in enumerate(xs[:k]))
        best = gain(sorted(rels, reverse=True))
        p.append(hits / k)
        r.append(hits / total if total else 0)
        n.append(gain(rels) / best if best else 0)
    return [sum(x) / len(x) for x in (p, r, n)]


def test_ranking_with_ties_grades_and_queries_without_hits(spark):
    rng = random.Random(11)
    rows = [(f"q{rng.randrange(9)}", f"d{i}", rng.randrange(8) / 8, rng.randrange(4)) for i in range(150)]
    rows += [("none", f"d{i}", 0.5, 0) for i in range(3)]
    got = {r.k: r for r in ranking.metrics_at_k(ranked(spark, rows)).collect()}
    last = (0, 0)
    for k in ranking.KS:
        want = brute_force_ranking(rows, k)
        assert [got[k].precision, got[k].recall, got[k].ndcg] == pytest.approx(want)
        assert 0 <= got[k].ndcg <= 1
        assert got[k].precision * k >= last[0] - 1e-9 and got[k].recall >= last[1] - 1e-9
        last = (got[k].precision * k, got[k].recall)


def paired(spark, rows):
    schema = "example_id int, kg double, dense double, fusion double, label int"
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)


GOLDEN = [(0.6, 0.7, 0.8, 1), (0.4, 0.6, 0.5, 0), (0.8, 0.2, 0.7, 1), (0.3, 0.9, 0.6, 1)]


def test_complementarity_golden_vector(spark):
    row = complementarity.complementarity(paired(spark, GOLDEN)).first()
    assert (row.kg_accuracy, row.dense_accuracy, row.fusion_accuracy) == (0.75, 0.5, 1.0)
    assert (row.fusion_improvement, row.complementarity_score, row.oracle_accuracy) == (0.25, 0.75, 1.0)
    assert (row.kg_only_correct_rate, row.dense_only_correct_rate) == (0.5, 0.25)
    assert (row.both_correct_rate, row.both_wrong_rate) == (0.25, 0.0)


def test_complementarity_identities(spark):
    rng = random.Random(2)
    rows = [(rng.random(), rng.random(), rng.random(), rng.randrange(2)) for _ in range(120)]
    df = paired(spark, rows)
    b = complementarity.complementarity(df).first()
    e = complementarity.experiment_summary(df, ["fusion"]).first()
    assert e.complementarity_ratio == pytest.approx(1 - e.dense_kg_agreement)
    four = b.both_correct_rate + b.both_wrong_rate + b.kg_only_correct_rate + b.dense_only_correct_rate
    assert four == pytest.approx(1)
    assert b.oracle_accuracy == pytest.approx(1 - b.both_wrong_rate)
    assert b.kg_accuracy == pytest.approx(b.both_correct_rate + b.kg_only_correct_rate)
    assert complementarity.complementarity(df.limit(0)).count() == 0


def test_alignment_is_by_id_not_by_position(spark):
    kg = spark.createDataFrame([(1, 0.9), (2, 0.1)], "id int, score double")
    dense = spark.createDataFrame([(2, 0.2), (1, 0.8), (3, 0.5)], "id int, score double")
    labels = spark.createDataFrame([(2, 0), (1, 1)], "id int, label int")
    rows = complementarity.align([("kg", kg), ("dense", dense)], labels, "id").collect()
    assert {(r.id, r.kg, r.dense, r.label) for r in rows} == {(1, 0.9, 0.8, 1), (2, 0.1, 0.2, 0)}


def epochs(spark, values):
    rows = [("f1", i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "metric string, epoch long, v double")


def test_best_so_far_is_strict_and_first_best_wins(spark):
    df = epochs(spark, [0.2, 0.5, 0.5, 0.4, 0.6, 0.6])
    marks = tracking.best_so_far(df, "v", F.col("epoch")).orderBy("epoch").collect()
    assert [r.is_best for r in marks] == [True, True, False, False, True, False]
    best = tracking.best_epoch(df, "v", "epoch").first()
    assert (best.best_metric, best.best_epoch) == (0.6, 4)


def test_plateau_schedule(spark):
    values = [0.5, 0.6, 0.6, 0.59, 0.6, 0.6, 0.6, 0.6, 0.6, 0.6, 0.7]
    rows = tracking.plateau_schedule(epochs(spark, values), "v", "epoch", 0.1).orderBy("epoch")
    best, bad, lr, want = None, 0, 0.1, []
    for v in values:
        if best is None or v > best * (1 + 1e-4):
            best, bad = v, 0
        else:
            bad += 1
        if bad > 3:
            lr, bad = lr * 0.5, 0
        want.append(lr)
    assert [r.lr for r in rows.collect()] == pytest.approx(want)


def test_early_stop(spark):
    stops = tracking.early_stop(epochs(spark, [0.5, 0.49, 0.4]), "v", "epoch").orderBy("epoch")
    assert [r.stop for r in stops.collect()] == [False, False, True]


def test_steps_keep_a_given_zero(spark):
    rows = [("loss", 0, 0, 1.0), ("loss", 1, None, 0.9), ("loss", 2, 7, 0.8)]
    log = spark.createDataFrame(rows, "metric string, seq int, given int, value double")
    steps = tracking.auto_step(log, [F.col("seq")], F.col("given")).orderBy("seq").collect()
    assert [r.step for r in steps] == [0, 1, 7]


def test_config_merge_keeps_the_last_value(spark):
    rows = [("lr", "1", 0), ("lr", "2", 5), ("size", "8", 1)]
    merged = tracking.merge_config(spark.createDataFrame(rows, "key string, value string, seq int"))
    assert {tuple(r) for r in merged.collect()} == {("lr", "2"), ("size", "8")}


def test_model_info(spark):
    df = spark.range(1).select(*tracking.model_info(F.lit("m"), F.lit(262144), F.lit(1000)))
    assert tuple(df.first()) == ("m", 262144, 1000, 1.0)


def test_status_and_readiness(spark):
    rows = [
        ("beir_ir", "ir", True, 5, "files"),
        ("ms_marco_qa", "qa", True, 0, "files"),
        ("nq", "qa", True, 0, "batches"),
        ("wikidata5m_kg", "kg", False, 0, "files"),
    ]
    df = spark.createDataFrame(rows, "name string, task string, e boolean, examples long, kind string")
    df = df.withColumn("status", validate.status(F.col("e"), F.col("examples"), F.col("kind")))
    assert {r.name: r.status for r in df.collect()} == {
        "beir_ir": "valid",
        "ms_marco_qa": "invalid",
        "nq": "processing",
        "wikidata5m_kg": "missing",
    }
    required = spark.createDataFrame([(n,) for n in validate.REQUIRED], "name string")
    summary = validate.validation_summary(df, required).first()
    assert (summary.valid_datasets, summary.missing, summary.ready_for_training) == (1, 2, False)
    done = df.withColumn("status", F.when(F.col("examples") > 0, "completed_with_fallback").otherwise("failed"))
    rolled = validate.status_rollup(done.withColumn("size_mb", F.lit(1.0))).first()
    assert (rolled.successful_datasets, rolled.ir_ready, rolled.overall_ready) == (1, True, False)
    ready = validate.research_readiness(df.where("task = 'ir'")).first()
    assert (ready.ready_for_research, ready.missing_components) == (False, "QA datasets")


def test_null_bytes_and_empty_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("b\0c", 2.0), (None, float("nan"))], "t string, x double")
    assert validate.drop_corrupt(df).count() == 2
    assert [r[0] for r in df.select(validate.non_empty_value(df, "t")).collect()] == [True, True, False]
    assert [r[0] for r in df.select(validate.non_empty_value(df, "x")).collect()] == [True, True, False]


def test_progress_bands(spark):
    rows = [(None,), (0.0,), (1.0,), (9.6,)]
    df = spark.createDataFrame(rows, "gb double").select(*validate.progress(F.col("gb"), F.lit(10.0)))
    assert [r.band for r in df.collect()] == ["not started", "starting", "downloading", "complete"]


def test_binomial_test_is_exact_and_symmetric():
    assert significance._two_sided(0, 6, 0.5) == pytest.approx(2 / 64)
    assert significance._two_sided(3, 6, 0.5) == pytest.approx(1.0)
    assert significance._two_sided(0, 0, 0.5) == pytest.approx(1.0)
    assert significance._two_sided(2, 10, 0.0) == 0.0


def test_mcnemar_without_discordant_pairs(spark):
    df = paired(spark, [(0.9, 0.9, 0.9, 1), (0.1, 0.1, 0.1, 0)])
    row = significance.mcnemar(df, "kg", "fusion").first()
    assert (row.both_right, row.statistic, row.p_value) == (2, 0, pytest.approx(1.0))
