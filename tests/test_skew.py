"""The routes for hot keys give what the plain ones give."""

import random

import pytest
from conftest import DATA
from oracle_check import compare, connect
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from tandemlens.operators import ordered, qa, ranking
from tandemlens.operators.limits import break_after_batch, first_n
from tandemlens.operators.ordered import lookup, running_totals, top_per_group
from tandemlens.plans import inputs

HOT_QUERIES = [
    "roc_auc",
    "ir_map",
    "running_accuracy",
    "positional_ids",
    "nested_passages",
    "kg_encode",
    "kg_labels_default",
    "entity_linking",
    "gat_attention",
    "auto_step",
    "best_value_marks",
    "batch_assignment",
    "ir_pairs_capped",
    "shuffle_order",
]


@pytest.mark.parametrize("name", HOT_QUERIES)
def test_query_with_forced_splits(skewed, name):
    skewed.conf.set("spark.tandemlens.splitRows", "60")
    con = connect(DATA)
    problem, _, _ = compare(skewed, con, name, queries()[name], oracle_sql()[name], DATA)
    assert problem is None, problem


def rows_with_hot_group(n=300, seed=1):
    """One group holds over a third of the rows, with many tied keys."""
    rng = random.Random(seed)
    groups = ["hot" if i % 5 < 2 else f"g{rng.randrange(12)}" for i in range(n)]
    return [(g, rng.randrange(6), i, rng.randrange(100)) for i, g in enumerate(groups)]


def expected_running(rows):
    out, state = {}, {}
    for g, k, i, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        rank, total, top = state.get(g, (0, 0, None))
        out[i] = (rank + 1, total + v, top)
        state[g] = (rank + 1, total + v, v if top is None else max(top, v))
    return out


@pytest.mark.parametrize("limit", ["7", "40", "1000000"])
def test_running_totals(spark, limit):
    rows = rows_with_hot_group()
    df = spark.createDataFrame(rows, "g string, k int, i int, v long")
    spark.conf.set("spark.tandemlens.splitRows", limit)
    try:
        got = running_totals(
            df, ["g"], [F.col("k"), F.col("i")], {"total": F.col("v")}, {"prior": F.col("v")}
        ).collect()
    finally:
        spark.conf.unset("spark.tandemlens.splitRows")
    assert {r.i: (r.rank, r.total, r.prior) for r in got} == expected_running(rows)


def test_running_totals_without_groups(skewed):
    rows = rows_with_hot_group(120)
    df = skewed.createDataFrame(rows, "g string, k int, i int, v long")
    got = running_totals(df, [], [F.col("k"), F.col("i")], {"total": F.col("v")}).collect()
    want = expected_running([("all", k, i, v) for _, k, i, v in rows])
    assert {r.i: (r.rank, r.total) for r in got} == {i: w[:2] for i, w in want.items()}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_with_hot_key(skewed, how):
    rows = rows_with_hot_group()
    big = skewed.createDataFrame(rows, "g string, k int, i int, v long")
    names = ["hot"] + [f"g{n}" for n in range(6)]
    dim = skewed.createDataFrame([(n, n.upper()) for n in names], "g string, name string")
    got = {(r.i, r.name) for r in lookup(big, dim, "g", how).collect()}
    want = {(i, g.upper() if g in names else None) for g, _, i, _ in rows}
    assert got == {w for w in want if how == "left" or w[1]}


def test_top_per_group_large_n_ranks_instead(skewed):
    rows = [("a" if i % 3 else "b", i) for i in range(4000)]
    df = skewed.createDataFrame(rows, "g string, i int")
    skewed.conf.set("spark.tandemlens.splitRows", "900")
    got = {(r.g, r.i) for r in top_per_group(df, ["g"], [F.col("i")], 1200).collect()}
    a = [r for r in rows if r[0] == "a"][:1200]
    b = [r for r in rows if r[0] == "b"][:1200]
    assert got == set(a + b)
    assert [r.i for r in first_n(df, 1500, "i").orderBy("i").collect()] == list(range(1500))


def test_average_precision_of_a_hot_query(skewed):
    rng = random.Random(3)
    rows = [("q", f"d{i}", rng.randrange(20) / 20, rng.randrange(3), i) for i in range(150)]
    rows += [("r", f"d{i}", 1.0 - i / 10, 0, i) for i in range(5)]
    df = skewed.createDataFrame(
        rows, "query_id string, doc_id string, score double, relevance int, pos int"
    )
    hits, total = 0, 0.0
    for n, r in enumerate(sorted(rows[:150], key=lambda r: -r[2]), 1):
        if r[3] > 0:
            hits += 1
            total += hits / n
    got = {r.query_id: r.ap for r in ranking.average_precision(df).collect()}
    assert got["q"] == pytest.approx(total / hits)
    assert got["r"] == 0.0


def test_children_of_a_hot_parent_come_in_parts(skewed):
    parents = skewed.createDataFrame([("p",), ("lonely",)], "id string")
    children = skewed.createDataFrame([("p", i, f"c{i}") for i in range(25)], "id string, n int, c string")
    rows = qa.attach_children(parents, children, "id", "n", "kids", part_rows=10).collect()
    lists = {(r.id, r.part): [k.c for k in r.kids] for r in rows}
    assert lists[("lonely", 0)] == []
    assert [len(lists[("p", i)]) for i in range(3)] == [10, 10, 5]
    assert sum((lists[("p", i)] for i in range(3)), []) == [f"c{i}" for i in range(25)]


def test_break_after_batch_keeps_one_row_of_every_later_file(spark):
    rows = [(f"f{f}", f * 10 + i) for f in range(4) for i in range(10)]
    df = spark.createDataFrame(rows, "file string, i int")
    kept = [r.i for r in break_after_batch(df, "file", F.col("i"), 15).orderBy("i").collect()]
    done, want = 0, []
    for f in range(4):
        for i in range(10):
            want.append(f * 10 + i)
            done += 1
            if done >= 15:
                break
    assert kept == want


def test_top_per_group_writes_about_twice_n(spark, monkeypatch):
    """Not every row of a group goes through the shuffle and to disk for its first n."""
    written = []
    plain = ordered.durable
    monkeypatch.setattr(ordered, "durable", lambda df, name: written.append((name, df.count())) or plain(df, name))
    df = spark.range(20_000).select(F.lit("g").alias("g"), F.col("id"))
    assert sorted(r.id for r in top_per_group(df, ["g"], [F.col("id")], 1500).collect()) == list(range(1500))
    assert max(n for name, n in written if name == "first-rows") <= 3000


@pytest.mark.parametrize("prune", [2, 10, 30])
def test_top_per_group_with_uneven_places(spark, monkeypatch, prune):
    monkeypatch.setattr(ordered, "PRUNE_ROWS", prune)
    df = spark.range(900).select((F.col("id") % 7).alias("g"), F.col("id"))
    got = sorted((r.g, r.id, r["rank"]) for r in top_per_group(df, ["g"], [F.col("id")], 60).collect())
    assert got == [(g, g + 7 * i, i + 1) for g in range(7) for i in range(60)]


@pytest.mark.parametrize("n", [3, 40, 10_000])
def test_first_pairs_when_first_queries_have_none(spark, n):
    """Queries without a judgement or with a missing passage give no pair; later ones do."""
    rows = [(q, f"t{q}", None if q % 2 else "even") for q in range(400)]
    queries = spark.createDataFrame(rows, "query_id int, text string, dataset string")
    judged = [(q, d, q * d % 3) for q in range(100, 400) for d in range(q % 4)]
    qrels = spark.createDataFrame(judged, "query_id int, doc_id int, relevance int")
    corpus = spark.createDataFrame([(0, "a"), (2, None)], "doc_id int, text string")
    got = qa.first_retrieval_pairs(queries, qrels, corpus, "dataset", n).collect()
    want = []
    for name in (None, "even"):
        own = [j for j in sorted(judged) if j[1] != 1 and rows[j[0]][2] == name]
        want += [(name, *j) for j in own[:n]]
    assert sorted(map(str, want)) == sorted(str((r.dataset, r.query_id, r.passage_id, r.relevance)) for r in got)


@pytest.mark.parametrize("rows", [50, 600, 5000])
def test_ranked_lists_dealt_by_query(spark, monkeypatch, rows):
    """Some, all or no queries have more rows than a task is to hold."""
    monkeypatch.setattr(inputs, "TASK_ROWS", rows)
    con = connect(DATA)
    for name in ("topk_per_query", "recall_at_100"):
        problem, _, _ = compare(spark, con, name, queries()[name], oracle_sql()[name], DATA)
        assert problem is None, problem


def test_top_k_of_ranked_lists_takes_one_shuffle(spark, monkeypatch):
    monkeypatch.setattr(inputs, "TASK_ROWS", 5000)
    plan = ranking.top_k(inputs.ranked(spark, DATA), 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
