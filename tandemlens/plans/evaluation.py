"""Evaluation queries: classification, ranking and complementarity metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandemlens.functions.vectors import sigmoid
from tandemlens.operators import answers, binary, complementarity, ranking, tracking
from tandemlens.operators.ordered import running_totals
from tandemlens.plans.catalog import query, rnd, rounded
from tandemlens.plans.inputs import (
    LONG_PREDICTIONS_SQL,
    PREDICTIONS_SQL,
    RANKED_SQL,
    long_predictions,
    predictions,
    ranked,
)
from tandemlens.session import durable
from tandemlens.sources.tables import table

FLAGS_SQL = f"""(SELECT *, (kg > 0.5) = (label = 1) AS k, (dense > 0.5) = (label = 1) AS d,
    (fusion > 0.5) = (label = 1) AS f, (fusion_gated > 0.5) = (label = 1) AS g
    FROM {PREDICTIONS_SQL})"""


def _block_sql(keys: str = "") -> str:
    select, group = (f"{keys}, ", f"GROUP BY {keys}") if keys else ("", "")
    return f"""
WITH r AS (SELECT {select} avg(k::int) AS kg, avg(d::int) AS de, avg(f::int) AS fu,
    avg((k AND NOT d)::int) AS ko, avg((d AND NOT k)::int) AS do_, avg((k AND d)::int) AS b,
    avg((NOT k AND NOT d)::int) AS w, avg((k <> d)::int) AS c, avg((k OR d)::int) AS o
  FROM {FLAGS_SQL} {group})
SELECT {select} round(kg, 6) AS kg_accuracy, round(de, 6) AS dense_accuracy,
  round(fu, 6) AS fusion_accuracy, round(ko, 6) AS kg_only_correct_rate,
  round(do_, 6) AS dense_only_correct_rate, round(b, 6) AS both_correct_rate,
  round(w, 6) AS both_wrong_rate, round(c, 6) AS complementarity_score,
  round(o, 6) AS oracle_accuracy, round(fu - greatest(kg, de), 6) AS fusion_improvement,
  round(o - fu, 6) AS fusion_vs_oracle_gap
FROM r"""


@query(_block_sql())
def complementarity_block(spark, root):
    return rounded(complementarity.complementarity(predictions(spark, root)))


@query(_block_sql("task, step"))
def stepwise_complementarity(spark, root):
    return rounded(complementarity.complementarity(predictions(spark, root), ["task", "step"]))


@query(
    f"""
WITH r AS (SELECT avg(((kg > 0.5) = (dense > 0.5))::int) AS a, avg((k <> d)::int) AS c,
    avg(d::int) AS de, avg(k::int) AS kg, avg((k OR d)::int) AS o, avg(f::int) AS f1,
    avg(g::int) AS f2 FROM {FLAGS_SQL})
SELECT round(a, 6) AS dense_kg_agreement, round(c, 6) AS complementarity_ratio,
  round(de, 6) AS dense_accuracy, round(kg, 6) AS kg_accuracy, round(o, 6) AS oracle_accuracy,
  round(o - greatest(de, kg), 6) AS potential_improvement,
  round(greatest(f1, f2), 6) AS best_fusion_accuracy,
  round((f1 + f2) / 2, 6) AS avg_fusion_accuracy,
  round(greatest(f1, f2) - greatest(de, kg), 6) AS fusion_improvement FROM r"""
)
def experiment_complementarity(spark, root):
    fusions = ["fusion", "fusion_gated"]
    return rounded(complementarity.experiment_summary(predictions(spark, root), fusions))


@query(
    f"""
SELECT task, count(*) FILTER (k AND NOT d) AS kg_minus_dense,
  count(*) FILTER (d AND NOT k) AS dense_minus_kg, count(*) FILTER (k AND d) AS intersection,
  count(*) FILTER (NOT k AND NOT d) AS neither, count(*) FILTER (k OR d) AS union_size,
  count(*) FILTER (k <> d) AS symmetric_difference
FROM {FLAGS_SQL} GROUP BY task"""
)
def correct_set_algebra(spark, root):
    return complementarity.correct_sets(predictions(spark, root), ["task"])


@query(
    """
SELECT l.doc_id AS example_id, ((l.doc_id * 37 + 11) % 100) / 100e0 AS kg,
  (d.n_chars % 100) / 100e0 AS dense, l.quality::bigint AS label
FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""
)
def prediction_alignment(spark, root):
    """Score tables of two models joined to the labels by example id, not by position."""
    labels = table(spark, root, "labels").select(
        F.col("doc_id").alias("example_id"), F.col("quality").alias("label")
    )
    docs = table(spark, root, "documents")
    kg = docs.select(
        F.col("doc_id").alias("example_id"),
        (((F.col("doc_id") * 37 + 11) % 100) / 100.0).alias("score"),
    )
    dense = docs.select(
        F.col("doc_id").alias("example_id"), ((F.col("n_chars") % 100) / 100.0).alias("score")
    )
    aligned = complementarity.align([("kg", kg), ("dense", dense)], labels, "example_id")
    return aligned.select("example_id", "kg", "dense", "label")


BINARY_SQL = f"""
WITH c AS (SELECT model, count(*) AS n, count(*) FILTER ((score > 0.5) = (label = 1)) AS r,
    count(*) FILTER (score > 0.5 AND label = 1) AS tp,
    count(*) FILTER (score > 0.5 AND label = 0) AS fp,
    count(*) FILTER (score <= 0.5 AND label = 1) AS fn
  FROM {LONG_PREDICTIONS_SQL} GROUP BY model),
m AS (SELECT model, r / n AS accuracy,
    CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0e0 END AS p,
    CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0e0 END AS rc FROM c)
SELECT model, round(accuracy, 6) AS accuracy, round(p, 6) AS precision, round(rc, 6) AS recall,
  round(CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0e0 END, 6) AS f1 FROM m"""


@query(BINARY_SQL)
def binary_metrics(spark, root):
    scored = long_predictions(spark, root)
    return rounded(binary.binary_metrics(scored, "score", "label", ["model"]))


@query(
    f"""
WITH r AS (SELECT model, label,
    rank() OVER (PARTITION BY model ORDER BY score)
      + (count(*) OVER (PARTITION BY model, score) - 1) / 2e0 AS avg_rank
  FROM {LONG_PREDICTIONS_SQL}),
s AS (SELECT model, sum(avg_rank) FILTER (label = 1) AS ranks,
    count(*) FILTER (label = 1) * 1e0 AS p, count(*) FILTER (label = 0) * 1e0 AS q
  FROM r GROUP BY model)
SELECT model, round(CASE WHEN p * q > 0 THEN (ranks - p * (p + 1) / 2) / (p * q) ELSE 0e0 END, 6)
  AS auc FROM s"""
)
def roc_auc(spark, root):
    return rounded(binary.roc_auc(long_predictions(spark, root), "score", "label", ["model"]))


ORDERED_SQL = f"""(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos)
    AS rank, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC) AS ideal
  FROM {RANKED_SQL})"""


@query(
    f"""
WITH q AS (SELECT query_id, k, count(*) FILTER (rank <= k AND relevance > 0) AS hits,
    count(*) FILTER (relevance > 0) AS rel,
    sum(CASE WHEN rank <= k THEN (pow(2, relevance) - 1) / log2(rank + 1) ELSE 0 END) AS dcg,
    sum(CASE WHEN ideal <= k THEN (pow(2, relevance) - 1) / log2(ideal + 1) ELSE 0 END) AS idcg
  FROM {ORDERED_SQL}, (SELECT unnest([1, 5, 10, 20]) AS k) GROUP BY query_id, k)
SELECT k::bigint AS k, round(avg(hits / k), 6) AS precision,
  round(avg(CASE WHEN rel > 0 THEN hits / rel ELSE 0e0 END), 6) AS recall,
  round(avg(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0e0 END), 6) AS ndcg
FROM q GROUP BY k"""
)
def ir_metrics_at_k(spark, root):
    return rounded(ranking.metrics_at_k(durable(ranked(spark, root), "runs")))  # read twice


@query(
    f"""
WITH h AS (SELECT query_id, relevance, rank, sum((relevance > 0)::int)
    OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM {ORDERED_SQL}),
a AS (SELECT query_id, count(*) FILTER (relevance > 0) AS rel,
    sum(CASE WHEN relevance > 0 THEN hits / rank ELSE 0e0 END) AS s FROM h GROUP BY query_id)
SELECT round(avg(CASE WHEN rel > 0 THEN s / rel ELSE 0e0 END), 6) AS map FROM a"""
)
def ir_map(spark, root):
    runs = durable(ranked(spark, root), "runs")  # read twice: sizes, then ranks
    return rounded(ranking.mean_average_precision(runs))


@query(
    f"""SELECT query_id, doc_id, round(score, 6) AS score, relevance::bigint AS relevance, rank FROM {ORDERED_SQL}
WHERE rank <= 5"""
)
def topk_per_query(spark, root):
    best = ranking.top_k(ranked(spark, root), 5)
    return rounded(best.select("query_id", "doc_id", "score", "relevance", "rank"))


@query(
    """
SELECT task, count(*) AS n, sum(target)::bigint AS positives FROM (
  SELECT 'qa' AS task, quality AS target FROM labels
  UNION ALL SELECT 'ir', CASE l_returnflag WHEN 'N' THEN 0 ELSE 1 END FROM lineitem)
GROUP BY task"""
)
def task_dispatch(spark, root):
    """QA rows are judged by `labels`, IR rows by `relevance`."""
    qa = table(spark, root, "labels").select(
        F.lit("qa").alias("task"), F.col("quality").alias("labels"), F.lit(0).alias("relevance")
    )
    ir = table(spark, root, "lineitem").select(
        F.lit("ir").alias("task"),
        F.lit(0).alias("labels"),
        (F.col("l_returnflag") != "N").cast("int").alias("relevance"),
    )
    target = F.when(F.col("task") == "qa", F.col("labels")).otherwise(F.col("relevance"))
    rows = qa.unionByName(ir)
    return rows.groupBy("task").agg(F.count("*").alias("n"), F.sum(target).alias("positives"))


@query(
    f"""
SELECT model, count(*) AS n, count(*) FILTER (p > 0.5) AS positives,
  round(avg(((p > 0.5) = (label = 1))::int), 6) AS accuracy, round(avg(p), 6) AS mean_probability
FROM (SELECT model, label, 1e0 / (1e0 + exp(-(score - 0.5e0) * 4e0)) AS p
      FROM {LONG_PREDICTIONS_SQL}) GROUP BY model"""
)
def inference_threshold(spark, root):
    """Logits to probabilities to classes, with the sample-weighted accuracy."""
    p = sigmoid((F.col("score") - 0.5) * 4.0)
    scored = long_predictions(spark, root).withColumn("p", p)
    hit = binary.decide(F.col("p")) == F.col("label")
    return scored.groupBy("model").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("p") > 0.5).alias("positives"),
        rnd(F.avg(hit.cast("double"))).alias("accuracy"),
        rnd(F.avg("p")).alias("mean_probability"),
    )


@query(
    f"""
SELECT model, example_id, n_seen, right_ / n_seen AS running_accuracy FROM (
  SELECT model, example_id, row_number() OVER w AS n_seen,
    sum(((score > 0.5) = (label = 1))::int) OVER w AS right_
  FROM {LONG_PREDICTIONS_SQL} WINDOW w AS (PARTITION BY model ORDER BY example_id))"""
)
def running_accuracy(spark, root):
    """Accuracy over the samples seen so far: one exact division, so it needs no rounding."""
    hit = (binary.decide(F.col("score")) == F.col("label")).cast("long")
    seen = running_totals(
        long_predictions(spark, root),
        ["model"],
        [F.col("example_id")],
        sums={"right": hit},
        rank="n_seen",
    )
    accuracy = (F.col("right") / F.col("n_seen")).alias("running_accuracy")
    return seen.select("model", "example_id", "n_seen", accuracy)


@query(
    f"""
WITH m AS ({BINARY_SQL})
SELECT place, model, f1 FROM (
  SELECT row_number() OVER (ORDER BY f1 DESC, model) AS place, model, f1 FROM m)"""
)
def model_ranking(spark, root):
    """Models by F1, best first."""
    order = [-F.col("f1"), F.col("model")]
    board = running_totals(binary_metrics(spark, root), [], order, rank="place")
    return board.select("place", "model", "f1")


@query(
    f"""
WITH q AS (SELECT query_id, min(rank) FILTER (relevance > 0) AS first FROM {ORDERED_SQL} GROUP BY query_id)
SELECT round(avg(coalesce(1e0 / first, 0)), 6) AS mrr, round(avg(coalesce((first <= 1)::int, 0)), 6) AS hits_1,
  round(avg(coalesce((first <= 3)::int, 0)), 6) AS hits_3,
  round(avg(coalesce((first <= 10)::int, 0)), 6) AS hits_10 FROM q"""
)
def reciprocal_rank(spark, root):
    return rounded(ranking.mean_reciprocal_rank(ranked(spark, root)))


@query(
    f"""
WITH q AS (SELECT query_id, count(*) FILTER (relevance > 0 AND rank <= 100) AS f,
    count(*) FILTER (relevance > 0) AS n FROM {ORDERED_SQL} GROUP BY query_id)
SELECT round(avg(CASE WHEN n > 0 THEN f / n ELSE 0e0 END), 6) AS recall_100 FROM q"""
)
def recall_at_100(spark, root):
    return rounded(ranking.full_recall_at(ranked(spark, root), 100))


# An article stands between characters that are no letters, digits or underscores, of any script.
_NORMAL_SQL = r"""trim(regexp_replace(regexp_replace(
  ' ' || regexp_replace(regexp_replace(lower({x}), '[!-/:-@\\[-`{{-~]', '', 'g'), '\s', '  ', 'g') || ' ',
  '([^\p{{L}}\p{{M}}\p{{N}}_])(a|an|the)([^\p{{L}}\p{{M}}\p{{N}}_])', '\1 \3', 'g'), '\s+', ' ', 'g'))"""

ANSWERS_SQL = f"""(SELECT a.conv_id, a.turn, {_NORMAL_SQL.format(x="a.text")} AS gold, {_NORMAL_SQL.format(
    x="CASE a.conv_id % 3 WHEN 0 THEN lower(a.text) WHEN 1 THEN 'The ' || a.text || ' an end!' ELSE coalesce(q.text, '') END"
)} AS given FROM conversations a LEFT JOIN conversations q ON q.conv_id = a.conv_id AND q.turn = a.turn - 1
  WHERE a.role = 'assistant')"""


@query(
    f"""
WITH a AS (SELECT *, list_filter(string_split(gold, ' '), lambda w: w <> '') AS g,
    list_filter(string_split(given, ' '), lambda w: w <> '') AS w FROM {ANSWERS_SQL}),
gc AS (SELECT conv_id, turn, word, count(*) AS n FROM (SELECT conv_id, turn, unnest(g) AS word FROM a) GROUP BY ALL),
wc AS (SELECT conv_id, turn, word, count(*) AS n FROM (SELECT conv_id, turn, unnest(w) AS word FROM a) GROUP BY ALL),
s AS (SELECT conv_id, turn, sum(least(wc.n, gc.n)) AS shared FROM wc JOIN gc USING (conv_id, turn, word) GROUP BY conv_id, turn)
SELECT conv_id, turn, (gold = given)::int::double AS exact_match,
  round(CASE WHEN len(w) + len(g) = 0 THEN 1e0 ELSE 2e0 * coalesce(shared, 0) / (len(w) + len(g)) END, 6)
  AS token_f1 FROM a LEFT JOIN s USING (conv_id, turn)"""
)
def answer_em_f1(spark, root):
    """Whole assistant turns as right answers; as given ones their lower-cased copy, a longer copy, or the question."""
    turns = table(spark, root, "conversations")
    asked = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    gold = turns.where(F.col("role") == "assistant").join(asked, ["conv_id", "turn"], "left")
    kind, text = F.col("conv_id") % 3, F.col("text")
    given = (
        F.when(kind == 0, F.lower(text))
        .when(kind == 1, F.concat(F.lit("The "), text, F.lit(" an end!")))
        .otherwise(F.coalesce("question", F.lit("")))
    )
    pairs = gold.select("conv_id", "turn", text.alias("gold"), given.alias("given"))
    return rounded(answers.with_scores(pairs, "given", "gold").drop("given", "gold"))


@query(
    f"""
SELECT 'fusion' AS model, round(avg(((fusion > 0.5) = (label = 1))::int), 6) AS accuracy FROM {PREDICTIONS_SQL}
UNION ALL SELECT 'kg', round(avg(((kg > 0.5) = (label = 1))::int), 6) FROM {PREDICTIONS_SQL}"""
)
def model_by_name(spark, root):
    """Accuracy of the models named in a setting."""
    scored = predictions(spark, root)
    models = {m: F.col(m) for m in ("kg", "dense", "fusion")}
    hits = [
        F.avg((binary.decide(answers.model_score(models, m)) == F.col("label")).cast("double")).alias(m)
        for m in ("fusion", "kg")
    ]
    wide = scored.agg(*hits)
    return rounded(wide.unpivot([], ["fusion", "kg"], "model", "accuracy"))


@query(
    """
SELECT doc_id, 'a ' || lang || '|' || source || '|' AS texts, true AS answered FROM documents WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, '| ', false FROM documents WHERE doc_id % 2 = 1"""
)
def polymorphic_answers(spark, root):
    """Raw answer lists of strings, objects with a text, other objects and nulls."""
    some = F.concat(F.lit('["a '), "lang", F.lit('", {"text": "'), "source", F.lit('"}, {"other": 1}]'))
    raw = F.when(F.col("doc_id") % 2 == 0, some).otherwise(F.lit('[null, " "]'))
    rows = table(spark, root, "documents").select("doc_id", raw.alias("raw"))
    texts = F.array_join(answers.answer_texts(F.col("raw")), "|")
    return rows.select("doc_id", texts.alias("texts"), answers.has_answer(F.col("raw")).alias("answered"))


@query(
    f"""
WITH m AS ({BINARY_SQL})
SELECT model, 0::bigint AS place, '== ' || model || ' ==' AS line FROM m
UNION ALL SELECT model, 1, format('accuracy: {{:.4f}}', accuracy) FROM m
UNION ALL SELECT model, 2, format('precision: {{:.4f}}', precision) FROM m
UNION ALL SELECT model, 3, format('recall: {{:.4f}}', recall) FROM m
UNION ALL SELECT model, 4, format('f1: {{:.4f}}', f1) FROM m"""
)
def evaluation_report(spark, root):
    scored = long_predictions(spark, root)
    return tracking.evaluation_report(rounded(binary.binary_metrics(scored, "score", "label", ["model"])), "model")
