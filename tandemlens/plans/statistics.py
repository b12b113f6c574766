"""Extension: significance queries, for statistics that are specified on paper only."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandemlens.functions.vectors import cosine
from tandemlens.operators import significance
from tandemlens.plans.catalog import query, rounded
from tandemlens.plans.evaluation import FLAGS_SQL
from tandemlens.plans.inputs import PREDICTIONS_SQL, predictions
from tandemlens.plans.neural import PAIRS_SQL, _pairs
from tandemlens.sources.tables import table


@query(
    f"""
SELECT task, count(*) AS n, count(*) FILTER (k AND NOT d) AS kg_only,
  count(*) FILTER (d AND NOT k) AS dense_only, count(*) FILTER (NOT k AND NOT d) AS both_wrong,
  count(*) FILTER (k AND d) AS both_right,
  count(*) FILTER (f AND NOT (k OR d)) AS hybrid_rescue,
  round(avg((f AND NOT (k OR d))::int), 6) AS complementarity_index,
  round(avg((k OR d)::int) - avg(f::int), 6) AS oracle_gap FROM {FLAGS_SQL} GROUP BY task"""
)
def complementarity_index(spark, root):
    return rounded(significance.complementarity_index(predictions(spark, root), ["task"]))


@query(
    f"""
SELECT task, count(*) FILTER (NOT k AND NOT d) AS shared_errors,
  count(*) FILTER (NOT k OR NOT d) AS all_errors,
  round(1 - count(*) FILTER (NOT k AND NOT d) / count(*) FILTER (NOT k OR NOT d), 6)
  AS error_complementarity FROM {FLAGS_SQL} GROUP BY task"""
)
def error_jaccard(spark, root):
    return rounded(significance.error_overlap(predictions(spark, root), ["task"]))


@query(
    f"""
WITH t AS (SELECT task, count(*) FILTER (k AND f) AS both_right,
    count(*) FILTER (k AND NOT f) AS only_first, count(*) FILTER (NOT k AND f) AS only_second,
    count(*) FILTER (NOT k AND NOT f) AS both_wrong FROM {FLAGS_SQL} GROUP BY task),
m AS (SELECT *, least(only_first, only_second) AS statistic, only_first + only_second AS n FROM t),
p AS (SELECT task, least(1e0, 2e0 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
    - n * ln(2))) - CASE WHEN 2 * max(statistic) = max(n) THEN max(exp(lgamma(n + 1)
    - 2 * lgamma(n / 2e0 + 1) - n * ln(2))) ELSE 0 END) AS p
  FROM (SELECT task, n, statistic, unnest(range(statistic + 1)) AS i FROM m) GROUP BY task)
SELECT m.task, both_right, only_first, only_second, both_wrong, statistic, round(p, 6) AS p_value
FROM m JOIN p USING (task)"""
)
def mcnemar_table(spark, root):
    return rounded(significance.mcnemar(predictions(spark, root), "kg", "fusion", ["task"]))


@query(
    f"""
SELECT task, count(*) AS n, round((avg(fusion) - avg(kg)) / sqrt((var_pop(fusion) + var_pop(kg))
  / 2), 6) AS cohens_d FROM {PREDICTIONS_SQL} GROUP BY task"""
)
def cohens_d(spark, root):
    return rounded(significance.cohens_d(predictions(spark, root), "fusion", "kg", ["task"]))


@query(
    f"""
WITH c AS (SELECT task, count(*) AS n, count(*) FILTER (NOT f) AS observed,
    count(*) FILTER (NOT k AND NOT d) AS shared FROM {FLAGS_SQL} GROUP BY task),
l AS (SELECT task, n, observed, i, lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
    + i * ln(shared / n) + (n - i) * ln(1 - shared / n) AS lp
  FROM (SELECT *, unnest(range(n + 1)) AS i FROM c)),
p AS (SELECT l.task, sum(exp(l.lp)) AS p FROM l JOIN l o ON o.task = l.task AND o.i = o.observed
  WHERE l.lp <= o.lp + 1e-7 GROUP BY l.task),
h AS (SELECT *, 2 * (asin(sqrt(observed / n)) - asin(sqrt(shared / n))) AS es FROM c)
SELECT h.task, n, observed, shared, round(es, 6) AS effect_size,
  round(least(p, 1e0), 6) AS p_value, p < 0.05 AS significant,
  CASE WHEN abs(es) > 0.8 THEN 'large' WHEN abs(es) > 0.5 THEN 'medium' ELSE 'small' END
  AS interpretation FROM h JOIN p USING (task)"""
)
def complementarity_test(spark, root):
    return rounded(significance.complementarity_test(predictions(spark, root), ["task"]))


def _uniform_sql(key: str) -> str:
    return f"(('0x' || substr(md5({key} || ':' || r), 1, 13))::bigint / 4503599627370496e0)"


_WEIGHT_SQL = " + ".join(
    f"({_uniform_sql('example_id')} >= {s!r}::double)::int" for s in significance.poisson_steps()
)


@query(
    f"""
WITH w AS (SELECT r, fusion, {_WEIGHT_SQL} AS w
  FROM {PREDICTIONS_SQL}, (SELECT unnest(range(1, 1001)) AS r)),
m AS (SELECT r, sum(w * fusion) / sum(w) AS m FROM w GROUP BY r)
SELECT round(quantile_cont(m, 0.025), 6) AS lower, round(quantile_cont(m, 0.975), 6) AS upper,
  count(*) AS replicates FROM m"""
)
def bootstrap_ci(spark, root):
    scored = predictions(spark, root)
    return rounded(significance.bootstrap_interval(scored, "example_id", "fusion"))


@query(
    f"""
WITH d AS (SELECT r, CASE WHEN {_uniform_sql('example_id')} >= 0.5 THEN fusion - kg ELSE 0 END AS x,
    fusion - kg AS y FROM {PREDICTIONS_SQL}, (SELECT unnest(range(1, 10001)) AS r)),
m AS (SELECT r, avg(x) AS x, avg(y) AS y FROM d GROUP BY r)
SELECT round(max(y), 6) AS observed_diff, round(avg((abs(x) >= abs(y))::int), 6) AS p_value FROM m"""
)
def randomization_test(spark, root):
    scored = predictions(spark, root)
    return rounded(significance.randomization_test(scored, "example_id", "kg", "fusion"))


@query(
    f"""
SELECT round(avg(c), 6) AS representation_similarity, round(1 - avg(c), 6) AS diversity_score
FROM (SELECT list_inner_product(kg, dense) / (sqrt(list_inner_product(kg, kg))
    * sqrt(list_inner_product(dense, dense))) AS c FROM {PAIRS_SQL})"""
)
def representation_similarity(spark, root):
    mean = F.avg(cosine(F.col("kg"), F.col("dense")))
    return rounded(
        _pairs(spark, root).agg(
            mean.alias("representation_similarity"), (1 - mean).alias("diversity_score")
        )
    )


@query(
    """
WITH e AS (SELECT event_type, event_id, sqrt(event_id * 7919 % 10007 + 1) / 110e0 AS p FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY p, event_id) AS i,
    count(*) OVER (PARTITION BY event_type) AS m FROM e)
SELECT event_type, event_id, round(p, 9) AS p, round(least(p * m, 1), 6) AS bonferroni,
  round(least(max((m - i + 1) * p) OVER (PARTITION BY event_type ORDER BY i), 1), 6) AS holm,
  round(least(min(p * m / i) OVER (PARTITION BY event_type ORDER BY i DESC), 1), 6)
  AS benjamini_hochberg FROM r"""
)
def adjusted_p_values(spark, root):
    """One made-up p-value per event, adjusted within its type."""
    p = F.sqrt(F.col("event_id") * 7919 % 10007 + 1) / 110.0  # irrational, so that no result is a half digit
    tests = table(spark, root, "events").select("event_type", "event_id", p.alias("p"))
    found = significance.adjusted_p_values(tests, "p", "event_id", ["event_type"])
    return rounded(found.withColumn("p", F.round("p", 9)), 9).withColumns(
        {c: F.round(c, 6) for c in ("bonferroni", "holm", "benjamini_hochberg")}
    )
