"""Extension: measures between two vector spaces, for statistics that are specified on paper only."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandemlens.operators import representation
from tandemlens.plans.catalog import query, rounded
from tandemlens.plans.neural import PAIRS_SQL, _pairs
from tandemlens.sources.tables import table


def _lines(spark, root):
    """Two measures a line beside two others."""
    number = lambda *names: F.array(*[F.col(n).cast("double") for n in names])
    return table(spark, root, "lineitem").select(
        "l_returnflag",
        "l_orderkey",
        number("l_quantity", "l_discount").alias("x"),
        number("l_extendedprice", "l_tax").alias("y"),
    )


@query(
    f"""
WITH z AS (SELECT vec_id, unnest(range(128)) AS i, unnest(list_concat(kg, dense)) AS v FROM {PAIRS_SQL}),
c AS (SELECT vec_id, i, v - avg(v) OVER (PARTITION BY i) AS v FROM z),
g AS (SELECT a.i, b.i AS j, sum(a.v * b.v) AS s FROM c a JOIN c b USING (vec_id) GROUP BY a.i, b.i)
SELECT (SELECT count(*) FROM embeddings) AS n,
  round(sum(s * s) FILTER (i < 64 AND j >= 64)
    / sqrt(sum(s * s) FILTER (i < 64 AND j < 64) * sum(s * s) FILTER (i >= 64 AND j >= 64)), 6) AS cka,
  round(pow(sum(s) FILTER (i = j), 2) / sum(s * s), 6) AS effective_rank FROM g"""
)
def representation_cka(spark, root):
    """Linear CKA of graph and dense vectors, and the effective rank of both together."""
    return rounded(representation.representation_report(_pairs(spark, root), "kg", "dense").select("n", "cka", "effective_rank"))


_CROSS = ", ".join(
    f"covar_pop({a}, {b}) AS {name}"
    for name, a, b in (
        ("a", "l_quantity", "l_quantity"),
        ("b", "l_quantity", "l_discount"),
        ("c", "l_discount", "l_discount"),
        ("d", "l_extendedprice", "l_extendedprice"),
        ("e", "l_extendedprice", "l_tax"),
        ("f", "l_tax", "l_tax"),
        ("p", "l_quantity", "l_extendedprice"),
        ("q", "l_quantity", "l_tax"),
        ("r", "l_discount", "l_extendedprice"),
        ("s", "l_discount", "l_tax"),
    )
)


@query(
    f"""
WITH m AS (SELECT l_returnflag, count(*) AS n, {_CROSS} FROM lineitem GROUP BY l_returnflag),
t AS (SELECT l_returnflag, n, (c * (f * p * p - 2 * e * p * q + d * q * q)
    - 2 * b * (f * p * r - e * p * s - e * q * r + d * q * s) + a * (f * r * r - 2 * e * r * s + d * s * s))
    / ((a * c - b * b) * (d * f - e * e)) AS t, pow(p * s - q * r, 2) / ((a * c - b * b) * (d * f - e * e)) AS det FROM m)
SELECT l_returnflag, n, round(sqrt((t + sqrt(t * t - 4 * det)) / 2), 6) AS first,
  round(sqrt((t - sqrt(t * t - 4 * det)) / 2), 6) AS second FROM t"""
)
def canonical_correlations(spark, root):
    found = representation.representation_report(_lines(spark, root), "x", "y", ["l_returnflag"])
    both = F.col("canonical_correlations")
    return rounded(found.select("l_returnflag", "n", both[0].alias("first"), both[1].alias("second")))


def _ridge_sql(x: tuple[str, str], y: tuple[str, str], name: str) -> str:
    """Closed-form ridge with two inputs, and its predictions row by row on the other fold."""
    (x1, x2), (y1, y2) = x, y
    cross = lambda u, v: f"(count(*) * covar_pop({u}, {v}))"
    return f"""(
  WITH m AS (SELECT l_returnflag, {cross(x1, x1)} + 1 AS a, {cross(x1, x2)} AS b, {cross(x2, x2)} + 1 AS c,
    {cross(x1, y1)} AS p, {cross(x1, y2)} AS q, {cross(x2, y1)} AS r, {cross(x2, y2)} AS s,
    avg({x1}) AS x1, avg({x2}) AS x2, avg({y1}) AS y1, avg({y2}) AS y2
    FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY l_returnflag),
  t AS (SELECT l_returnflag, avg({y1}) AS t1, avg({y2}) AS t2 FROM lineitem WHERE l_orderkey % 5 = 0 GROUP BY l_returnflag),
  e AS (SELECT l_returnflag,
    {y1} - m.y1 - ((c * p - b * r) * ({x1} - m.x1) + (a * r - b * p) * ({x2} - m.x2)) / (a * c - b * b) AS e1,
    {y2} - m.y2 - ((c * q - b * s) * ({x1} - m.x1) + (a * s - b * q) * ({x2} - m.x2)) / (a * c - b * b) AS e2,
    {y1} - t1 AS o1, {y2} - t2 AS o2 FROM lineitem JOIN m USING (l_returnflag) JOIN t USING (l_returnflag)
    WHERE l_orderkey % 5 = 0)
  SELECT l_returnflag, count(*) AS n_test, round(1 - sum(e1 * e1 + e2 * e2) / sum(o1 * o1 + o2 * o2), 6) AS {name}
  FROM e GROUP BY l_returnflag)"""


_X, _Y = ("l_quantity", "l_discount"), ("l_extendedprice", "l_tax")


@query(
    f"""
SELECT l_returnflag, (SELECT count(*) FROM lineitem l WHERE l.l_returnflag = f.l_returnflag AND l_orderkey % 5 <> 0) AS n_train,
  n_test, x_to_y, y_to_x FROM {_ridge_sql(_X, _Y, "x_to_y")} f
JOIN {_ridge_sql(_Y, _X, "y_to_x")} g USING (l_returnflag, n_test)"""
)
def cross_predictability(spark, root):
    """Ridge regression each way, fitted to four fifths of the orders and judged on the rest."""
    held_out = F.col("l_orderkey") % 5 == 0
    return rounded(representation.cross_predictability(_lines(spark, root), "x", "y", held_out, ["l_returnflag"]))


def _information_sql(x: str, y: str) -> str:
    edge = lambda c: f"quantile_disc({c}, [{', '.join(f'{i / 8}' for i in range(1, 8))}])"
    return f"""
WITH e AS (SELECT l_returnflag, {edge(x)} AS ex, {edge(y)} AS ey FROM lineitem GROUP BY l_returnflag),
b AS (SELECT l_returnflag, len(list_filter(ex, lambda v: v < {x})) AS bx, len(list_filter(ey, lambda v: v < {y})) AS yb
  FROM lineitem JOIN e USING (l_returnflag)),
j AS (SELECT l_returnflag, bx, yb, count(*)::DOUBLE AS c FROM b GROUP BY ALL),
m AS (SELECT *, sum(c) OVER (PARTITION BY l_returnflag) AS n, sum(c) OVER (PARTITION BY l_returnflag, bx) AS cx,
  sum(c) OVER (PARTITION BY l_returnflag, yb) AS cy FROM j)
SELECT l_returnflag, sum(c)::BIGINT AS n, count(*) AS cells, round(sum(c / n * ln(c * n / (cx * cy))), 6) AS mutual_information,
  round(sum(c / n * ln(c * n / (cx * cy)))
    - (count(*) - count(DISTINCT bx) - count(DISTINCT yb) + 1) / (2e0 * sum(c)), 6) AS corrected
FROM m GROUP BY l_returnflag"""


@query(_information_sql("l_quantity", "l_extendedprice"))
def mutual_information(spark, root):
    lines = table(spark, root, "lineitem")
    return rounded(representation.mutual_information(lines, "l_quantity", "l_extendedprice", ["l_returnflag"]))


@query(_information_sql("l_discount", "l_tax"))
def mutual_information_few_values(spark, root):
    """Eleven and nine values in eight bins: each fills one bin or several."""
    lines = table(spark, root, "lineitem")
    return rounded(representation.mutual_information(lines, "l_discount", "l_tax", ["l_returnflag"]))
