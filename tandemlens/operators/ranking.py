"""Ranked retrieval metrics over (query_id, doc_id, score, relevance, pos) rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandemlens.functions.vectors import ratio
from tandemlens.operators.ordered import running_totals, top_per_group

KS = (1, 5, 10, 20)


def score_order() -> list[Column]:
    """Best score first; equal scores keep their input order."""
    return [-F.col("score"), F.col("pos")]


def top_k(ranked: DataFrame, k: int) -> DataFrame:
    return top_per_group(ranked, ["query_id"], score_order(), k)


def _gain(relevance: Column) -> Column:
    return F.pow(F.lit(2.0), relevance) - 1


def per_query_at_k(ranked: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """precision, recall and ndcg per query and k, shuffling at most k rows and grade counts.

    Recall divides by the relevant rows among those retrieved. The ideal ranking
    needs no sort: it follows from how many rows each relevance grade has.
    """
    deepest = max(ks)
    rank = F.col("rank")
    discount = F.log2(rank + 1)
    found = top_k(ranked, deepest).groupBy("query_id").agg(
        *[F.count_if((rank <= k) & (F.col("relevance") > 0)).alias(f"hits_{k}") for k in ks],
        *[
            F.sum(F.when(rank <= k, _gain(F.col("relevance")) / discount).otherwise(0.0)).alias(
                f"dcg_{k}"
            )
            for k in ks
        ],
    )
    grades = ranked.groupBy("query_id", "relevance").agg(F.count("*").alias("n"))
    relevant = grades.groupBy("query_id").agg(
        F.sum(F.when(F.col("relevance") > 0, F.col("n")).otherwise(0)).alias("n_relevant")
    )
    best = top_per_group(grades, ["query_id"], [F.col("relevance").desc()], deepest, "grade_rank")
    upto = Window.partitionBy("query_id").orderBy("grade_rank")
    ends = best.withColumn(
        "end", F.sum("n").over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    prefix = [0.0]
    for i in range(1, deepest + 1):
        prefix.append(prefix[-1] + 1.0 / math.log2(i + 1))
    table = F.array(*[F.lit(x) for x in prefix])

    def discounts(places: Column, k: int) -> Column:
        return F.element_at(table, (F.least(places, F.lit(k)) + 1).cast("int"))

    ideal = ends.groupBy("query_id").agg(
        *[
            F.sum(
                _gain(F.col("relevance"))
                * (discounts(F.col("end"), k) - discounts(F.col("end") - F.col("n"), k))
            ).alias(f"idcg_{k}")
            for k in ks
        ]
    )
    joined = found.join(relevant, "query_id").join(ideal, "query_id")
    rows = F.array(
        *[
            F.struct(
                F.lit(k).alias("k"),
                (F.col(f"hits_{k}") / k).alias("precision"),
                ratio(F.col(f"hits_{k}"), F.col("n_relevant")).alias("recall"),
                ratio(F.col(f"dcg_{k}"), F.col(f"idcg_{k}")).alias("ndcg"),
            )
            for k in ks
        ]
    )
    return joined.select("query_id", F.inline(rows))


def metrics_at_k(ranked: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """Macro mean over queries."""
    return per_query_at_k(ranked, ks).groupBy("k").agg(
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        F.avg("ndcg").alias("ndcg"),
    )


def average_precision(ranked: DataFrame) -> DataFrame:
    """Average precision per query over everything retrieved; 0 without relevant rows."""
    hit = (F.col("relevance") > 0).cast("long")
    ordered = running_totals(ranked, ["query_id"], score_order(), sums={"hits": hit})
    return ordered.groupBy("query_id").agg(
        ratio(
            F.sum(F.when(F.col("relevance") > 0, F.col("hits") / F.col("rank")).otherwise(0.0)),
            F.count_if(F.col("relevance") > 0),
        ).alias("ap")
    )


def mean_average_precision(ranked: DataFrame) -> DataFrame:
    return average_precision(ranked).agg(F.avg("ap").alias("map"))


def first_hits(ranked: DataFrame, ks: Sequence[int] = (1, 3, 10)) -> DataFrame:
    """(query_id, reciprocal_rank, hits_k ...): where the first relevant row of each query stands.

    Ranks are counted over all rows of a query; one without relevant rows gets zeros.
    """
    placed = running_totals(ranked, ["query_id"], score_order(), rank="rank")
    first = F.min(F.when(F.col("relevance") > 0, F.col("rank")))
    found = placed.groupBy("query_id").agg(first.alias("first"))
    hits = [F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0)).alias(f"hits_{k}") for k in ks]
    reciprocal = F.coalesce(1.0 / F.col("first"), F.lit(0.0))
    return found.select("query_id", reciprocal.alias("reciprocal_rank"), *hits)


def mean_reciprocal_rank(ranked: DataFrame, ks: Sequence[int] = (1, 3, 10)) -> DataFrame:
    """mrr and hits@k, means over queries."""
    return first_hits(ranked, ks).agg(
        F.avg("reciprocal_rank").alias("mrr"), *[F.avg(f"hits_{k}").alias(f"hits_{k}") for k in ks]
    )


def full_recall_at(ranked: DataFrame, k: int = 100) -> DataFrame:
    """Mean over queries of the share of all relevant rows that stand among the first k."""
    found = top_k(ranked, k).groupBy("query_id").agg(F.count_if(F.col("relevance") > 0).alias("found"))
    every = ranked.groupBy("query_id").agg(F.count_if(F.col("relevance") > 0).alias("relevant"))
    both = every.join(found, "query_id", "left")
    return both.agg(F.avg(ratio(F.coalesce("found", F.lit(0)), F.col("relevant"))).alias(f"recall_{k}"))
