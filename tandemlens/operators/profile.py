"""Counts, length statistics and distinct counts over corpora."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandemlens.functions.arrays import any_answer
from tandemlens.functions.text import is_blank, word_count
from tandemlens.operators.ordered import top_per_group


def length_columns(text: Column, name: str) -> list[Column]:
    """Mean and population standard deviation of the word count, 0 for empty input."""
    n = word_count(text)
    return [
        F.coalesce(F.avg(n), F.lit(0.0)).alias(f"avg_{name}_length"),
        F.coalesce(F.stddev_pop(n), F.lit(0.0)).alias(f"{name}_length_std"),
    ]


def count_non_blank(df: DataFrame, text: str) -> DataFrame:
    return df.agg(
        F.count("*").alias("lines"), F.count_if(~is_blank(F.col(text))).alias("examples")
    )


def distinct_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Exact number of distinct non-null values per column, in one row per group.

    Each column is reduced to its distinct values first, so a value that fills
    a third of the rows never leaves the map side more than once per task. A group whose
    values are all null, or whose key is, keeps its row.
    """
    keys = list(by)

    def short(c: str) -> Column:
        # Long texts are told apart by their digest, so that they are not shuffled whole.
        text = F.col(c).cast("string")
        return F.when(F.length(text) > 64, F.concat(F.lit("\0"), F.sha2(text, 256))).otherwise(text)

    values = [F.struct(F.lit(c).alias("name"), short(c).alias("v")) for c in columns]
    tall = df.select(*keys, F.inline(F.array(*values))).distinct()
    return tall.groupBy(*keys).agg(
        *[F.count_if((F.col("name") == c) & F.col("v").isNotNull()).alias(f"unique_{c}") for c in columns]
    )


def most_common(df: DataFrame, value: str, pos: Column, n: int = 10) -> DataFrame:
    """The `n` most frequent values; equal counts keep the order of first appearance."""
    counts = df.groupBy(value).agg(F.count("*").alias("count"), F.min(pos).alias("_first"))
    return counts.orderBy(F.desc("count"), "_first").limit(n).drop("_first")


def first_rows(df: DataFrame, groups: Sequence[str], order: Column, n: int) -> DataFrame:
    """The first `n` rows of every file or split."""
    return top_per_group(df, groups, [order], n, "sample_no")


def qa_quality(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per split: sizes, question length and how many answers the examples have."""
    short, long = F.col("short_answers"), F.col("long_answers")
    return df.groupBy(*by).agg(
        F.count("*").alias("total_examples"),
        F.avg(word_count("question")).alias("avg_question_length"),
        F.count_if(F.size(short) > 0).alias("examples_with_short_answers"),
        F.count_if(F.size(long) > 0).alias("examples_with_long_answers"),
        F.avg(F.size(short)).alias("avg_short_answers_per_example"),
        F.avg(F.size(long)).alias("avg_long_answers_per_example"),
    )


def qa_profile(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per split: question and answer lengths, distinct questions, questions with answers.

    Answer statistics come from sums over each row's answers, so nothing is exploded.
    """
    counts = F.transform(F.filter("answers", lambda a: a != ""), lambda a: word_count(a))
    summed = F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)
    squares = F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)
    rows = df.select(
        *by,
        "question",
        word_count("question").alias("_q"),
        F.size(counts).alias("_n"),
        summed.alias("_s"),
        squares.alias("_s2"),
        any_answer(F.col("answers")).alias("_ok"),
    )
    n = F.sum("_n")
    mean = F.when(n > 0, F.sum("_s") / n).otherwise(0.0)
    variance = F.when(n > 0, F.sum("_s2") / n).otherwise(0.0) - mean * mean
    stats = rows.groupBy(*by).agg(
        F.coalesce(F.avg("_q"), F.lit(0.0)).alias("avg_question_length"),
        F.coalesce(F.stddev_pop("_q"), F.lit(0.0)).alias("question_length_std"),
        mean.alias("avg_answer_length"),
        F.sqrt(F.greatest(variance, F.lit(0.0))).alias("answer_length_std"),
        F.count_if("_ok").alias("questions_with_answers"),
    )
    return join_groups(stats, distinct_counts(df, ["question"], by), by)


def join_groups(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join two tables of one row per group on `by`, null groups included."""
    if not by:
        return left.crossJoin(right)  # one row each
    own = right.withColumnsRenamed({k: f"_{k}" for k in by})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by])
    return left.join(own, same).drop(*[f"_{k}" for k in by])


def kg_profile(triples: DataFrame) -> DataFrame:
    """Number of triples and of distinct heads, relations and tails."""
    unique = distinct_counts(triples, ["head", "relation", "tail"])
    total = triples.agg(F.count("*").alias("n")).scalar()
    return unique.select(total.alias("num_triples"), "*")
