"""Profiling queries: counts, lengths, distincts and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandemlens.functions.arrays import any_answer
from tandemlens.functions.text import shorten, word_count
from tandemlens.operators import profile
from tandemlens.plans.catalog import query, rnd, rounded
from tandemlens.plans.inputs import QA_SQL, TRIPLES_SQL, documents, qa_examples, qa_turns, triples
from tandemlens.sources.tables import table


def wc_sql(col: str) -> str:
    return f"len(list_filter(regexp_split_to_array({col}, '\\s+'), lambda x: x <> ''))"


@query(
    f"""
SELECT lang, count(*) AS num_examples, round(avg(w), 6) AS avg_text_length,
  round(stddev_pop(w), 6) AS text_length_std
FROM (SELECT lang, {wc_sql("text")} AS w FROM documents) GROUP BY lang"""
)
def text_length_profile(spark, root):
    docs = documents(spark, root, "lang", "text")
    lengths = profile.length_columns(F.col("text"), "text")
    return rounded(docs.groupBy("lang").agg(F.count("*").alias("num_examples"), *lengths))


@query(
    """
SELECT count(DISTINCT text) AS unique_text, count(DISTINCT lang) AS unique_lang,
  count(DISTINCT source) AS unique_source FROM documents"""
)
def distinct_profile(spark, root):
    docs = table(spark, root, "documents")
    return profile.distinct_counts(docs, ["text", "lang", "source"])


@query("SELECT count(*) AS lines, count(*) FILTER (trim(html) <> '') AS examples FROM pages")
def non_blank_count(spark, root):
    return profile.count_non_blank(table(spark, root, "pages"), "html")


@query(
    """
SELECT coalesce(lang, 'total') AS split, count(*) AS examples FROM documents
GROUP BY ROLLUP (lang)"""
)
def split_counts(spark, root):
    rolled = table(spark, root, "documents").rollup("lang").agg(F.count("*").alias("examples"))
    return rolled.select(F.coalesce("lang", F.lit("total")).alias("split"), "examples")


@query(
    f"""
SELECT split, count(*) AS total_examples, count(answer) AS with_answers,
  count(*) FILTER (answer LIKE '%.%') AS with_passages,
  round(avg({wc_sql("question")}), 6) AS avg_question_length,
  round(avg((answer IS NOT NULL)::int), 6) AS avg_answers_per_question
FROM {QA_SQL} GROUP BY split"""
)
def conditional_counts(spark, root):
    qa = qa_examples(spark, root)
    return rounded(
        qa.groupBy("split").agg(
            F.count("*").alias("total_examples"),
            F.count_if(F.size("answers") > 0).alias("with_answers"),
            F.count_if(F.exists("answers", lambda a: F.contains(a, F.lit(".")))).alias(
                "with_passages"
            ),
            F.avg(word_count("question")).alias("avg_question_length"),
            F.avg(F.size("answers")).alias("avg_answers_per_question"),
        )
    )


@query(
    f"""
SELECT split, round(avg(q), 6) AS avg_question_length,
  round(stddev_pop(q), 6) AS question_length_std,
  round(coalesce(avg(a), 0), 6) AS avg_answer_length,
  round(coalesce(stddev_pop(a), 0), 6) AS answer_length_std,
  count(*) FILTER (trim(answer) <> '') AS questions_with_answers,
  count(DISTINCT question) AS unique_question
FROM (SELECT *, {wc_sql("question")} AS q, {wc_sql("answer")} AS a FROM {QA_SQL}) GROUP BY split"""
)
def qa_profile(spark, root):
    return rounded(profile.qa_profile(qa_examples(spark, root), ["split"]))


@query(
    f"""
SELECT split, count(*) AS total_examples,
  round(avg({wc_sql("question")}), 6) AS avg_question_length,
  count(*) FILTER (answer IS NOT NULL AND {wc_sql("answer")} <= 20)
    AS examples_with_short_answers,
  count(*) FILTER (answer IS NOT NULL AND {wc_sql("answer")} > 20) AS examples_with_long_answers,
  round(avg((answer IS NOT NULL AND {wc_sql("answer")} <= 20)::int), 6)
    AS avg_short_answers_per_example,
  round(avg((answer IS NOT NULL AND {wc_sql("answer")} > 20)::int), 6)
    AS avg_long_answers_per_example
FROM {QA_SQL} GROUP BY split"""
)
def nq_quality(spark, root):
    """Answers of up to 20 words are short answers, the others long ones."""
    qa = qa_examples(spark, root).select(
        "split",
        "question",
        F.filter("answers", lambda a: word_count(a) <= 20).alias("short_answers"),
        F.filter("answers", lambda a: word_count(a) > 20).alias("long_answers"),
    )
    return rounded(profile.qa_quality(qa, ["split"]))


@query(
    """
SELECT c_mktsegment AS relation, count(*) AS count FROM customer GROUP BY 1
ORDER BY 2 DESC, min(c_custkey) LIMIT 10"""
)
def relation_histogram_top10(spark, root):
    facts = table(spark, root, "customer").select(
        F.col("c_mktsegment").alias("relation"), "c_custkey"
    )
    return profile.most_common(facts, "relation", F.col("c_custkey"))


@query(
    """
SELECT l_partkey AS part, count(*) AS count FROM lineitem GROUP BY 1
ORDER BY 2 DESC, min(l_orderkey * 10 + l_linenumber), 1 LIMIT 10"""
)
def part_histogram_top10(spark, root):
    """Most frequent value of a wide key, ties by first appearance."""
    facts = table(spark, root, "lineitem").select(
        F.col("l_partkey").alias("part"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
    )
    counts = facts.groupBy("part").agg(F.count("*").alias("count"), F.min("pos").alias("first"))
    return counts.orderBy(F.desc("count"), "first", "part").limit(10).drop("first")


@query(
    f"""
SELECT count(*) AS num_triples, count(DISTINCT head) AS unique_head,
  count(DISTINCT relation) AS unique_relation, count(DISTINCT tail) AS unique_tail
FROM {TRIPLES_SQL}"""
)
def kg_profile(spark, root):
    return profile.kg_profile(triples(spark, root))


FILES_SQL = f"""(
  SELECT CASE WHEN lang IN ('en', 'fr') THEN 'qa' ELSE 'ir' END AS task, lang AS dataset,
         source AS split, count(*) AS num_examples, sum(n_chars) / 1048576e0 AS size_mb,
         avg({wc_sql("text")}) AS avg_length
  FROM documents GROUP BY ALL)"""


def _files(spark, root):
    """One row per (task, dataset, split), as a file profile would have it."""
    task = F.when(F.col("lang").isin("en", "fr"), "qa").otherwise("ir")
    return (
        documents(spark, root, "lang", "source", "n_chars", "text")
        .groupBy(task.alias("task"), F.col("lang").alias("dataset"), F.col("source").alias("split"))
        .agg(
            F.count("*").alias("num_examples"),
            (F.sum("n_chars") / 1048576.0).alias("size_mb"),
            F.avg(word_count("text")).alias("avg_length"),
        )
    )


@query(
    f"""
SELECT task, count(DISTINCT dataset) AS count, cast(sum(num_examples) AS bigint) AS examples,
  round(sum(size_mb), 6) AS size_mb FROM {FILES_SQL} GROUP BY task"""
)
def task_rollup(spark, root):
    datasets = _files(spark, root).groupBy("task", "dataset").agg(
        F.sum("num_examples").alias("examples"), F.sum("size_mb").alias("size_mb")
    )
    return rounded(
        datasets.groupBy("task").agg(
            F.count("*").alias("count"),
            F.sum("examples").alias("examples"),
            F.sum("size_mb").alias("size_mb"),
        )
    )


@query(
    f"""
SELECT dataset, count(*) AS num_splits, cast(sum(num_examples) AS bigint) AS total_examples,
  round(sum(size_mb), 6) AS total_size_mb, round(avg(avg_length), 6) AS avg_length
FROM {FILES_SQL} GROUP BY dataset"""
)
def unweighted_mean_of_means(spark, root):
    """Totals over files, and the mean of the per-file means, each file counting once."""
    return rounded(
        _files(spark, root)
        .groupBy("dataset")
        .agg(
            F.count("*").alias("num_splits"),
            F.sum("num_examples").alias("total_examples"),
            F.sum("size_mb").alias("total_size_mb"),
            F.avg("avg_length").alias("avg_length"),
        )
    )


@query(
    f"""
SELECT source AS split, count(*) AS num_samples, round(avg(w), 6) AS avg_text_length,
  round(stddev_pop(w), 6) AS text_length_std FROM (
  SELECT source, {wc_sql("text")} AS w,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents)
WHERE r <= 3 GROUP BY source"""
)
def sample_profile(spark, root):
    """Statistics of the first three examples of every split."""
    samples = profile.first_rows(table(spark, root, "documents"), ["source"], F.col("doc_id"), 3)
    lengths = profile.length_columns(F.col("text"), "text")
    return rounded(
        samples.groupBy(F.col("source").alias("split")).agg(
            F.count("*").alias("num_samples"), *lengths
        )
    )


@query(
    f"""
SELECT head || ' -> ' || relation || ' -> ' || tail AS triple,
  upper(split) AS split, upper(substr(relation, 1, 1)) || replace(substr(relation, 2), '_', ' ')
  AS relation FROM {TRIPLES_SQL}"""
)
def display_triples(spark, root):
    """Triples as display text."""
    title = F.replace("relation", F.lit("_"), F.lit(" "))
    first = F.concat(F.upper(F.substring(title, 1, 1)), F.expr("substring(relation, 2)"))
    return triples(spark, root).select(
        F.concat_ws(" -> ", "head", "relation", "tail").alias("triple"),
        F.upper("split").alias("split"),
        F.replace(first, F.lit("_"), F.lit(" ")).alias("relation"),
    )


@query(
    f"""
SELECT example_id, CASE WHEN length(answer) > 200 THEN substr(answer, 1, 200) || '...'
  ELSE answer END AS passage FROM {QA_SQL} WHERE answer IS NOT NULL"""
)
def display_passages(spark, root):
    answered = qa_turns(spark, root).where(F.col("answer").isNotNull())
    return answered.select("example_id", shorten(F.col("answer")).alias("passage"))


@query(
    f"""
SELECT split, count(*) AS n, round(sum((trim(coalesce(answer, '')) <> '')::int) * 100e0
  / count(*), 4) AS answered_percent FROM {QA_SQL} GROUP BY split"""
)
def answered_share(spark, root):
    ok = any_answer(F.col("answers"))
    return qa_examples(spark, root).groupBy("split").agg(
        F.count("*").alias("n"),
        rnd(F.count_if(ok) * 100.0 / F.count("*"), 4).alias("answered_percent"),
    )
