"""Model outputs, ranked lists, QA pairs and triples derived from the provided tables.

Each Spark frame has a SQL twin (`*_SQL`, a parenthesised subquery), so the
queries and their checks start from the same rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemlens.functions.text import words
from tandemlens.operators.ordered import by_group, hot_groups
from tandemlens.session import durable
from tandemlens.sources.tables import spread, table

PREDICTIONS_SQL = """(
  SELECT *, (kg + dense) / 2e0 AS fusion, (kg + 3e0 * dense) / 4e0 AS fusion_gated FROM (
    SELECT d.doc_id AS example_id, d.lang AS task,
           cast(replace(d.source, 'src', '') AS bigint) AS step,
           ((d.doc_id * 37 + 11) % 100) / 100e0 AS kg, (d.n_chars % 100) / 100e0 AS dense,
           l.quality AS label
    FROM labels l JOIN documents d ON d.doc_id = l.doc_id))"""


def predictions(spark: SparkSession, root: str) -> DataFrame:
    """Scores of four models per labelled document; the language is the task."""
    docs = table(spark, root, "documents").select("doc_id", "lang", "source", "n_chars")
    scored = table(spark, root, "labels").join(docs, "doc_id")
    return scored.select(
        F.col("doc_id").alias("example_id"),
        F.col("lang").alias("task"),
        F.replace("source", F.lit("src"), F.lit("")).cast("long").alias("step"),
        (((F.col("doc_id") * 37 + 11) % 100) / 100.0).alias("kg"),
        ((F.col("n_chars") % 100) / 100.0).alias("dense"),
        F.col("quality").alias("label"),
    ).select(
        "*",
        ((F.col("kg") + F.col("dense")) / 2.0).alias("fusion"),
        ((F.col("kg") + 3.0 * F.col("dense")) / 4.0).alias("fusion_gated"),
    )


MODELS = ("kg", "dense", "fusion", "fusion_gated")

LONG_PREDICTIONS_SQL = (
    "("
    + " UNION ALL ".join(
        f"SELECT '{m}' AS model, example_id, task, {m} AS score, label FROM {PREDICTIONS_SQL}"
        for m in MODELS
    )
    + ")"
)


def long_predictions(spark: SparkSession, root: str) -> DataFrame:
    """One row per (model, example)."""
    return predictions(spark, root).unpivot(
        ["example_id", "task", "label"], list(MODELS), "model", "score"
    )


#: Rows of a retrieval run that one task groups.
TASK_ROWS = 500_000

# Retrieval runs: a supplier is the query, its orders the retrieved documents.
RANKED_SQL = """(
  SELECT l_suppkey AS query_id, l_orderkey AS doc_id, max(l_extendedprice) AS score,
         max(CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END) AS relevance,
         l_orderkey AS pos
  FROM lineitem GROUP BY l_suppkey, l_orderkey)"""


def ranked(spark: SparkSession, root: str) -> DataFrame:
    """Nearly every row is a group of its own, so rows are dealt to as many tasks as hold TASK_ROWS each.

    They are dealt by query, so that ranking a query's documents needs no second shuffle; only those of
    queries with more than TASK_ROWS rows are dealt by query and document.
    """
    flag = F.col("l_returnflag")
    grade = F.when(flag == "R", 2).when(flag == "A", 1).otherwise(0)
    lines = table(spark, root, "lineitem").select(
        F.col("l_suppkey").alias("query_id"), F.col("l_orderkey").alias("doc_id"), "l_extendedprice", grade.alias("grade")
    )
    rows = lines.count()  # from the files' footers
    if rows <= TASK_ROWS:
        return _best_of_documents(lines)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    hot = durable(hot_groups(lines.select("query_id"), ["query_id"], TASK_ROWS).select("query_id"), "hot-queries")
    if hot.isEmpty():
        return _best_of_documents(lines.repartition(parts, "query_id"))
    few = F.broadcast(hot)  # count / TASK_ROWS queries at most
    cold = by_group(lines, few, ["query_id"], "left_anti").repartition(parts, "query_id")
    big = by_group(lines, few, ["query_id"], "left_semi").repartition(parts, "query_id", "doc_id")
    return _best_of_documents(cold).unionByName(_best_of_documents(big))


def _best_of_documents(lines: DataFrame) -> DataFrame:
    return (
        lines.groupBy("query_id", "doc_id")
        .agg(F.max("l_extendedprice").alias("score"), F.max("grade").alias("relevance"))
        .withColumn("pos", F.col("doc_id"))
    )


# Question answering: a user turn is the question, the next assistant turn its answer.
QA_SQL = """(
  SELECT q.conv_id, q.turn, q.conv_id * 1000 + q.turn AS example_id,
         CASE WHEN q.turn < 2 THEN 'train' ELSE 'validation' END AS split,
         q.text AS question, a.text AS answer
  FROM conversations q LEFT JOIN
       (SELECT conv_id, turn - 1 AS turn, text FROM conversations WHERE role = 'assistant') a
       ON a.conv_id = q.conv_id AND a.turn = q.turn
  WHERE q.role = 'user')"""


def qa_turns(spark: SparkSession, root: str) -> DataFrame:
    """(conv_id, turn) is unique on both sides, so the join has no hot key."""
    turns = table(spark, root, "conversations")
    answers = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    questions = turns.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("question")
    )
    return questions.join(answers, ["conv_id", "turn"], "left").select(
        "conv_id",
        "turn",
        (F.col("conv_id") * 1000 + F.col("turn")).alias("example_id"),
        F.when(F.col("turn") < 2, "train").otherwise("validation").alias("split"),
        "question",
        "answer",
    )


def qa_examples(spark: SparkSession, root: str) -> DataFrame:
    """The pairs with the answer as a list, empty when the turn got none."""
    return qa_turns(spark, root).select(
        "example_id",
        "split",
        "question",
        F.array_compact(F.array("answer")).alias("answers"),
    )


# Knowledge graph: the star schema as (head, relation, tail). `pos` orders the triples.
TRIPLES_SQL = """(
  SELECT cast(n_nationkey AS bigint) * 10 AS pos, 'nation:' || n_nationkey AS head,
         'in_region' AS relation, 'region:' || n_regionkey AS tail, 'train' AS split FROM nation
  UNION ALL SELECT s_suppkey * 10 + 1, 'supplier:' || s_suppkey, 'in_nation',
         'nation:' || s_nationkey, 'train' FROM supplier
  UNION ALL SELECT c_custkey * 10 + 2, 'customer:' || c_custkey, 'in_nation',
         'nation:' || c_nationkey, 'train' FROM customer
  UNION ALL SELECT o_orderkey * 10 + 3, 'order:' || o_orderkey, 'placed_by',
         'customer:' || o_custkey,
         CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'valid' ELSE 'test' END
         FROM orders)"""


def triples(spark: SparkSession, root: str) -> DataFrame:
    def fact(name, key, digit, head, relation, tail, target, split):
        return table(spark, root, name).select(
            (F.col(key).cast("long") * 10 + digit).alias("pos"),
            F.concat(F.lit(f"{head}:"), F.col(key)).alias("head"),
            F.lit(relation).alias("relation"),
            F.concat(F.lit(f"{target}:"), F.col(tail)).alias("tail"),
            split.alias("split"),
        )

    status = F.col("o_orderstatus")
    by_status = F.when(status == "F", "train").when(status == "O", "valid").otherwise("test")
    train = F.lit("train")
    parts = [
        fact("nation", "n_nationkey", 0, "nation", "in_region", "n_regionkey", "region", train),
        fact("supplier", "s_suppkey", 1, "supplier", "in_nation", "s_nationkey", "nation", train),
        fact("customer", "c_custkey", 2, "customer", "in_nation", "c_nationkey", "nation", train),
        fact("orders", "o_orderkey", 3, "order", "placed_by", "o_custkey", "customer", by_status),
    ]
    return reduce(DataFrame.unionByName, parts)


LABELS_SQL = """(
  SELECT 'region:' || r_regionkey AS entity_id, r_name AS entity_name FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, n_name FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, c_name FROM customer)"""


def entity_labels(spark: SparkSession, root: str) -> DataFrame:
    """Names of regions, nations and customers; suppliers and orders have none."""

    def named(name, key, prefix, label):
        return table(spark, root, name).select(
            F.concat(F.lit(f"{prefix}:"), F.col(key)).alias("entity_id"),
            F.col(label).alias("entity_name"),
        )

    return (
        named("region", "r_regionkey", "region", "r_name")
        .unionByName(named("nation", "n_nationkey", "nation", "n_name"))
        .unionByName(named("customer", "c_custkey", "customer", "c_name"))
    )


# Metric series: the event type is the metric, one logged value per event.
METRICS_SQL = """(
  SELECT event_type AS metric, event_id, ts, value,
         CASE WHEN user_id % 3 = 0 THEN 'ERROR' WHEN user_id % 3 = 1 THEN 'Warning'
              ELSE 'info' END AS level
  FROM events)"""


def metric_log(spark: SparkSession, root: str) -> DataFrame:
    user = F.col("user_id") % 3
    return table(spark, root, "events").select(
        F.col("event_type").alias("metric"),
        "event_id",
        "ts",
        "value",
        F.when(user == 0, "ERROR").when(user == 1, "Warning").otherwise("info").alias("level"),
    )


EPOCHS_SQL = f"""(
  SELECT metric, date_diff('day', DATE '2024-01-01', cast(ts AS date)) AS epoch,
         avg(value) AS mean_value, count(*) AS batches
  FROM {METRICS_SQL} GROUP BY 1, 2)"""


def epoch_means(spark: SparkSession, root: str) -> DataFrame:
    """Unweighted mean per metric and epoch; a day is an epoch, an event a batch."""
    epoch = F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long")
    return (
        metric_log(spark, root)
        .groupBy("metric", epoch.alias("epoch"))
        .agg(F.avg("value").alias("mean_value"), F.count("*").alias("batches"))
    )


def documents(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    """The text table, dealt out to all cores."""
    return spread(table(spark, root, "documents").select(*columns))


def token_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, word), lower-cased."""
    return df.select(key, F.posexplode(words(F.lower(F.col(text)))).alias("pos", "word"))


def token_rows_sql(table_name: str, key: str) -> str:
    """SQL twin of `token_rows`."""
    return f"""(
  SELECT {key}, unnest(range(len(w))) AS pos, unnest(w) AS word FROM (
    SELECT {key}, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w
    FROM {table_name}))"""
