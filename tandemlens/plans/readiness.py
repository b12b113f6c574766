"""Validation and readiness queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemlens.functions.text import has_null_byte, looks_like_html
from tandemlens.operators import validate
from tandemlens.plans.catalog import query, rnd, rounded
from tandemlens.sources.tables import table


@query(
    """
SELECT source, count(*) AS rows, count(*) FILTER (doc_id % 7 = 0) AS corrupt,
  count(*) FILTER (doc_id % 7 <> 0) AS kept FROM documents GROUP BY source"""
)
def null_byte_filter(spark, root):
    """Every seventh document with a NUL byte: how many are found, and how many are left."""
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("\0x"))).otherwise(F.col("text"))
    docs = table(spark, root, "documents").withColumn("text", text)
    all_of = docs.groupBy("source").agg(F.count("*").alias("rows"), F.count_if(has_null_byte(docs)).alias("corrupt"))
    kept = validate.drop_corrupt(docs).groupBy("source").agg(F.count("*").alias("kept"))
    return all_of.join(kept, "source", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))


@query(
    """
SELECT origin, is_html, count(*) AS rows FROM (
  SELECT origin, contains(h, '<html') OR contains(h, '<!doctype') AS is_html FROM (
    SELECT 'pages' AS origin, lower(substr(CASE WHEN page_id % 3 = 0 THEN substr(html, 101) ELSE html END, 1, 100)) AS h
    FROM pages
    UNION ALL SELECT 'documents', lower(substr(CASE WHEN doc_id % 5 = 0 THEN '<!DOCTYPE x>' || text ELSE text END, 1, 100))
    FROM documents)) GROUP BY ALL"""
)
def html_sniff(spark, root):
    """Every third page without its head, every fifth document with a document type."""
    headless = F.when(F.col("page_id") % 3 == 0, F.substr("html", F.lit(101))).otherwise(F.col("html"))
    marked = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("<!DOCTYPE x>"), "text")).otherwise(F.col("text"))
    pages = table(spark, root, "pages").select(F.lit("pages").alias("origin"), headless.alias("body"))
    docs = table(spark, root, "documents").select(F.lit("documents").alias("origin"), marked.alias("body"))
    sniffed = pages.unionByName(docs).select("origin", looks_like_html(F.col("body")).alias("is_html"))
    return sniffed.groupBy("origin", "is_html").agg(F.count("*").alias("rows"))


# Which rows stand for which dataset: (name, task, table, how it is filled, size column, condition).
# Two of them have no rows, so that sets that are being filled and failed ones occur.
STAND_INS = (
    ("beir_ir", "ir", "documents", "files", "text", "true"),
    ("ms_marco_qa", "qa", "conversations", "files", "text", "turn < 2"),
    ("natural_questions_qa", "qa", "benchmark", "batches", "text", "true"),
    ("wikidata5m_kg", "kg", "orders", "files", "o_orderpriority", "true"),
    ("freebase_kg", "kg", "region", "batches", "r_name", "r_name = 'none'"),
    ("squad_qa", "qa", "nation", "files", "n_name", "n_name = 'none'"),
)
DATASETS_SQL = (
    "("
    + " UNION ALL ".join(
        f"SELECT '{name}' AS name, '{task}' AS task, '{kind}' AS kind, count(*) AS examples, "
        f"sum(strlen({col})) / 1048576e0 AS size_mb FROM {source} WHERE {rows}"
        for name, task, source, kind, col, rows in STAND_INS
    )
    + ")"
)


def _datasets(spark, root):
    """One row per dataset: examples and size, counted from the table that stands for it."""

    def counted(name, task, source, kind, col, rows):
        return table(spark, root, source).where(rows).agg(
            F.lit(name).alias("name"),
            F.lit(task).alias("task"),
            F.lit(kind).alias("kind"),
            F.count("*").alias("examples"),
            (F.sum(F.octet_length(col)) / 1048576.0).alias("size_mb"),
        )

    return reduce(DataFrame.unionByName, [counted(*s) for s in STAND_INS])


def _names(spark, names, column="name"):
    return spark.createDataFrame([(n,) for n in names], f"{column} STRING")


@query(
    f"""
SELECT name, examples, round(size_mb, 6) AS size_mb,
  CASE WHEN examples > 0 THEN 'valid' WHEN kind = 'batches' THEN 'processing' ELSE 'invalid' END
  AS status FROM {DATASETS_SQL}"""
)
def dataset_status(spark, root):
    state = validate.status(F.lit(True), F.col("examples"), F.col("kind"))
    return rounded(_datasets(spark, root).select("name", "examples", "size_mb", state.alias("status")))


def _readiness_sql(names) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    return f"""
SELECT {len(names)}::bigint AS required, count(*) AS total_datasets,
  count(*) FILTER (examples > 0) AS valid_datasets, cast(sum(examples) AS bigint) AS total_examples,
  (SELECT count(*) FROM (SELECT unnest([{listed}]) AS name) WHERE name NOT IN
    (SELECT name FROM {DATASETS_SQL} WHERE examples > 0)) AS missing,
  (SELECT count(*) FROM (SELECT unnest([{listed}]) AS name) WHERE name NOT IN
    (SELECT name FROM {DATASETS_SQL} WHERE examples > 0)) = 0 AS ready_for_training
FROM {DATASETS_SQL}"""


MORE = (*validate.REQUIRED, "freebase_kg", "squad_qa")


@query(f"{_readiness_sql(validate.REQUIRED)} UNION ALL {_readiness_sql(MORE)}")
def readiness(spark, root):
    """With the usual required sets, and with two more that have no rows."""
    state = validate.status(F.lit(True), F.col("examples"), F.col("kind"))
    datasets = _datasets(spark, root).withColumn("status", state)
    rows = [
        validate.validation_summary(datasets, _names(spark, names)).withColumn("required", F.lit(len(names)))
        for names in (validate.REQUIRED, MORE)
    ]
    return rows[0].unionByName(rows[1])


@query(
    f"""
SELECT name FROM (SELECT unnest(['beir_ir', 'ms_marco_qa', 'wikidata5m_kg', 'freebase']) AS name)
WHERE name NOT IN (SELECT name FROM {DATASETS_SQL} WHERE examples > 0)"""
)
def missing_components(spark, root):
    """Anti-join of the required sets and the valid ones, with one set that is never there."""
    state = validate.status(F.lit(True), F.col("examples"), F.col("kind"))
    datasets = _datasets(spark, root).withColumn("status", state)
    required = _names(spark, [*validate.REQUIRED, "freebase"])
    return validate.missing_components(required, datasets)


@query(
    f"""
SELECT e.name, d.name IS NOT NULL AS exists, coalesce(d.examples, 0) AS examples,
  round(coalesce(d.size_mb, 0), 6) AS size_mb
FROM (SELECT unnest(['beir_ir', 'ms_marco_qa', 'wikidata5m_kg', 'freebase']) AS name) e
LEFT JOIN {DATASETS_SQL} d ON d.name = e.name"""
)
def expected_vs_found(spark, root):
    expected = _names(spark, [*validate.REQUIRED, "freebase"])
    found = _datasets(spark, root).select("name", "examples", "size_mb")
    return rounded(validate.expected_against_found(expected, found, "name"))


@query(
    """
SELECT 'doc_id' AS "column", true AS found, count(doc_id) AS filled FROM documents
UNION ALL SELECT 'text', true, count(text) FROM documents
UNION ALL SELECT 'question', false, 0 FROM documents GROUP BY 1
UNION ALL SELECT 'annotations', false, 0 FROM documents GROUP BY 1"""
)
def columns_found(spark, root):
    wanted = ["doc_id", "text", "question", "annotations"]
    return validate.columns_found(table(spark, root, "documents"), wanted)


@query(
    f"""
WITH r AS (SELECT count(*) AS total_datasets, count(*) FILTER (examples > 0) AS successful_datasets,
  cast(sum(examples) AS bigint) AS total_examples, round(sum(size_mb), 6) AS total_size_mb,
  bool_and(examples > 0) FILTER (task = 'kg') AS kg_ready, bool_and(examples > 0) FILTER (task = 'qa') AS qa_ready,
  bool_and(examples > 0) FILTER (task = 'ir') AS ir_ready FROM {DATASETS_SQL})
SELECT *, kg_ready AND qa_ready AND ir_ready AS overall_ready FROM r"""
)
def status_rollup(spark, root):
    done = F.when(F.col("examples") > 0, "completed").otherwise("failed")
    return rounded(validate.status_rollup(_datasets(spark, root).withColumn("status", done)))


SCENARIOS = {"all": "true", "without_ir": "task <> 'ir'", "graphs": "task = 'kg'"}
_SCENARIO_SQL = " UNION ALL ".join(
    f"""
SELECT '{name}' AS scenario, count(*) FILTER (task = 'qa') AS qa_datasets, count(*) FILTER (task = 'ir') AS ir_datasets,
  count(*) FILTER (task = 'kg') AS kg_datasets, cast(sum(examples) AS bigint) AS total_examples,
  bool_or(task = 'qa') AND bool_or(task = 'ir') AS ready_for_research,
  array_to_string(list_filter([CASE WHEN NOT bool_or(task = 'qa') THEN 'QA datasets' END,
    CASE WHEN NOT bool_or(task = 'ir') THEN 'IR datasets' END], lambda x: x IS NOT NULL), ', ') AS missing_components
FROM {DATASETS_SQL} WHERE {rows}"""
    for name, rows in SCENARIOS.items()
)


@query(_SCENARIO_SQL)
def research_readiness(spark, root):
    """With all sets, without retrieval sets, and with graphs alone."""
    datasets = _datasets(spark, root)
    parts = [
        validate.research_readiness(datasets.where(rows)).withColumn("scenario", F.lit(name))
        for name, rows in SCENARIOS.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    f"""
SELECT count(*) FILTER (examples > 100) AS success_count,
  count(*) FILTER (examples > 100) >= 3 AS successful,
  bool_or(task = 'kg' AND examples > 100) AND bool_or(task IN ('qa', 'ir') AND examples > 100)
  AS critical_ok FROM {DATASETS_SQL}"""
)
def phase_success(spark, root):
    """A phase counts as done when its dataset holds more than 100 examples."""
    phases = _datasets(spark, root).select(
        F.col("task").alias("phase"), (F.col("examples") > 100).alias("ok")
    )
    return validate.phases_succeeded(phases)


@query(
    """
WITH l AS (SELECT d.source, count(*) AS docs, count(l.doc_id) AS labelled
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.source)
SELECT source, round(labelled * 250e0 / docs, 4) AS progress,
  CASE WHEN labelled * 250e0 / docs >= 95 THEN 'complete' WHEN labelled > 0 THEN 'downloading'
    ELSE 'starting' END AS band FROM l"""
)
def progress_bands(spark, root):
    """Labelled documents against 40 % of the documents of a source."""
    docs = table(spark, root, "documents").select("doc_id", "source")
    labels = table(spark, root, "labels").select("doc_id", F.lit(1).alias("seen"))
    counts = docs.join(labels, "doc_id", "left").groupBy("source").agg(
        F.count("*").alias("docs"), F.count("seen").alias("labelled")
    )
    columns = validate.progress(F.col("labelled").cast("double"), F.col("docs") * 0.4)
    return rounded(counts.select("source", *columns), 4)


@query(
    """
SELECT count(*) FILTER (doc_id % 4 <> 0 AND trim(text) <> '') AS text_ok,
  count(*) FILTER (doc_id % 5 <> 0 AND len(w) > 0) AS words_ok,
  count(*) FILTER (doc_id % 6 <> 0 AND n_chars IS NOT NULL) AS size_ok,
  count(*) FILTER (doc_id % 9 <> 0 AND n_chars IS NOT NULL) AS ratio_ok
FROM (SELECT doc_id, text, n_chars, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM documents)"""
)
def non_empty_values(spark, root):
    """The non-empty test on a string, a list, a number and a float column, each partly emptied."""
    n = F.col("doc_id")
    docs = table(spark, root, "documents").select(
        F.when(n % 4 == 0, " ").otherwise(F.col("text")).alias("text"),
        F.filter(F.split(F.when(n % 5 == 0, "").otherwise(F.col("text")), " "), lambda x: x != "").alias("tokens"),
        F.when(n % 6 != 0, F.col("n_chars")).alias("n_chars"),
        F.when(n % 9 == 0, F.lit(float("nan"))).otherwise(F.col("n_chars") / 2.0).alias("ratio"),
    )
    names = {"text": "text_ok", "tokens": "words_ok", "n_chars": "size_ok", "ratio": "ratio_ok"}
    checks = [F.count_if(validate.non_empty_value(docs, c)).alias(n) for c, n in names.items()]
    return docs.agg(*checks)


# What to expect of each dataset (size in GB, batch size, whether to stream it).
EXPECTED = (
    ("beir_ir", 1, 0.5, 1000, False),
    ("ms_marco_qa", 2, 2.5, 1000, False),
    ("wikidata5m_kg", 3, 5.0, 1000, True),
    ("natural_questions_qa", 4, 42.0, 100, True),
)


@query(
    f"""
SELECT e.name, e.position::bigint AS position, e.streaming, cast(ceil(d.examples / e.batch) AS bigint) AS batches,
  round(d.size_mb / 1024 / e.gb * 100, 6) AS percent_of_expected
FROM {DATASETS_SQL} d JOIN (SELECT unnest(['beir_ir', 'ms_marco_qa', 'wikidata5m_kg',
    'natural_questions_qa']) AS name, unnest([1, 2, 3, 4]) AS position,
  unnest([0.5e0, 2.5e0, 5e0, 42e0]) AS gb, unnest([1000, 1000, 1000, 100]) AS batch,
  unnest([false, false, true, true]) AS streaming) e ON e.name = d.name"""
)
def processing_plan(spark, root):
    """Processing order and number of batches per dataset, from its measured size."""
    expected = spark.createDataFrame(
        list(EXPECTED), "name STRING, position INT, gb DOUBLE, batch INT, streaming BOOLEAN"
    )
    planned = _datasets(spark, root).join(expected, "name")
    return planned.select(
        "name",
        "position",
        "streaming",
        F.ceil(F.col("examples") / F.col("batch")).alias("batches"),
        rnd(F.col("size_mb") / 1024 / F.col("gb") * 100).alias("percent_of_expected"),
    )
