"""File readers. Nothing is inferred: every format comes with its schema."""

from __future__ import annotations

import zipfile
from functools import reduce
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemlens.functions.frames import evaluated_once
from tandemlens.functions.text import is_blank, strip, text_or_empty
from tandemlens.operators.ordered import lookup, running_totals
from tandemlens.sources import schemas

REJECT = "_corrupt_record"


def json_lines(spark: SparkSession, path, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped and malformed ones dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_lines_strict(spark: SparkSession, path, schema: str) -> DataFrame:
    """JSON lines where one malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_lines_with_rejects(spark: SparkSession, path, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejected lines). Lines are parsed here so that rejects can be counted."""
    lines = spark.read.text(path).where(~is_blank(F.col("value")))
    return parse_lines(lines, "value", schema)


def parse_lines(lines: DataFrame, column: str, schema: str) -> tuple[DataFrame, DataFrame]:
    parsed = checked_lines(lines, column, schema)
    records = parsed.where(~F.col("rejected")).select("record.*").drop(REJECT)
    return records, parsed.where("rejected").select(F.col(column).alias("line"))


def checked_lines(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """Every line with its parsed `record` and whether it was `rejected`."""
    full = f"{schema}, {REJECT} STRING"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": REJECT}
    parsed = evaluated_once(lines, record=F.from_json(column, full, options))
    return parsed.withColumn("rejected", F.col(f"record.{REJECT}").isNotNull())


def json_documents(spark: SparkSession, path, schema: str) -> DataFrame:
    """Whole-file JSON (arrays or objects), plain or gzipped."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_any(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Each file by its own kind: a JSON array or one object over several lines as a document,
    anything else as JSON lines with malformed lines dropped.

    The first line that is not blank decides how its file is tried; a file that is no document after all is
    read as lines, so a malformed first line costs that line only. Only the names of files go to the driver.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at"),
        strip(F.col("value")).alias("line"),
    )
    firsts = lines.where(F.col("line") != "").groupBy("file").agg(F.min_by("line", "at").alias("line"))
    starts_document = F.col("line").startswith("[") | (
        F.col("line").startswith("{") & F.try_parse_json("line").isNull()
    )
    kinds = {True: [], False: []}
    for row in firsts.select("file", starts_document.alias("document")).toLocalIterator():
        kinds[row["document"]].append(row["file"])
    if kinds[True]:
        full = f"{schema}, {REJECT} STRING"
        tried = spark.read.schema(full).option("multiLine", True).option("columnNameOfCorruptRecord", REJECT).json(kinds[True])
        parsed = F.count(F.col(tried.columns[0]))  # the corrupt text alone may not be asked for
        of_file = tried.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(REJECT).alias("bad"), parsed.alias("n"))
        lines_after_all = {row["file"] for row in of_file.toLocalIterator() if row["bad"]}
        kinds[False] += sorted(lines_after_all)
        kinds[True] = [file for file in kinds[True] if file not in lines_after_all]
    parts = [read(spark, kinds[kind], schema) for kind, read in ((True, json_documents), (False, json_lines)) if kinds[kind]]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def ir_corpus(spark: SparkSession, path) -> DataFrame:
    raw = json_lines_strict(spark, path, schemas.IR_CORPUS)
    return raw.select(
        text_or_empty("_id").alias("doc_id"),
        text_or_empty("title").alias("title"),
        text_or_empty("text").alias("text"),
    )


def ir_queries(spark: SparkSession, path) -> DataFrame:
    raw = json_lines_strict(spark, path, schemas.IR_QUERY)
    return raw.select(text_or_empty("_id").alias("query_id"), text_or_empty("text").alias("text"))


def tsv_fields(lines: DataFrame, least: int, column: str = "value") -> DataFrame:
    """`parts` of every stripped line that has at least `least` tab-separated fields."""
    parts = F.split(strip(F.col(column)), "\t", -1)
    return evaluated_once(lines, parts=parts).where(F.size("parts") >= least)


def qrels(spark: SparkSession, path) -> DataFrame:
    """Relevance judgements with four columns, or three with a header."""
    return parse_qrels(spark.read.text(path))


def parse_qrels(lines: DataFrame) -> DataFrame:
    """(query_id, doc_id, relevance); fails on a relevance that is no integer, as on any bad cast."""
    rows = graded_lines(lines)
    return rows.select("query_id", "doc_id", F.col("grade").cast("int").alias("relevance"))


def parse_qrels_with_rejects(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(judgements, rows whose relevance is no integer)."""
    rows = graded_lines(lines).withColumn("relevance", F.col("grade").try_cast("int"))
    bad = F.col("relevance").isNull()
    return rows.where(~bad).drop("grade"), rows.where(bad).drop("relevance")


def graded_lines(lines: DataFrame) -> DataFrame:
    """(query_id, doc_id, grade) of lines with three or four fields, without the header."""
    rows = tsv_fields(lines, 3)
    wide = F.size("parts") >= 4
    p = F.col("parts")
    relevance = F.when(wide, F.get(p, F.lit(3))).otherwise(F.get(p, F.lit(2)))
    return rows.select(
        p[0].alias("query_id"),
        F.when(wide, p[2]).otherwise(p[1]).alias("doc_id"),
        relevance.alias("grade"),
    ).where(~((F.col("query_id") == "query-id") & (F.col("grade") == "score")))


def beir(spark: SparkSession, folder: str, split: str = "test"):
    """(corpus, queries, qrels) of one dataset folder."""
    return (
        ir_corpus(spark, f"{folder}/corpus.jsonl"),
        ir_queries(spark, f"{folder}/queries.jsonl"),
        qrels(spark, f"{folder}/qrels/{split}.tsv"),
    )


def numbered_lines(spark: SparkSession, path) -> DataFrame:
    """Lines with their position (0-based) in file order.

    File name and block start are source metadata, and inside a block lines keep
    their order, so the position is the same on every run.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_in_block"),
    )
    order = [F.col("_file"), F.col("_block"), F.col("_in_block")]
    return running_totals(lines, [], order, rank="_n").select(
        "value", (F.col("_n") - 1).alias("pos")
    )


def passages(spark: SparkSession, path, cap: int | None = None) -> DataFrame:
    """id/text pairs, of the first `cap` lines only if a cap is given; it counts lines, not kept rows."""
    if cap is None:
        first = spark.read.text(path)
    else:
        first = numbered_lines(spark, path).where(F.col("pos") < cap)
    return tsv_fields(first, 2).select(
        F.col("parts")[0].alias("doc_id"), F.col("parts")[1].alias("text")
    )


def decoded_lines(spark: SparkSession, path) -> DataFrame:
    """Lines as UTF-8, and as Latin-1 for files that are not valid UTF-8.

    The whole file decides, as its encoding is a property of the file. The text source
    hands on the bytes as they are, so nothing is lost and a large file stays split.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("_place"),
    )
    bad = (
        lines.where(~F.is_valid_utf8("value"))
        .select("_file")
        .distinct()
        .withColumn("_latin", F.lit(True))
    )
    latin = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    text = F.when(F.col("_latin"), latin).otherwise(F.col("value"))
    return lookup(lines, bad, "_file", "left").select(text.alias("value"), "_file", "_place")


def kg_entities(spark: SparkSession, path) -> DataFrame:
    return tsv_fields(decoded_lines(spark, path), 2).select(
        F.col("parts")[0].alias("entity_id"), F.col("parts")[1].alias("entity_name")
    )


def kg_relations(spark: SparkSession, path) -> DataFrame:
    return tsv_fields(decoded_lines(spark, path), 2).select(
        F.col("parts")[0].alias("relation_id"), F.col("parts")[1].alias("relation_name")
    )


def kg_names(spark: SparkSession, path, key: str, name: str) -> DataFrame:
    """One (key, name) per id; of several lines with the same id the last one holds."""
    rows = tsv_fields(decoded_lines(spark, path), 2)
    fields = rows.select(
        F.col("parts")[0].alias(key), F.col("parts")[1].alias(name), F.struct("_file", "_place").alias("at")
    )
    return fields.groupBy(key).agg(F.max_by(name, "at").alias(name))


def kg_triples(spark: SparkSession, path, split: str = "train") -> DataFrame:
    return tsv_fields(decoded_lines(spark, path), 3).select(
        F.col("parts")[0].alias("head"),
        F.col("parts")[1].alias("relation"),
        F.col("parts")[2].alias("tail"),
        F.lit(split).alias("split"),
    )


def qa_keyed(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """(questions, passages) of files that map query ids to records; join them on query_id."""
    raw = json_documents(spark, path, schemas.QA_KEYED)
    questions = raw.select(F.explode("query").alias("query_id", "q")).select(
        "query_id",
        text_or_empty("q.query").alias("query"),
        text_or_empty("q.query_type").alias("query_type"),
        F.coalesce("q.answers", F.array().cast("array<string>")).alias("answers"),
    )
    texts = raw.select(F.explode("passages").alias("query_id", "p")).select(
        "query_id", F.posexplode("p").alias("pos", "p")
    )
    return questions, texts.select(
        "query_id",
        "pos",
        text_or_empty("p.passage_text").alias("passage_text"),
        F.coalesce("p.is_selected", F.lit(0)).alias("is_selected"),
        text_or_empty("p.url").alias("url"),
    )


def nq_tokens(tokens: Column) -> Column:
    """Token lists in either layout as a list of structs."""
    return F.transform(tokens["token"], lambda t: F.struct(t.alias("token")))


def nq_slice(spark: SparkSession, path, max_tokens: int | None = None) -> DataFrame:
    """Question, document fields and tokens (the first `max_tokens` if given).

    Rows without id or question are dropped.
    """
    raw = spark.read.schema(schemas.NQ_RAW).parquet(path)
    kept = raw.where(~is_blank(F.col("id")) & ~is_blank(F.col("question.text")))
    tokens = F.coalesce("document.tokens.token", F.array().cast("array<string>"))
    return kept.select(
        "id",
        F.col("question.text").alias("question"),
        text_or_empty("document.title").alias("document_title"),
        text_or_empty("document.url").alias("document_url"),
        (tokens if max_tokens is None else F.slice(tokens, 1, max_tokens)).alias("document_tokens"),
        "annotations",
    )


def parquet_files(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame:
    """Every readable Parquet file below a folder, whatever its name; others are skipped.

    Without a schema, that of some file is taken, which then must be readable.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    return (
        reader.option("recursiveFileLookup", True)
        .option("ignoreCorruptFiles", True)
        .option("mergeSchema", False)
        .parquet(folder)
    )


def parquet_files_with_rejects(
    spark: SparkSession, folder: str, schema: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(rows, path of every file that gave no row: unreadable ones, and readable ones without rows)."""
    rows = parquet_files(spark, folder, schema)
    used = rows.select(F.col("_metadata.file_path").alias("path")).distinct()
    return rows, file_sizes(spark, folder).join(used, "path", "left_anti")


def column_union(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(column, n_files): every column name over Parquet files and how many files have it.

    Only footers are read.
    """
    names = [(c,) for p in paths for c in spark.read.parquet(p).columns]
    return spark.createDataFrame(names, "column string").groupBy("column").agg(F.count("*").alias("n_files"))


def file_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size_mb) of every file below a folder. Only metadata is read, not the bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", (F.col("length") / 1048576.0).alias("size_mb"))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def resolve(names: list[str], split: str) -> str:
    """File of a split: the first name that contains it, else the first file at all."""
    lines = sorted(n for n in names if n.endswith(".jsonl"))
    matching = [n for n in lines if split in n.rsplit("/", 1)[-1]]
    if not lines:
        raise FileNotFoundError(f"no data file for split {split!r}")
    return (matching or lines)[0]


def json_config(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return json_documents(spark, path, schema)


def extract_if_absent(archive: str, target: str) -> bool:
    """Unpack a zip next to the data unless its folder is already there."""
    if not Path(archive).exists() or Path(target).exists():
        return False
    with zipfile.ZipFile(archive) as z:
        z.extractall(Path(target).parent)
    return True


def readable(spark: SparkSession, path: str, schema: str) -> bool:
    """False when the strict read of a file fails."""
    try:
        json_lines_strict(spark, path, schema).agg(F.count("*")).first()
    except (PySparkException, Py4JJavaError):
        return False
    return True
