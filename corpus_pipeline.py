"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each result to the
shared folder and reads it again before the next. All but the last return the columns of the
documents they got. Empty tables pass through every stage. A stage's own intermediate tables go when the
next stage starts on its written result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tandemlens.llm.decontaminate import decontaminate
from tandemlens.llm.lines import rewrite_texts
from tandemlens.llm.packing import pack
from tandemlens.llm.pretokens import tokenizer_path
from tandemlens.llm.simhash import keep_one
from tandemlens.llm.toxicity import drop_toxic
from tandemlens.session import drop_tables, durable, tables_written
from tandemlens.sources.tables import table


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Intermediate tables of the stages so far.
_HELD: set[str] = set()


def tidy(stage: Stage) -> Stage:
    """Before the stage, delete the tables that earlier stages left behind, but for those that `docs` still reads."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _HELD:
            folders = {file.rsplit("/", 2)[-2] for file in docs.inputFiles() if "/" in file}
            done = {path for path in _HELD if path.rsplit("/", 1)[-1] not in folders}
            drop_tables(spark, done)
            _HELD.difference_update(done)
        before = set(tables_written())
        result = stage(spark, docs, sf_dir)
        _HELD.update(set(tables_written()) - before)
        return result

    return run_stage


@tidy
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is trained on the labels of these documents."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


@tidy
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in many documents stay in the last of them only; n_chars stays as it was."""
    return rewrite_texts(docs)


@tidy
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a five-word Jaccard similarity of 0.8 the smallest id stays."""
    return keep_one(docs)


@tidy
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain an item of the benchmark go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


@tidy
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, each with its sequence and its place there."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: A classifier, a hashed search and a packing: no SQL; tests run the stages against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), set()
    for name, stage in STAGES:
        known = set(tables_written())
        docs = durable(stage(spark, docs, sf_dir), name)
        last = set(tables_written()) - known
        drop_tables(spark, before)  # the stage's input and what earlier ones left
        before = last
    own = {file.rsplit("/", 2)[-2] for file in docs.inputFiles() if "/" in file}
    drop_tables(spark, {path for path in before if path.rsplit("/", 1)[-1] not in own})
    return docs
