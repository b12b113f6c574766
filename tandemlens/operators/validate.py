"""Dataset status, readiness rules, corruption filters and presence checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandemlens.functions.text import has_null_byte, is_blank

REQUIRED = ("beir_ir", "ms_marco_qa", "wikidata5m_kg")  # fixed values: sets needed for training


def status(exists: Column, examples: Column, kind: Column) -> Column:
    """missing, valid, invalid, or processing for a set that is filled batch by batch."""
    return (
        F.when(~exists, "missing")
        .when(examples > 0, "valid")
        .when(kind == "batches", "processing")
        .otherwise("invalid")
    )


def drop_corrupt(df: DataFrame) -> DataFrame:
    return df.where(~has_null_byte(df))


def expected_against_found(expected: DataFrame, found: DataFrame, on: str) -> DataFrame:
    """Every expected name with what was found for it, and placeholders where nothing was."""
    seen = found.withColumn("_seen", F.lit(True))
    return expected.join(seen, on, "left").select(
        on,
        F.coalesce("_seen", F.lit(False)).alias("exists"),
        F.coalesce("examples", F.lit(0)).alias("examples"),
        F.coalesce("size_mb", F.lit(0.0)).alias("size_mb"),
    )


def missing_components(required: DataFrame, datasets: DataFrame) -> DataFrame:
    """Required sets that are not valid."""
    return required.join(datasets.where(F.col("status") == "valid"), "name", "left_anti")


def validation_summary(datasets: DataFrame, required: DataFrame) -> DataFrame:
    """One row: totals over valid sets, and whether every required one is among them."""
    valid = F.col("status") == "valid"
    totals = datasets.agg(
        F.count("*").alias("total_datasets"),
        F.count_if(valid).alias("valid_datasets"),
        F.coalesce(F.sum(F.when(valid, F.col("examples"))), F.lit(0)).alias("total_examples"),
    )
    missing = missing_components(required, datasets).agg(F.count("*").alias("n")).scalar()
    return totals.withColumn("missing", missing).select(
        "*", (F.col("missing") == 0).alias("ready_for_training")
    )


def status_rollup(datasets: DataFrame) -> DataFrame:
    """One row: sets, successful ones, totals, and readiness per task computed from the status."""
    done = F.col("status").startswith("completed")

    def all_of(task: str) -> Column:
        return F.coalesce(F.bool_and(F.when(F.col("task") == task, done)), F.lit(False))

    rolled = datasets.agg(
        F.count("*").alias("total_datasets"),
        F.count_if(done).alias("successful_datasets"),
        F.coalesce(F.sum("examples"), F.lit(0)).alias("total_examples"),
        F.coalesce(F.sum("size_mb"), F.lit(0.0)).alias("total_size_mb"),
        all_of("kg").alias("kg_ready"),
        all_of("qa").alias("qa_ready"),
        all_of("ir").alias("ir_ready"),
    )
    overall = F.col("kg_ready") & F.col("qa_ready") & F.col("ir_ready")
    return rolled.withColumn("overall_ready", overall)


def research_readiness(datasets: DataFrame) -> DataFrame:
    """Ready with at least one QA and one IR set; names what is missing."""
    counts = datasets.agg(
        *[F.count_if(F.col("task") == t).alias(f"{t}_datasets") for t in ("qa", "ir", "kg")],
        F.coalesce(F.sum("examples"), F.lit(0)).alias("total_examples"),
    )
    gaps = F.array_compact(
        F.array(
            F.when(F.col("qa_datasets") == 0, "QA datasets"),
            F.when(F.col("ir_datasets") == 0, "IR datasets"),
        )
    )
    return counts.select(
        "*",
        (F.size(gaps) == 0).alias("ready_for_research"),
        F.array_join(gaps, ", ").alias("missing_components"),
    )


def phases_succeeded(phases: DataFrame) -> DataFrame:
    """At least three of the phases done; the graph phase plus QA or IR is critical."""

    def done(name: str) -> Column:
        return F.coalesce(F.bool_or((F.col("phase") == name) & F.col("ok")), F.lit(False))

    return phases.agg(
        F.count_if("ok").alias("success_count"),
        (F.count_if("ok") >= 3).alias("successful"),
        (done("kg") & (done("qa") | done("ir"))).alias("critical_ok"),
    )


def progress(current_gb: Column, expected_gb: Column) -> list[Column]:
    """Percentage and band of a download."""
    percent = current_gb / expected_gb * 100
    band = (
        F.when(current_gb.isNull(), "not started")
        .when(percent >= 95, "complete")
        .when(current_gb > 0, "downloading")
        .otherwise("starting")
    )
    return [F.coalesce(percent, F.lit(0.0)).alias("progress"), band.alias("band")]


def columns_found(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """One row per expected column: present or not, and its non-null rows."""
    here = [c for c in expected if c in df.columns]
    counts = df.agg(*[F.count(c).alias(c) for c in here])
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(c in here).alias("found"),
            (F.col(c) if c in here else F.lit(0).cast("long")).alias("filled"),
        )
        for c in expected
    ]
    return counts.select(F.inline(F.array(*rows)))


def non_empty_value(df: DataFrame, name: str) -> Column:
    """Non-empty for any type: text not blank, list or map with entries, number not NaN."""
    col, kind = F.col(name), dict(df.dtypes)[name]
    if kind == "string":
        return ~is_blank(col)
    if kind.startswith(("array", "map")):
        return F.coalesce(F.size(col) > 0, F.lit(False))
    if kind in ("double", "float"):
        return col.isNotNull() & ~F.isnan(col)
    return col.isNotNull()
