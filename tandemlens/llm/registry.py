"""Queries of this subpackage: each registers under its function name, next to its SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = (
    "bpe",
    "chat",
    "collocations",
    "decontaminate",
    "language",
    "licenses",
    "lines",
    "negatives",
    "packing",
    "quality",
    "simhash",
    "tokens",
    "toxicity",
)

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def registered() -> tuple[dict[str, Query], dict[str, str]]:
    for module in MODULES:
        importlib.import_module(f"tandemlens.llm.{module}")
    return QUERIES, SQL
