"""Where the plan modules register their queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name. Integers come out as BIGINT on both sides."""

    def add(fn: Query) -> Query:
        if fn.__name__ in QUERIES:
            raise ValueError(f"query {fn.__name__} registered twice")

        @wraps(fn)
        def run(spark: SparkSession, root: str) -> DataFrame:
            return widened(fn(spark, root))

        QUERIES[fn.__name__] = run
        if sql is not None:
            SQL[fn.__name__] = sql
        return run

    return add


def widened(df: DataFrame) -> DataFrame:
    small = ("tinyint", "smallint", "int")
    return df.select(
        *[F.col(n).cast("long").alias(n) if t in small else F.col(n) for n, t in df.dtypes]
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that summation order does not show."""
    return df.select(
        *[
            (F.round(F.col(n), digits) if t in ("double", "float") else F.col(n)).alias(n)
            for n, t in df.dtypes
        ]
    )


def rnd(col: Column, digits: int = 6) -> Column:
    return F.round(col, digits)
