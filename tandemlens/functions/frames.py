"""Helpers on whole frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluated_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns that a later filter uses.

    A filter on a plain projected column is pushed below the projection, which
    would compute the column twice; it is not pushed below a generator.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))
