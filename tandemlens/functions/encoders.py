"""Text vectors without a pretrained model: mean-pooled hashed word indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemlens.functions.text import words


def hashed_mean(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, dim, value): share of the words of a text that hash to a dimension.

    Counts are combined before the shuffle; no text is collected.
    """
    word = F.explode(words(F.lower(F.col(text)))).alias("word")
    # 28 bits of the digest, read as a number.
    bucket = F.conv(F.substring(F.md5("word"), 1, 7), 16, 10).cast("long") % size
    counts = df.select(key, word).groupBy(key, bucket.alias("dim")).agg(F.count("*").alias("n"))
    totals = df.select(key, F.size(words(F.col(text))).alias("total"))
    return counts.join(totals, key).select(key, "dim", (F.col("n") / F.col("total")).alias("value"))
