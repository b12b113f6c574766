"""Text predicates and word functions with Unicode-aware whitespace."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Whitespace as a Unicode-aware split sees it (the four separators
# 1C-1F count as whitespace there but not in Java's class).
WORD = r"(?U)[^\s\x1c-\x1f]+"
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def text_or_empty(col: Column | str) -> Column:
    """Missing text counts as the empty string."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def strip(col: Column) -> Column:
    """Whitespace removed from both ends."""
    return F.btrim(col, F.lit(SPACES))


def is_blank(col: Column) -> Column:
    return ~F.coalesce(col, F.lit("")).rlike(WORD)


def words(col: Column) -> Column:
    return F.regexp_extract_all(text_or_empty(col), F.lit(WORD), F.lit(0))


def word_count(col: Column | str) -> Column:
    return F.regexp_count(text_or_empty(col), F.lit(WORD))


def has_null_byte(df: DataFrame) -> Column:
    """True where any string column carries a NUL character (binary corruption)."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    checks = [F.coalesce(F.contains(F.col(c), F.lit("\0")), F.lit(False)) for c in texts]
    return reduce(lambda a, b: a | b, checks, F.lit(False))


def looks_like_html(col: Column) -> Column:
    """HTML where data was expected, judged by the first 100 characters."""
    head = F.lower(F.substring(col, 1, 100))
    return F.contains(head, F.lit("<html")) | F.contains(head, F.lit("<!doctype"))


def shorten(col: Column, n: int = 200) -> Column:
    """Text for display: `n` characters, then an ellipsis."""
    return F.when(F.length(col) > n, F.concat(F.substring(col, 1, n), F.lit("..."))).otherwise(col)
