"""Array helpers: padding, token spans and list clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandemlens.functions.text import is_blank, strip


def pad_or_cut(col: Column, size: int, fill: Column) -> Column:
    """Exactly `size` elements: cut when longer, filled up when shorter."""
    return F.slice(F.concat(col, F.array_repeat(fill, size)), 1, size)


def attention_mask(col: Column, size: int) -> Column:
    """1 for each real token, 0 for each padded place."""
    real = F.least(F.size(col), F.lit(size))
    return F.concat(F.array_repeat(F.lit(1), real), F.array_repeat(F.lit(0), F.lit(size) - real))


def span_text(tokens: Column, start: Column, end: Column) -> Column:
    """Text of tokens[start:end], or NULL unless 0 <= start < end <= len and not blank."""
    valid = (start >= 0) & (end > start) & (end <= F.size(tokens))
    # The length handed to slice is never negative, even where the guard fails.
    piece = F.slice(tokens, F.greatest(start, F.lit(0)) + 1, F.greatest(end - start, F.lit(0)))
    text = strip(F.array_join(piece, " "))
    return F.when(valid & ~is_blank(text), text)


def span_text_loose(tokens: Column, start: Column, end: Column) -> Column:
    """Same with the looser guard: start < len and end <= len, negatives count from the end."""
    n = F.size(tokens)
    first = F.when(start < 0, F.greatest(n + start, F.lit(0))).otherwise(start)
    last = F.when(end < 0, F.greatest(n + end, F.lit(0))).otherwise(end)
    piece = F.slice(tokens, F.least(first, n) + 1, F.greatest(last - first, F.lit(0)))
    return F.when((start < n) & (end <= n), F.array_join(piece, " "))


def list_as_text(col: Column, most: int = 10) -> Column:
    """A list where one text was expected: its only element, or the first ten joined."""
    return F.coalesce(F.array_join(F.slice(col, 1, most), " "), F.lit(""))


def capped(col: Column, kind: T.DataType, items: int = 10, depth: int = 3) -> Column:
    """A nested value with every list cut to `items`; what lies deeper than `depth` becomes text."""
    if isinstance(kind, T.ArrayType):
        short = F.slice(col, 1, items)
        if not isinstance(kind.elementType, (T.ArrayType, T.StructType)):
            return short
        return F.transform(short, lambda x: capped(x, kind.elementType, items, depth - 1))
    if isinstance(kind, T.StructType):
        if depth < 0:
            return F.to_json(col)
        return F.struct(
            *[capped(col[f.name], f.dataType, items, depth - 1).alias(f.name) for f in kind.fields]
        )
    return col


def non_empty(col: Column) -> Column:
    """Drop NULL and empty strings from a list."""
    return F.filter(col, lambda x: x.isNotNull() & (x != ""))


def any_answer(col: Column) -> Column:
    """True when at least one answer holds more than whitespace."""
    return F.coalesce(F.exists(col, lambda a: ~is_blank(a)), F.lit(False))


def struct_of_lists_to_list(texts: Column, selected: int = 1, url: str = "") -> Column:
    """Passage texts as structs, all marked selected."""
    return F.transform(
        texts,
        lambda t: F.struct(
            t.alias("passage_text"),
            F.lit(selected).alias("is_selected"),
            F.lit(url).alias("url"),
        ),
    )


def selected_texts(passages: Column) -> Column:
    """Texts of the passages that are selected and not empty."""
    kept = F.filter(
        passages,
        lambda p: (F.coalesce(p["passage_text"], F.lit("")) != "") & (p["is_selected"] != 0),
    )
    return F.transform(kept, lambda p: p["passage_text"])
