"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandemlens.session import fits_broadcast

#: White space of the text contracts: blank, tab, newline, vertical tab, form feed, return.
SPACE = " \t\n\x0b\x0c\r"
#: Hashes whose bits are summed at once.
CHUNK = 1 << 15


def majority_bits(hashes: np.ndarray) -> int:
    """The unsigned 64-bit number of which a bit is 1 if it is set in over half the hashes; 0 for none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i : i + CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (ones * 2 > len(hashes)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def named(column: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + column.replace("`", "``") + "`")


def packed(df: DataFrame, **more: Column) -> DataFrame:
    """All columns in one struct `row`, so that columns added next to it cannot clash."""
    return df.select(F.struct(*[named(c) for c in df.columns]).alias("row"), *[c.alias(n) for n, c in more.items()])


def unpacked(df: DataFrame, columns: list[str], **more: Column) -> DataFrame:
    """The columns of `row` again, then `more`; a column of `row` named like one of `more` gives way."""
    keep = [c for c in columns if c.lower() not in {n.lower() for n in more}]
    return df.select(
        *[F.col("row").getField(c).alias(c) for c in keep], *[c.alias(n) for n, c in more.items()]
    )


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; an id that is null counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def small(df: DataFrame) -> DataFrame:
    """The table marked for broadcast, if it is counted to be small; as it is otherwise."""
    return F.broadcast(df) if fits_broadcast(df) else df
