"""Positional limits, batches and samples, all on an explicit order column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandemlens.operators.ordered import PRUNE_ROWS, running_totals, top_per_group


def first_n(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first `n` rows in ascending order, which ends in a unique key."""
    if n <= PRUNE_ROWS:
        return df.orderBy(*order).limit(n)
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    return running_totals(df, [], keys, rank="_n").where(F.col("_n") <= n).drop("_n")


def limit_then_filter(df: DataFrame, n: int, order: Column | str, keep: Column) -> DataFrame:
    """Cap on input rows: rows beyond the first `n` are not even looked at."""
    return first_n(df, n, order).where(keep)


def filter_then_limit(df: DataFrame, n: int, order: Column | str, keep: Column) -> DataFrame:
    """Cap on output rows."""
    return first_n(df.where(keep), n, order)


def cap_per_split(df: DataFrame, split: str, caps: dict[str, int], order: Column) -> DataFrame:
    """A different cap on the input rows of every split; a split without one is kept whole."""
    limit = F.create_map(*[F.lit(x) for pair in caps.items() for x in pair])[F.col(split)]
    has_cap = F.coalesce(F.col(split).isin(*caps), F.lit(False))
    capped = df.where(has_cap)
    ranked = top_per_group(capped, [split], [order], max(caps.values()), "_place")
    return ranked.where(F.col("_place") <= limit).drop("_place").unionByName(
        df.where(~has_cap)
    )


def batches(df: DataFrame, size: int, order: Sequence[Column], groups: Sequence[str] = ()) -> DataFrame:
    """Number of the batch every row belongs to, from 1, and its place inside."""
    placed = running_totals(df, groups, order, rank="_place")
    before = F.col("_place") - 1
    return placed.select(
        *df.columns,
        (F.floor(before / size) + 1).cast("long").alias("batch"),
        (before % size).alias("place"),
    )


def break_after_batch(df: DataFrame, file: str, order: Column, batch: int) -> DataFrame:
    """Row cap that is tested after each appended row, over files read one after another.

    Once `batch` rows are in, every later file still adds its first row.
    """
    sizes = df.groupBy(file).agg(F.count("*").alias("_rows"))
    filled = running_totals(sizes, [], [F.col(file)], sums={"_upto": F.col("_rows")})
    # Files that fit into the cap keep all rows. From the one that reaches it on, each
    # file stops as soon as the total is at least `batch`, which takes one row or more.
    room = F.greatest(F.lit(batch) - (F.col("_upto") - F.col("_rows")), F.lit(1))
    allowed = filled.select(file, room.alias("_room"))
    firsts = top_per_group(df, [file], [order], batch, "_place")
    return firsts.join(allowed, file).where(F.col("_place") <= F.col("_room")).select(*df.columns)


def shuffled(df: DataFrame, seed: int, key: str) -> DataFrame:
    """Position of every row in a repeatable shuffle; the same key and seed give the same place."""
    digest = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key))), 1, 15)
    order = F.conv(digest, 16, 10).cast("long")
    placed = running_totals(df, [], [order, F.col(key)], rank="_place")
    return placed.select(*df.columns, (F.col("_place") - 1).alias("position"))


def first_files(df: DataFrame, file: str, n: int) -> DataFrame:
    """Rows of the first `n` files by name."""
    names = df.select(file).distinct().orderBy(file).limit(n)
    return df.join(names, file, "left_semi")
