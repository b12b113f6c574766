"""Ranks, running totals and key lookups that stay distributed when one key is hot.

A plain window puts a whole group into one task. Here the group sizes are
counted first (a map-side combined aggregate); only when some group exceeds the
split size do its rows take the second route: range partitioning on
(group, order), a local window per range and an offset per range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandemlens.session import durable, fits_broadcast, split_rows


PRUNE_ROWS = 1_000
SALTS = 64


def hot_groups(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """Groups with more than `limit` rows; there are at most count(df) / limit of them."""
    return df.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > limit)


def by_group(df: DataFrame, other: DataFrame, groups: Sequence[str], how: str) -> DataFrame:
    """Join on `groups`, of which null is one like any other."""
    own = other.withColumnsRenamed({g: f"_g_{g}" for g in groups})
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups])
    return df.join(own, same, how).drop(*[f"_g_{g}" for g in groups])


def running_totals(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[Column],
    sums: Mapping[str, Column] | None = None,
    prior_max: Mapping[str, Column] | None = None,
    rank: str = "rank",
) -> DataFrame:
    """Add a 1-based `rank`, inclusive running `sums` and the maximum over earlier rows.

    `order` is ascending and must end in a unique key, so ties are settled the
    same way on every run. Without `groups` the whole table is one group.
    """
    groups = list(groups)
    sums, prior_max = dict(sums or {}), dict(prior_max or {})
    limit = split_rows(df.sparkSession)
    keys = [f"_k{i}" for i in range(len(order))]
    keyed = df.select(
        "*",
        *[c.alias(k) for c, k in zip(order, keys)],
        *[c.alias(f"_s_{n}") for n, c in sums.items()],
        *[c.alias(f"_m_{n}") for n, c in prior_max.items()],
    )
    helpers = keys + [f"_s_{n}" for n in sums] + [f"_m_{n}" for n in prior_max]

    if groups:
        hot = hot_groups(df.select(*groups), groups, limit)
        total = hot.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("n")).first()["n"]
        if total == 0:
            return _in_groups(keyed, groups, keys, sums, prior_max, rank).drop(*helpers)
        hot = durable(hot, "hot-groups")
        cold = by_group(keyed, hot, groups, "left_anti")
        big = by_group(keyed, hot, groups, "left_semi")
        result = _in_groups(cold, groups, keys, sums, prior_max, rank).unionByName(
            _in_ranges(big, groups, keys, sums, prior_max, rank, total, limit)
        )
        return result.drop(*helpers)

    total = keyed.count()
    if total <= limit:  # small enough for one sort, and checked to be
        return _in_groups(keyed, [F.lit(0)], keys, sums, prior_max, rank).drop(*helpers)
    return _in_ranges(keyed, groups, keys, sums, prior_max, rank, total, limit).drop(*helpers)


def _in_groups(df, groups, keys, sums, prior_max, rank):
    ordered = Window.partitionBy(*groups).orderBy(*keys)
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    return df.select(
        "*",
        F.row_number().over(ordered).cast("long").alias(rank),
        *[F.sum(f"_s_{n}").over(upto).alias(n) for n in sums],
        *[F.max(f"_m_{n}").over(before).alias(n) for n in prior_max],
    )


def _in_ranges(df, groups, keys, sums, prior_max, rank, total, limit):
    """Rows placed by range, then numbered per range and shifted by the ranges before."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // limit))
    placed = durable(
        df.repartitionByRange(parts, *groups, *keys).withColumn("_range", F.spark_partition_id()),
        "ranges",
    )
    place = [*groups, "_range"]
    per_range = placed.groupBy(*place).agg(
        F.count("*").alias("_n"),
        *[F.sum(f"_s_{n}").alias(f"_rs_{n}") for n in sums],
        *[F.max(f"_m_{n}").alias(f"_rm_{n}") for n in prior_max],
    )
    # One row per (group, range): at most `parts` of them share a group.
    earlier = (
        Window.partitionBy(*(groups or [F.lit(0)]))
        .orderBy("_range")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = per_range.select(
        *place,
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_on"),
        *[F.sum(f"_rs_{n}").over(earlier).alias(f"_os_{n}") for n in sums],
        *[F.max(f"_rm_{n}").over(earlier).alias(f"_om_{n}") for n in prior_max],
    )
    local = _in_groups(placed, place, keys, sums, prior_max, rank)
    joined = by_group(local, offsets, place, "inner")
    own = [c for c in df.columns]
    return joined.select(
        *own,
        (F.col(rank) + F.col("_on")).alias(rank),
        *[(F.col(n) + F.coalesce(F.col(f"_os_{n}"), F.lit(0))).alias(n) for n in sums],
        *[F.greatest(F.col(n), F.col(f"_om_{n}")).alias(n) for n in prior_max],
    )


def _first_of_places(keyed: DataFrame, groups: Sequence[str], keys: Sequence[str], places: int, most: int) -> DataFrame:
    """The first `most` rows of each of a group's `places`, with their number `_n` there; written once."""
    place = Window.partitionBy(*groups, "_salt").orderBy(*keys)
    dealt = keyed.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(places)))
    first = dealt.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= most)
    return durable(first.drop("_salt"), "first-rows")


def top_per_group(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """First `n` rows of each group, in an `order` that ends in a unique key.

    For a small `n`, Spark prunes to `n` rows per group and task before the shuffle.
    For a large one the rows are dealt to places of their group, so many that about PRUNE_ROWS / 2 of the
    first `n` fall to each; Spark prunes each place to PRUNE_ROWS, and the rows left, written once, are
    ranked. A full place whose last row ranks before `n` may have lost a row that belongs; then every
    place keeps its first `n`.
    """
    if n > PRUNE_ROWS:
        keys = [f"_o{i}" for i in range(len(order))]
        keyed = df.select("*", *[c.alias(k) for c, k in zip(order, keys)])
        places, most = -(-2 * n // PRUNE_ROWS), PRUNE_ROWS
        first = _first_of_places(keyed, groups, keys, places, most)
        ranked = running_totals(first, groups, [F.col(k) for k in keys], rank=rank)
        if not ranked.where((F.col("_n") == most) & (F.col(rank) < n)).isEmpty():
            first = _first_of_places(keyed, groups, keys, SALTS, n)
            ranked = running_totals(first, groups, [F.col(k) for k in keys], rank=rank)
        return ranked.where(F.col(rank) <= n).drop("_n", *keys)
    window = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def lookup(
    big: DataFrame,
    dim: DataFrame,
    on: str,
    how: str = "inner",
    keys_of: DataFrame | None = None,
) -> DataFrame:
    """Equi-join `big` with a dimension that is unique on `on`, safe for a hot key in `big`.

    A dimension counted as small is broadcast, where skew does not matter. Beyond
    that, hot keys are looked for (in `keys_of`, if that is cheaper to scan than
    `big`): they are few (count / split size), so only their dimension rows meet
    the hot rows, a table Spark can broadcast by its size; the rest joins as usual.
    """
    if fits_broadcast(dim):
        return big.join(F.broadcast(dim), on, how)
    if how == "left":  # rows without a key match nothing and must not meet in one task
        nothing = [F.lit(None).cast(dim.schema[c].dataType).alias(c) for c in dim.columns if c != on]
        without = big.where(F.col(on).isNull()).select(on, *[c for c in big.columns if c != on], *nothing)
        return _lookup(big.where(F.col(on).isNotNull()), dim, on, how, keys_of).unionByName(without)
    return _lookup(big.where(F.col(on).isNotNull()), dim, on, how, keys_of)


def _lookup(big: DataFrame, dim: DataFrame, on: str, how: str, keys_of: DataFrame | None) -> DataFrame:
    limit = split_rows(big.sparkSession)
    hot = hot_groups((big if keys_of is None else keys_of).select(on), [on], limit).select(on)
    if hot.isEmpty():
        return big.join(dim, on, how)
    hot = durable(hot, "hot-keys")
    hot_dim = durable(dim.join(hot, on, "left_semi"), "hot-dim")
    hot_rows = big.join(F.broadcast(hot), on, "left_semi")  # count / split size keys at most
    if fits_broadcast(hot_dim):
        hot_rows = hot_rows.join(F.broadcast(hot_dim), on, how)
    else:  # wide rows: each is copied to SALTS places among which its key's rows are dealt
        copies = hot_dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = hot_rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        hot_rows = salted.join(copies, [on, "_salt"], how).drop("_salt")
    return big.join(hot, on, "left_anti").join(dim, on, how).unionByName(hot_rows)
