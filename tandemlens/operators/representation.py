"""How much two vector spaces over the same rows have in common.

All linear measures come from one aggregate: the row count, the means and the centred cross-products of
both vectors side by side. Parts of it merge exactly (Chan's formula), so tasks reduce their rows to one
matrix a group, and matrices are merged in rounds; its size depends on the dimensions only. Mutual
information comes from quantile summaries and joint counts, which merge as well.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandemlens.operators.ordered import by_group
from tandemlens.session import durable

#: Matrices that one task merges in a round.
FAN_IN = 64
#: Directions whose variance is below this share of the largest count as absent.
RANK_TOLERANCE = 1e-9
BINS = 8
#: Of the quantile summaries: the error is one row in so many.
ACCURACY = 1_000_000


@dataclass
class Moments:
    """Count, means and centred cross-products of (x, y) laid side by side; x has `dims` coordinates."""

    n: int
    mean: np.ndarray
    cross: np.ndarray
    dims: int

    @classmethod
    def of(cls, rows: np.ndarray, dims: int) -> Moments:
        mean = rows.mean(axis=0)
        off = rows - mean
        return cls(len(rows), mean, off.T @ off, dims)

    def __add__(self, other: Moments) -> Moments:
        if (self.dims, len(self.mean)) != (other.dims, len(other.mean)):
            raise ValueError("vectors of different lengths")
        n = self.n + other.n
        apart = other.mean - self.mean
        cross = self.cross + other.cross + np.outer(apart, apart) * (self.n * other.n / n)
        return Moments(n, self.mean + apart * (other.n / n), cross, self.dims)

    @property
    def xx(self) -> np.ndarray:
        return self.cross[: self.dims, : self.dims]

    @property
    def xy(self) -> np.ndarray:
        return self.cross[: self.dims, self.dims :]

    @property
    def yy(self) -> np.ndarray:
        return self.cross[self.dims :, self.dims :]

    def turned(self) -> Moments:
        """The same with x and y exchanged."""
        order = np.r_[self.dims : len(self.mean), : self.dims]
        return Moments(self.n, self.mean[order], self.cross[np.ix_(order, order)], len(self.mean) - self.dims)


def _usable(*vectors: Column) -> Column:
    """Neither vector is null, nor has a component that is null or not finite."""
    good = F.lit(True)
    for v in vectors:
        good &= v.isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return good


def moments(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> list[tuple[tuple, Moments]]:
    """Moments of the vector columns `x` and `y` for each group, in one pass over `df`.

    Rows with a null vector, or a component that is null or not finite, are left out; all others must have as many
    components as the first (an error otherwise). Groups with a null key are groups like any other. What comes back is one
    matrix of (d_x + d_y)^2 numbers a group, so groups should be few.
    """
    by = list(by)
    vectors = df.select(*by, F.col(x).cast("array<double>").alias("_x"), F.col(y).cast("array<double>").alias("_y"))
    vectors = vectors.filter(_usable(F.col("_x"), F.col("_y")))
    head = ", ".join([*(f"`{n}` {t}" for n, t in vectors.select(*by).dtypes), "n bigint, dims int, mean binary, cross binary"])
    names = [*by, "n", "dims", "mean", "cross"]
    kinds = [vectors.schema[b].dataType for b in by]

    def row_of(key: tuple, m: Moments) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_type

        values = [*key, m.n, m.dims, m.mean.tobytes(), m.cross.tobytes()]
        types = [*map(to_arrow_type, kinds), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)

    def held_of(row: dict) -> Moments:
        mean = np.frombuffer(row["mean"])
        return Moments(row["n"], mean, np.frombuffer(row["cross"]).reshape(len(mean), len(mean)), row["dims"])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Moments] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            sides = []
            for column in (batch.column(len(by)), batch.column(len(by) + 1)):
                sizes = column.value_lengths().to_numpy()
                if sizes.min() != sizes.max():
                    raise ValueError("vectors of different lengths")
                sides.append(column.flatten().to_numpy().reshape(len(sizes), -1))
            rows = np.hstack(sides)
            keys: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*(batch.column(j).to_pylist() for j in range(len(by)))) if by else [()] * len(rows)):
                keys.setdefault(key, []).append(i)
            for key, at in keys.items():
                part = Moments.of(rows[at], sides[0].shape[1])
                held[key] = held[key] + part if key in held else part
        for key, m in held.items():
            yield row_of(key, m)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Moments] = {}
        for batch in batches:
            for row in batch.to_pylist():
                key, part = tuple(row[b] for b in by), held_of(row)
                held[key] = held[key] + part if key in held else part
        for key, m in held.items():
            yield row_of(key, m)

    partial = durable(vectors.mapInArrow(reduce, head), "moments")
    while True:
        of_group = partial.groupBy(*by).count() if by else partial.select(F.count("*").alias("count"))
        parts = of_group.agg(F.max("count").alias("most")).first()["most"] or 0
        if parts <= FAN_IN:
            break
        partial = durable(partial.repartition(-(-parts // FAN_IN)).mapInArrow(merge, head), "moments")
    found: dict[tuple, Moments] = {}
    for row in partial.toLocalIterator():  # at most FAN_IN matrices a group
        key, part = tuple(row[b] for b in by), held_of(row.asDict())
        found[key] = found[key] + part if key in found else part
    return sorted(found.items(), key=lambda kv: [(v is None, v) for v in kv[0]])


def linear_cka(m: Moments) -> float | None:
    """Centred kernel alignment of both spaces with linear kernels, 0 to 1; null if either does not vary."""
    size = np.linalg.norm(m.xx) * np.linalg.norm(m.yy)
    return float(np.linalg.norm(m.xy) ** 2 / size) if size > 0 else None


def _whitening(cross: np.ndarray) -> np.ndarray:
    """Directions of unit variance; those without variance, judged with all coordinates on one scale, are left out."""
    spread = np.sqrt(np.diag(cross))
    live = spread > 0
    values, vectors = np.linalg.eigh(cross[np.ix_(live, live)] / np.outer(spread[live], spread[live]))
    keep = values > RANK_TOLERANCE * values.max(initial=0)
    out = np.zeros((len(cross), int(keep.sum())))
    out[live] = vectors[:, keep] / np.sqrt(values[keep]) / spread[live, None]
    return out


def canonical_correlations(m: Moments) -> list[float]:
    """Largest first, as many as the lower rank of both spaces; a space that does not vary has none."""
    left, right = _whitening(m.xx), _whitening(m.yy)
    if not left.shape[1] or not right.shape[1]:
        return []
    found = np.linalg.svd(left.T @ m.xy @ right, compute_uv=False)
    return [float(min(c, 1.0)) for c in found]


def effective_rank(m: Moments) -> float | None:
    """Directions that the joint space of both vectors really uses: (sum of variances)^2 / sum of their squares."""
    size = np.linalg.norm(m.cross) ** 2
    return float(np.trace(m.cross) ** 2 / size) if size > 0 else None


def ridge_r2(train: Moments, test: Moments, penalty: float = 1.0) -> float | None:
    """Share of the variance of y in the test rows that a ridge regression on x, fitted to the training rows, explains.

    The normal equations are solved by Cholesky; the intercept is not penalised. The variance of the test rows is taken
    about their own mean, so a useless fit can come out below 0. Null if y does not vary there.
    """
    dims = train.dims
    lower = np.linalg.cholesky(train.xx + penalty * np.eye(dims))
    weights = np.linalg.solve(lower.T, np.linalg.solve(lower, train.xy))
    total = float(np.trace(test.yy))
    if total <= 0:
        return None
    shift = test.mean - train.mean
    off = shift[dims:] - shift[:dims] @ weights
    error = total - 2 * np.sum(weights * test.xy) + np.sum(weights * (test.xx @ weights)) + test.n * float(off @ off)
    return 1 - float(error) / total


def representation_report(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, cka, canonical_correlations, effective_rank) of the vector columns `x` and `y` for each group."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    head = "".join(f"`{b}` {kinds[b]}, " for b in by)
    rows = [
        (*key, m.n, linear_cka(m), canonical_correlations(m), effective_rank(m)) for key, m in moments(df, x, y, by)
    ]
    schema = f"{head}n bigint, cka double, canonical_correlations array<double>, effective_rank double"
    return df.sparkSession.createDataFrame(rows, schema)


def cross_predictability(
    df: DataFrame, x: str, y: str, held_out: Column, by: Sequence[str] = (), penalty: float = 1.0
) -> DataFrame:
    """(by, n_train, n_test, x_to_y, y_to_x): held-out share of variance explained by ridge regression, each way.

    Both folds come from the same pass. Groups in which a fold has no row get nulls. Rows for which
    `held_out` is null are trained on.
    """
    by = list(by)
    marked = df.withColumn("_held", F.coalesce(held_out, F.lit(False)))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    folds: dict[tuple, dict[bool, Moments]] = {}
    for key, m in moments(marked, x, y, [*by, "_held"]):
        folds.setdefault(key[:-1], {})[key[-1]] = m
    rows = []
    for key, fold in folds.items():
        train, test = fold.get(False), fold.get(True)
        both = (None, None)
        if train and test:
            both = (ridge_r2(train, test, penalty), ridge_r2(train.turned(), test.turned(), penalty))
        rows.append((*key, train.n if train else 0, test.n if test else 0, *both))
    head = "".join(f"`{b}` {kinds[b]}, " for b in by)
    return df.sparkSession.createDataFrame(rows, f"{head}n_train bigint, n_test bigint, x_to_y double, y_to_x double")


def mutual_information(df: DataFrame, x: str, y: str, by: Sequence[str] = (), bins: int = BINS) -> DataFrame:
    """(by, n, cells, mutual_information, corrected): information two number columns give about each other, in nats.

    Both are cut at their quantiles (of each group) into `bins` bins; an edge belongs to the bin below it, so a value
    that fills several bins leaves some empty. Entropies come from the joint counts. `corrected` takes off the bias of
    Miller and Madow, (cells - bins of x in use - bins of y in use + 1) / 2n, and may fall below 0. Rows without one
    of the values, or with one that is not a number, are left out. A group is null or not like any other.
    """
    by = list(by)
    pairs = df.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    pairs = pairs.filter("_x IS NOT NULL AND _y IS NOT NULL AND NOT isnan(_x) AND NOT isnan(_y)")
    cuts = [i / bins for i in range(1, bins)]
    edges = pairs.groupBy(*by).agg(
        F.percentile_approx("_x", cuts, ACCURACY).alias("_ex"), F.percentile_approx("_y", cuts, ACCURACY).alias("_ey")
    )
    if by:
        held = by_group(pairs, F.broadcast(durable(edges, "quantiles")), by, "inner")  # a row a group
    else:
        cut = edges.first()
        held = pairs.withColumns({c: F.lit(cut[c] or []).cast("array<double>") for c in ("_ex", "_ey")})
    below = lambda value, cut: F.size(F.filter(cut, lambda e: e < F.col(value)))
    binned = held.select(*by, below("_x", "_ex").alias("_bx"), below("_y", "_ey").alias("_by"))
    joint = binned.groupBy(*by, "_bx", "_by").agg(F.count("*").cast("double").alias("_c"))
    over = lambda *more: F.sum("_c").over(Window.partitionBy(*by, *more))
    joint = joint.withColumns({"_n": over() if by else F.sum("_c").over(Window.partitionBy(F.lit(0))), "_cx": over("_bx"), "_cy": over("_by")})
    share = F.col("_c") / F.col("_n") * F.log(F.col("_c") * F.col("_n") / (F.col("_cx") * F.col("_cy")))
    found = joint.groupBy(*by).agg(
        F.sum("_c").cast("long").alias("n"),
        F.count("*").alias("cells"),
        F.sum(share).alias("mutual_information"),
        F.count_distinct("_bx").alias("_kx"),
        F.count_distinct("_by").alias("_ky"),
    )
    bias = (F.col("cells") - F.col("_kx") - F.col("_ky") + 1) / (2 * F.col("n"))
    return found.select(*by, "n", "cells", "mutual_information", (F.col("mutual_information") - bias).alias("corrected"))
