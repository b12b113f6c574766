"""Hard negatives of labelled vectors: rows of another label that score just below a positive.

A vector is rotated several times and only the signs are kept: one bit a coordinate. With them go the
alignment of the vector with what its signs decode to, and the length of what is left over. For an
anchor whose rotated coordinates are rounded to a few bits, popcounts give its product with the decoded
signs; the rest is bounded by Cauchy-Schwarz on the two residuals. So each pair has an interval that
holds its score for certain. Pairs whose interval cannot reach the rows looked for are left out, all
others are scored in integers: the result is exact.

Anchors are taken in blocks of bounded size, each broadcast to one pass over the table of codes; a
task keeps the best few rows of each anchor, and those are merged by anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemlens.llm.registry import query
from tandemlens.operators.ordered import top_per_group
from tandemlens.session import durable
from tandemlens.sources.tables import table

#: Rotations, each of which gives one bit a coordinate; intervals narrow with their root.
ROTATIONS = 4
#: Bits of an anchor's rounded coordinates.
PLANES = 4
SEED = 7
#: Anchors of one pass: at 64 dimensions they take 17 MB in each worker.
BLOCK = 1 << 15
#: Pairs that are held against each other at once.
PAIRS = 1 << 20
#: Rows of the first piece of a task, which only gives its anchors something to beat.
FIRST = 128
POSITIVES = 5
NEGATIVES = 3
SCALE = 256

NONE = -(1 << 63)
NO_ID = (1 << 63) - 1


@lru_cache(maxsize=2)
def rotation(dims: int) -> np.ndarray:
    """ROTATIONS random orthogonal maps of `dims` coordinates, padded to full words of 64."""
    rng, wide = np.random.default_rng(SEED), -(-dims // 64) * 64
    return np.vstack([np.linalg.qr(rng.standard_normal((wide, wide)))[0][:, :dims] for _ in range(ROTATIONS)])


def matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """floor(256 x) of every component, one row a vector; what a shorter vector lacks is 0."""
    flat = np.asarray(lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False))
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), dims))
    if len(flat):
        row = np.repeat(np.arange(len(sizes)), sizes)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.floor(SCALE * flat)
    return out


def codes_of(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sign words, alignment with the decoded signs, length of the rest, length of the decoded signs."""
    turn = rotation(vectors.shape[1])
    signs = vectors @ turn.T > 0
    decoded = np.where(signs, 1.0, -1.0) @ turn
    size = np.einsum("ij,ij->i", decoded, decoded)
    align = np.einsum("ij,ij->i", decoded, vectors) / np.where(size > 0, size, 1)
    rest = np.linalg.norm(vectors - align[:, None] * decoded, axis=1)
    words = np.packbits(signs, axis=1, bitorder="little").view("<u8")
    return words, align, rest, np.sqrt(size)


class Anchors:
    """Anchors of a block, rotated and rounded; `low` and `high` bound the scores looked for, a column a search."""

    def __init__(self, vectors, labels, rows, low=None, high=None):
        self.vectors, self.labels, self.rows = vectors, labels, rows
        self.low, self.high = low, high
        turned = vectors @ rotation(vectors.shape[1]).T
        least, most = turned.min(axis=1), turned.max(axis=1)
        self.step = np.maximum((most - least) / ((1 << PLANES) - 1), 1e-300)
        self.least = least
        units = np.rint((turned - least[:, None]) / self.step[:, None]).astype(np.uint8)
        rounded = least[:, None] + units * self.step[:, None]
        self.total = rounded.sum(axis=1)
        self.off = np.abs(turned - rounded).sum(axis=1)
        self.norm = np.linalg.norm(vectors, axis=1)
        planes = [np.packbits(units >> j & 1, axis=1, bitorder="little").view("<u8") for j in range(PLANES)]
        self.planes = np.stack(planes, axis=1)

    def interval(self, at: np.ndarray, words, ones, align, rest, size, norm) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the scores of anchors `at` (down) with rows (across)."""
        hits = np.zeros((len(at), len(words)), np.int32)
        for j in range(PLANES):
            for w in range(words.shape[1]):
                hits += np.bitwise_count(self.planes[at, j, w][:, None] & words[None, :, w]).astype(np.int32) << j
        along = 2 * (self.least[at, None] * ones + self.step[at, None] * hits) - self.total[at, None]
        sure = np.maximum(np.abs(along) - self.off[at, None], 0) / np.where(size > 0, size, 1)
        beside = np.sqrt(np.maximum(self.norm[at, None] ** 2 - sure**2, 0))
        around = np.abs(align) * self.off[at, None] + rest * beside + 1e-9 * self.norm[at, None] * norm + 1e-6
        middle = align * along
        return middle - around, middle + around


def scores(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Integer inner products, row by row; one that does not fit in 64 bits is an error."""
    bound = np.sqrt(np.einsum("ij,ij->i", one, one).max(initial=0) * np.einsum("ij,ij->i", other, other).max(initial=0))
    if bound < 2**53:
        return np.einsum("ij,ij->i", one, other).astype(np.int64)
    exact = [sum(int(x) * int(y) for x, y in zip(a, b)) for a, b in zip(one.tolist(), other.tolist())]
    if any(abs(s) >= 1 << 63 for s in exact):
        raise OverflowError("an inner product does not fit in 64 bits")
    return np.array(exact, np.int64)


class Best:
    """The best `k` rows so far of each (anchor, search): higher scores first, then smaller ids, then rows."""

    def __init__(self, anchors: int, searches: int, k: int):
        shape = (anchors * searches, k)
        self.searches, self.k = searches, k
        self.score, self.id = np.full(shape, NONE, np.int64), np.full(shape, NO_ID, np.int64)
        self.row = np.full(shape, NO_ID, np.int64)

    def least(self) -> np.ndarray:
        """What a row must score at least to get in."""
        return self.score[:, -1].reshape(-1, self.searches)

    def add(self, place: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """`place` is anchor * searches + search; rows come once each."""
        touched = np.unique(place)
        place = np.concatenate([np.repeat(touched, self.k), place])
        score = np.concatenate([self.score[touched].ravel(), score])
        ids = np.concatenate([self.id[touched].ravel(), ids])
        rows = np.concatenate([self.row[touched].ravel(), rows])
        order = np.lexsort((rows, ids, ~score, place))  # ~ turns the order round and cannot overflow
        starts = np.searchsorted(place[order], touched)
        chosen = order[starts[:, None] + np.arange(self.k)]
        self.score[touched], self.id[touched], self.row[touched] = score[chosen], ids[chosen], rows[chosen]


def search(anchors: Anchors, best: Best, same: bool, part: dict[str, np.ndarray]) -> int:
    """Hold a piece of the table against all anchors; returns how many pairs had to be scored."""
    scored = 0
    labels = np.intersect1d(part["label"], anchors.labels) if same else [None]
    for label in labels:
        rows = np.flatnonzero(part["label"] == label) if same else np.arange(len(part["label"]))
        own = np.flatnonzero(anchors.labels == label) if same else np.arange(len(anchors.labels))
        step = max(1, PAIRS // max(len(rows), 1))
        few = {name: values[rows] for name, values in part.items()}
        for start in range(0, len(own), step):
            at = own[start : start + step]
            low, high = anchors.interval(
                at, few["words"], few["ones"], few["align"], few["rest"], few["size"], few["norm"]
            )
            floor = np.maximum(best.least()[at], anchors.low[at])
            ceiling = anchors.high[at]
            open_ = np.zeros(low.shape, bool)
            for j in range(best.searches):
                useful = (floor[:, j] <= ceiling[:, j])[:, None]
                open_ |= useful & ~((high < floor[:, j, None]) | (low > ceiling[:, j, None]))
            open_ &= few["row"][None, :] != anchors.rows[at, None]
            if not same:
                open_ &= few["label"][None, :] != anchors.labels[at, None]
            down, across = np.nonzero(open_)
            scored += len(down)
            for begin in range(0, len(down), 1 << 15):
                d, a = down[begin : begin + (1 << 15)], across[begin : begin + (1 << 15)]
                exact = scores(anchors.vectors[at[d]], few["vectors"][a])
                for j in range(best.searches):
                    fits = (exact >= floor[d, j]) & (exact <= ceiling[d, j])
                    if fits.any():
                        best.add(
                            at[d[fits]] * best.searches + j, exact[fits], few["id"][a[fits]], few["row"][a[fits]]
                        )
    return scored


def parts_of(batch: pa.RecordBatch, dims: int) -> dict[str, np.ndarray]:
    """Arrays of a batch of the table of codes."""
    column = {name: batch.column(name) for name in batch.schema.names}
    code = column["code"]
    words = np.frombuffer(b"".join(code.to_pylist()), "<u8").reshape(len(code), -1)
    vectors = matrix(column["embedding"], dims)
    found = {n: column[n].to_numpy(zero_copy_only=False) for n in ("id", "row", "label", "align", "rest", "size")}
    return found | {
        "words": words,
        "ones": np.bitwise_count(words).sum(axis=1).astype(np.int32),
        "vectors": vectors,
        "norm": np.linalg.norm(vectors, axis=1),
    }


def seek(coded: DataFrame, held, dims: int, same: bool, k: int, counted=None) -> DataFrame:
    """(anchor, search, place, id, row, score): the first k rows of each search of the anchors in `held`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(**held.value)
        best, scored, piece = Best(len(anchors.rows), anchors.low.shape[1], k), 0, FIRST
        for batch in batches:
            whole, start = parts_of(batch, dims), 0
            while start < batch.num_rows:
                scored += search(anchors, best, same, {n: v[start : start + piece] for n, v in whole.items()})
                start, piece = start + piece, min(2 * piece, 4096)
        if counted is not None:
            counted.add(scored)
        place, slot = np.nonzero(best.score != NONE)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(anchors.rows[place // best.searches]),
                pa.array(place % best.searches, pa.int32()),
                pa.array(best.score[place, slot]),
                pa.array(best.id[place, slot]),
                pa.array(best.row[place, slot]),
            ],
            ["anchor", "search", "score", "id", "row"],
        )

    found = coded.mapInArrow(run, "anchor bigint, search int, score bigint, id bigint, row bigint")
    order = [F.desc("score"), F.col("id"), F.col("row")]
    return top_per_group(found, ["anchor", "search"], order, k, rank="place")


def encoded(vectors: DataFrame) -> tuple[DataFrame, int]:
    """Table of codes of `vectors` (vec_id, label, embedding, is_anchor), and the number of dimensions."""
    x = F.col("embedding")
    sound = x.isNotNull() & F.col("label").isNotNull()
    sound &= ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.filter(sound).select(
        F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("id"),
        F.col("label").cast("long").alias("label"),
        "embedding",
        F.coalesce("is_anchor", F.lit(False)).alias("is_anchor"),
    )
    dims = max(rows.agg(F.max(F.size("embedding")).alias("n")).first()["n"] or 1, 1)
    kind = dict(rows.dtypes)["embedding"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, align, rest, size = codes_of(matrix(batch.column(2), dims))
            code = pa.array([w.tobytes() for w in words], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, code, pa.array(align), pa.array(rest), pa.array(size)],
                ["id", "label", "embedding", "is_anchor", "code", "align", "rest", "size"],
            )

    schema = f"id bigint, label bigint, embedding {kind}, is_anchor boolean, code binary, align double, rest double, size double"
    return durable(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "codes"), dims


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = 50,
    high: int = 95,
    block: int = BLOCK,
    counted=None,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of `vectors` (vec_id, label, embedding).

    A score is the inner product of floor(256 x). An anchor's positives are its best `positives` other
    rows of its label; each of them takes the best `negatives` rows of other labels whose score is from
    `low` to `high` percent of its own.

    Edge cases: rows with a null label, a null vector or a component that is null or not finite take no
    part. Ties go to the smaller vec_id, then to the row that comes first in the table of codes; rows with the
    same id are rows of their own, and equal anchors are each answered. A row without an id is no anchor
    by an id's value, comes last among ties and is given back as null (as would be the id 2^63 - 1). Vectors
    of different lengths count as padded with zeros; an empty one scores 0. A score beyond 64 bits is an
    error. Empty tables give no row; other columns are not read. `counted`, an accumulator, gets the number of
    pairs that were scored.
    """
    spark = vectors.sparkSession
    marked = vectors.select("vec_id", "label", "embedding", anchor.alias("is_anchor"))
    coded, dims = encoded(marked)
    chosen = coded.filter("is_anchor")
    blocks = max(-(-chosen.count() // block), 1)
    dealt = F.pmod(F.xxhash64("row"), F.lit(blocks))
    coded = coded.drop("is_anchor")
    results = []
    for b in range(blocks):
        of_block = chosen.filter(dealt == b).select("row", "label", "embedding").toArrow().combine_chunks()
        rows = of_block.column("row").to_numpy()
        if not len(rows):
            continue
        labels = of_block.column("label").to_numpy()
        values = matrix(of_block.column("embedding").combine_chunks(), dims)
        one = np.ones((len(rows), 1), np.int64)
        all_of = {"vectors": values, "labels": labels, "rows": rows}
        held = spark.sparkContext.broadcast(all_of | {"low": one * (NONE + 1), "high": one * NO_ID})
        near = durable(seek(coded, held, dims, True, positives, counted), "positives")
        held.destroy()
        bounds = near.select("anchor", "place", "score").toArrow()  # at most `positives` for each anchor
        at = np.argsort(rows)
        at = at[np.searchsorted(rows[at], bounds.column("anchor").to_numpy())]
        lows, highs = np.zeros((len(rows), positives), np.int64), np.full((len(rows), positives), -1, np.int64)
        place, score = bounds.column("place").to_numpy() - 1, bounds.column("score").to_pylist()
        lows[at, place] = [-(-low * s // 100) for s in score]
        highs[at, place] = [high * s // 100 for s in score]
        held = spark.sparkContext.broadcast(all_of | {"low": lows, "high": highs})
        far = durable(seek(coded, held, dims, False, negatives, counted), "negatives")
        held.destroy()
        ids = chosen.filter(dealt == b).select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
        pairs = near.select(
            "anchor", (F.col("place") - 1).alias("search"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
        )
        mined = far.select(
            "anchor", "search", F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score")
        )
        results.append(mined.join(pairs, ["anchor", "search"]).join(ids, "anchor"))
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    if not results:
        kinds = ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
        return spark.createDataFrame([], ", ".join(f"{c} {k}" for c, k in zip(columns, kinds)))
    mined = results[0].select(columns)
    for more in results[1:]:
        mined = mined.unionByName(more.select(columns))
    return mined.withColumns({c: F.nullif(c, F.lit(NO_ID)) for c in columns if c.endswith("_id")})


@query(
    """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id
  ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM s JOIN p USING (anchor_id) WHERE NOT same AND 100 * score BETWEEN 50 * positive_score AND 95 * positive_score
QUALIFY rank <= 3"""
)
def op13_hard_negatives(spark: SparkSession, root: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, root, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return hard_negatives(vectors, F.col("vec_id") % 50 == 0)
