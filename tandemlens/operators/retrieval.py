"""BM25 over an inverted index with score bounds per block, and top-k search that prunes by them.

The index numbers documents in the order of their table and cuts it into ranges; what a term has in a
range is one block: document numbers, weights and the largest of those. A frequent term so has many
blocks of bounded size, and no row or task holds a whole term.

A search first scores documents by each query's rarest terms; the k-th best of their full scores is
what a document must reach. Terms whose bounds together stay below that cannot lift a document into the
result by themselves, so their blocks are not read to find candidates. Of the other terms, ranges
whose block bounds stay below it are left out too. What these terms give a document raises the bar once
more; only candidates that can still reach it are scored in full. Nothing is estimated: the result is
that of scoring every document.

Blocks are made where the documents are and stay there: terms and ranges asked for are sent to them
(if counted to be few), so what is shuffled is one row a query and document, not the postings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandemlens.functions.text import text_or_empty
from tandemlens.operators.ordered import top_per_group
from tandemlens.session import durable, fits_broadcast

K1 = 1.2
B = 0.75
#: Documents of a range.
RANGE = 1024
#: Postings of a query's rarest terms that are looked at first.
SEED = 4096
#: Terms of neighbouring documents that are counted at once.
TERMS_AT_ONCE = 1 << 20
#: Scores count as equal up to this.
SLACK = 1e-9
TERM = r"[\p{L}\p{N}]+"


def terms_of(text: Column) -> Column:
    """Runs of letters and digits of any script, lower-cased; null counts as empty."""
    return F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(TERM), F.lit(0))


@dataclass(frozen=True)
class Index:
    """`docs` (doc_no, doc_id, length), `blocks` (term, range, docs, weights, bound), `terms` (term, df, idf, bound).

    A term may have several blocks in a range, of different documents.
    """

    docs: DataFrame
    blocks: DataFrame
    terms: DataFrame
    span: int


@dataclass(frozen=True)
class Asked:
    """Terms of queries (query_id, term, weight), in all ranges or those of `ranges` (query_id, range) only."""

    terms: DataFrame
    ranges: DataFrame | None = None


def _blocks(span: int, k1: float, b: float, mean: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Function from batches of (doc_no, length, terms) to their blocks."""

    def of_piece(docs: np.ndarray, lengths: np.ndarray, terms: pa.Array) -> pa.RecordBatch:
        coded = terms.dictionary_encode()
        ranges, place = np.unique(docs // span, return_inverse=True)
        row = np.repeat(np.arange(len(docs)), lengths)
        block = place[row] * len(coded.dictionary) + coded.indices.to_numpy()
        found, frequency = np.unique(block * len(docs) + row, return_counts=True)
        block, row = found // len(docs), found % len(docs)
        tf = frequency.astype(np.float64)
        weights = tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[row] / mean))
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        offsets = pa.array(np.append(starts, len(block)), pa.int32())
        return pa.RecordBatch.from_arrays(
            [
                coded.dictionary.take(pa.array(block[starts] % len(coded.dictionary))),
                pa.array(ranges[block[starts] // len(coded.dictionary)]),
                pa.ListArray.from_arrays(offsets, pa.array(docs[row])),
                pa.ListArray.from_arrays(offsets, pa.array(weights)),
                pa.array(np.maximum.reduceat(weights, starts)),
            ],
            ["term", "range", "docs", "weights", "bound"],
        )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, lengths = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_no", "length"))
            ends, at = np.cumsum(lengths), 0
            while at < len(docs):
                read = ends[at] - lengths[at]
                to = max(at + 1, int(np.searchsorted(ends, read + TERMS_AT_ONCE, "right")))
                if ends[to - 1] > read:
                    yield of_piece(docs[at:to], lengths[at:to], batch.column("terms").slice(at, to - at).flatten())
                at = to

    return blocks


def bm25_index(docs: DataFrame, doc_id: str, text: str, k1: float = K1, b: float = B, span: int = RANGE) -> Index:
    """Inverted index of `docs`, written to the shared folder.

    Every row is a document, with or without an id; one without terms counts for the mean length. idf is
    ln(1 + (n - df + 0.5) / (df + 0.5)). One pass reads the texts; its output is the term counts.
    """
    listed = docs.select(F.col(doc_id).alias("doc_id"), terms_of(F.col(text)).alias("terms"))
    numbered = listed.withColumn("doc_no", F.monotonically_increasing_id())
    numbered = durable(numbered.select("doc_no", "doc_id", F.size("terms").alias("length"), "terms"), "bm25-docs")
    sizes = numbered.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    n, mean = sizes["n"], sizes["mean"] or 1.0
    # numbers are dense within a part of the table, so a range holds neighbours
    made = numbered.select("doc_no", "length", "terms").mapInArrow(
        _blocks(span, k1, b, mean), "term string, range long, docs array<long>, weights array<double>, bound double"
    )
    blocks = durable(made, "bm25-blocks")
    df = F.sum(F.size("docs"))
    idf = F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = blocks.groupBy("term").agg(df.alias("df"), F.max("bound").alias("bound")).withColumn("idf", idf)
    return Index(numbered.drop("terms"), blocks, durable(terms, "bm25-terms"), span)


def _near(df: DataFrame) -> DataFrame:
    """`df`, to be sent to the other side of a join if it is counted to be small."""
    return F.broadcast(df) if fits_broadcast(df) else df


def _shares(index: Index, asked: Asked) -> DataFrame:
    """(query_id, doc_no, share): all postings of the blocks asked for."""
    parts = index.blocks.select("term", "range", "docs", "weights")
    parts = parts.join(_near(asked.terms.select("query_id", "term", "weight")), "term")
    if asked.ranges is not None:
        parts = parts.join(_near(asked.ranges), ["query_id", "range"], "left_semi")
    rows = parts.select("query_id", "weight", F.inline(F.arrays_zip("docs", "weights")))
    named = rows.toDF("query_id", "weight", "doc_no", "given")
    return named.select("query_id", "doc_no", (F.col("weight") * F.col("given")).alias("share"))


def _posted(index: Index, asked: Asked) -> DataFrame:
    """(query_id, doc_no, part): sums over all postings of the blocks asked for."""
    return _shares(index, asked).groupBy("query_id", "doc_no").agg(F.sum("share").alias("part"))


def _in_full(index: Index, terms: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, doc_no, score): what `terms` (query_id, term, weight) give to each candidate (query_id, doc_no).

    Blocks of ranges without a candidate are not unpacked.
    """
    pairs = candidates.select("query_id", "doc_no")
    ranges = pairs.select("query_id", F.floor(F.col("doc_no") / index.span).alias("range")).distinct()
    hits = _shares(index, Asked(terms, ranges))
    on, total = ["query_id", "doc_no"], F.sum("share").alias("score")
    if fits_broadcast(pairs):
        return hits.join(F.broadcast(pairs), on, "left_semi").groupBy(*on).agg(total)
    return hits.groupBy(*on).agg(total).join(pairs, on, "left_semi")  # a task's postings are summed before the shuffle


def bm25_search(index: Index, queries: DataFrame, k: int, query_id: str = "query_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents of each query among those that share a term with it.

    A term that a query repeats counts as often. Ties (equal to nine digits) go to the smaller doc_id, then to
    the document that comes first. Query ids must be unique and not null. A query without a term of the index
    gives no row. Scores are rounded to nine digits.
    """
    listed = queries.select(F.col(query_id).alias("query_id"), F.explode(terms_of(F.col(text))).alias("term"))
    counted = listed.groupBy("query_id", "term").count()
    asked = index.terms.join(_near(counted), "term").select(
        "query_id",
        "term",
        "df",
        (F.col("count") * F.col("idf")).alias("weight"),
        (F.col("count") * F.col("idf") * F.col("bound")).alias("most"),
    )
    asked = durable(asked, "bm25-asked")

    # rarest terms first, until they have `seed` postings and k at least
    rare = Window.partitionBy("query_id").orderBy("df", "term")
    before = F.sum("df").over(rare) - F.col("df")
    seeds = asked.withColumn("before", before).filter((F.col("before") < k) | (F.col("before") + F.col("df") <= seed))
    order = [F.desc("part"), F.col("doc_no")]
    first = durable(top_per_group(_posted(index, Asked(seeds)), ["query_id"], order, k), "bm25-first")
    known = _in_full(index, asked, first)
    least = F.when(F.count("*") >= k, F.min("score") - SLACK).otherwise(F.lit(0.0)).alias("least")
    reached = durable(known.groupBy("query_id").agg(least), "bm25-least")
    weak = Window.partitionBy("query_id").orderBy("most", "term")
    placed = asked.join(_near(reached), "query_id").withColumn("sum", F.sum("most").over(weak))
    placed = durable(placed.withColumn("needed", F.col("sum") >= F.col("least")), "bm25-placed")
    needed, other = placed.filter("needed"), placed.filter("NOT needed")
    others = F.sum(F.when(F.col("needed"), 0.0).otherwise(F.col("most"))).alias("others")
    bars = _near(placed.groupBy("query_id").agg(F.first("least").alias("least"), others))

    # ranges in which the needed terms' blocks, with all the other terms, can reach it
    bounds = index.blocks.select("term", "range", F.col("bound").alias("block")).join(_near(needed.select("query_id", "term", "weight")), "term")
    can = bounds.groupBy("query_id", "range").agg(F.sum(F.col("weight") * F.col("block")).alias("can"))
    open_ = can.join(bars, "query_id").filter(F.col("can") + F.col("others") >= F.col("least"))
    open_ = durable(open_.select("query_id", "range"), "bm25-open")

    parts = _posted(index, Asked(needed, open_)).join(bars, "query_id")
    able = durable(parts.filter(F.col("part") + F.col("others") >= F.col("least")), "bm25-candidates")
    # a full score is no less than its part, so the k-th best part is a bar too
    best = top_per_group(able.select("query_id", "doc_no", "part"), ["query_id"], order, k)
    bar = best.filter(F.col("rank") == k).select("query_id", (F.col("part") - SLACK).alias("bar"))
    higher = able.join(_near(bar), "query_id", "left")
    higher = higher.filter(F.col("part") + F.col("others") >= F.coalesce("bar", F.lit(0.0)))
    higher = durable(higher.select("query_id", "doc_no", "part"), "bm25-higher")
    rest = _in_full(index, other, higher)
    scored = higher.join(rest, ["query_id", "doc_no"], "left").select(
        "query_id", "doc_no", F.round(F.col("part") + F.coalesce("score", F.lit(0.0)), 9).alias("score")
    )
    # ids decide between equal scores only, so they are looked up for the best and what ties with them
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"))
    tied = scored.withColumn("place", F.rank().over(by_score)).filter(F.col("place") <= k).drop("place")
    named = index.docs.select("doc_no", "doc_id").join(_near(durable(tied, "bm25-tied")), "doc_no")
    order = [F.desc("score"), F.col("doc_id"), F.col("doc_no")]
    return top_per_group(named, ["query_id"], order, k).select("query_id", "rank", "doc_id", "score")
