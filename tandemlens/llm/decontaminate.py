"""Benchmark decontamination: documents that contain a benchmark item within a few word edits.

An item of n words within e edits is cut into e + 1 pieces of almost equal length. An edit touches
one piece at most, so one of the pieces stands in the document unchanged: every contained item is
found, however long. The pieces have two to five words; documents are searched for them by
hashes from every word, and what shares a piece is verified by the exact edit distance of the
item to the words around it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemlens.llm.common import packed, small, unpacked
from tandemlens.llm.pretokens import Chunks
from tandemlens.llm.registry import query
from tandemlens.session import durable
from tandemlens.sources.tables import table

#: An item is contained if at most this share of its words has to be edited.
EDITS = 0.2
#: Items with fewer words cannot tell a passage from chance; they are not searched.
MIN_WORDS = 5
#: Words of the items that one scan over the documents searches for; more items take more scans.
BLOCK_WORDS = 500_000
BITMAP_BITS = 22
#: Words of the texts that are embedded together.
TOGETHER = 1 << 19
#: Candidates that are held together.
CANDIDATES = 1 << 20

_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def symbols_of(chunk: str) -> bytes:
    """64-bit hashes of the lower-cased words of a chunk (punctuation apart), one after another."""
    chunk = chunk.lower()
    bare = chunk.rstrip(".,;:!?")
    words = (bare,) if bare.isalnum() else _WORD.findall(chunk)
    return b"".join([xxhash.xxh64_digest(w.encode("utf-8", "surrogatepass")) for w in words])


@lru_cache(maxsize=1)
def chunk_symbols() -> Chunks:
    """Word hashes of the chunks that a worker has met in any of its tasks."""
    return Chunks(symbols_of, "symbols")


def words_of(text: str, chunks: Chunks) -> np.ndarray:
    chunks.trim()
    return np.frombuffer(b"".join(map(chunks.__getitem__, text.split())), np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def most_edits(n: int) -> int:
    """Edits within which an item of n words is contained."""
    return int(EDITS * n)


def pieces(n: int) -> list[tuple[int, int]]:
    """(first word, words) of the pieces of an item of n words: one more than its edits."""
    cuts = [k * n // (most_edits(n) + 1) for k in range(most_edits(n) + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def run_keys(words: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(size, keys) for each of the sizes, in order: a hash of so many words from every word."""
    keys = np.zeros(len(words), np.uint64)
    for size in range(1, max(sizes, default=0) + 1):
        if size > len(words):
            return
        keys = mixed((keys[: len(words) - size + 1] ^ words[size - 1 :]) * _ODD)
        if size in sizes:
            yield size, keys


class Items:
    """A block of benchmark items with the hashes of their windows, for one scan."""

    def __init__(self, rows: list[tuple[object, str]]):
        chunks = chunk_symbols()
        self.ids, self.words = [], []
        for item_id, text in rows:
            words = words_of(text, chunks)
            if len(words) >= MIN_WORDS:
                self.ids.append(item_id)
                self.words.append(words)
        found: dict[int, list[tuple[int, int, int]]] = {}
        for i, words in enumerate(self.words):
            cut = pieces(len(words))
            keys = dict(run_keys(words, sorted({size for _, size in cut})))
            for start, size in cut:
                found.setdefault(size, []).append((int(keys[size][start]), i, start))
        self.tables = {}
        for size, rows_ in found.items():
            keys = np.array([r[0] for r in rows_], np.uint64)
            order = np.argsort(keys, kind="stable")
            items, starts = (np.array([r[k] for r in rows_], np.int64)[order] for k in (1, 2))
            bitmap = np.zeros(1 << BITMAP_BITS, bool)
            bitmap[keys >> np.uint64(64 - BITMAP_BITS)] = True
            self.tables[size] = (keys[order], items, starts, np.packbits(bitmap))
        self.patterns = [pattern(w) for w in self.words]
        self.bitmaps: dict = {}

    def candidates(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(item, word where it would begin, word where its piece stands), some at a time."""
        for size, found in run_keys(words, sorted(self.tables)):
            keys, items, offsets, bits = self.tables[size]
            if size not in self.bitmaps:
                self.bitmaps[size] = np.unpackbits(bits).view(bool)
            hits = np.flatnonzero(self.bitmaps[size][found >> np.uint64(64 - BITMAP_BITS)])
            first = np.searchsorted(keys, found[hits], "left")
            count = np.searchsorted(keys, found[hits], "right") - first
            hits, first, count = hits[count > 0], first[count > 0], count[count > 0]
            ends, low = np.cumsum(count), 0
            while low < len(hits):
                before = ends[low] - count[low]
                high = max(low + 1, int(np.searchsorted(ends, before + CANDIDATES, "right")))
                n = count[low:high]
                row = np.repeat(first[low:high], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(hits[low:high], n)
                yield items[row], at - offsets[row], at
                low = high

    def matches(self, texts: list[np.ndarray]) -> dict[tuple[int, int], int]:
        """Least edit distance by (text, item), for items that are within their share of edits."""
        ends = np.cumsum([len(t) + 1 for t in texts])  # a word that stands nowhere lies between texts
        first = ends - [len(t) + 1 for t in texts]
        words = np.concatenate([np.append(t, np.uint64(0)) for t in texts])
        best: dict[tuple[int, int], int] = {}
        for item, begin, at in self.candidates(words):
            self.verify(words, first, ends, item, begin, np.searchsorted(ends, at, "right"), best)
        return best

    def verify(
        self,
        words: np.ndarray,
        first: np.ndarray,
        ends: np.ndarray,
        item: np.ndarray,
        begin: np.ndarray,
        text: np.ndarray,
        best: dict[tuple[int, int], int],
    ) -> None:
        """Enter into `best` the distances of the candidates (text, item, begin) that are matches."""
        last: tuple[int, int, int] | None = None
        for k in np.lexsort((begin, item, text)).tolist():
            t, i, at = int(text[k]), int(item[k]), int(begin[k])
            n = len(self.words[i])
            most = most_edits(n)
            slack = most + 2
            if last and last[:2] == (t, i) and at - last[2] <= slack // 2 or best.get((t, i)) == 0:
                continue  # that stretch has been looked at
            last = t, i, at
            low, high = max(first[t], at - 2 * slack), min(ends[t] - 1, at + n + 2 * slack)
            part = words[low:high].tolist()
            places = self.patterns[i]
            if len(places) - len(places.keys() & set(part)) > most:  # each of these words needs an edit
                continue
            distance = edit_distance(places, n, part)
            if distance <= most:
                best[t, i] = min(distance, best.get((t, i), distance))

    def __getstate__(self):
        return self.__dict__ | {"bitmaps": {}}


def pattern(words: np.ndarray) -> dict[int, int]:
    """For each word of an item the positions it stands on, as bits."""
    out: dict[int, int] = {}
    for i, w in enumerate(words.tolist()):
        out[w] = out.get(w, 0) | 1 << i
    return out


def edit_distance(places: dict[int, int], n: int, text: list[int]) -> int:
    """Least word edit distance between an item of n words and any stretch of `text` (bit-parallel)."""
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    best = score
    for word in text:
        equal = places.get(word, 0)
        vertical = equal | down
        horizontal = (((equal & up) + up) ^ up) | equal
        more = down | (full & ~(horizontal | up))
        less = up & horizontal
        score += bool(more & top) - bool(less & top)
        more, less = more << 1 & full, less << 1 & full
        up = less | (full & ~(vertical | more))
        down = more & vertical
        best = min(best, score)
    return best


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of bounded size; one block at a time is on the driver."""
    block, words = [], 0
    for row in benchmark.select("item_id", "text").filter("text IS NOT NULL").toLocalIterator():
        block.append((row["item_id"], row["text"]))
        words += row["text"].count(" ") + 1
        if words >= BLOCK_WORDS:
            yield block
            block, words = [], 0
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance): items that a document contains, with the least edit distance.

    Edge cases: null and empty texts and items match nothing, as do items of fewer than MIN_WORDS words.
    Rows with the same id, or without one, count as one document. Equal items are found
    under each of their ids. An empty table on either side gives no row. Columns other than
    doc_id, item_id and text are not read.
    """
    spark, kinds = docs.sparkSession, dict(docs.dtypes) | dict(benchmark.dtypes)
    schema = f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, distance int"
    item_type = benchmark.select("item_id").schema

    def scan(block: list[tuple[object, str]]) -> DataFrame:
        held = spark.sparkContext.broadcast(Items(block))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items, chunks = held.value, chunk_symbols()
            for batch in batches:
                at, ids, distances = [], [], []

                def flush(rows: list[int], texts: list[np.ndarray]) -> None:
                    for (t, item), distance in items.matches(texts).items() if texts and items.words else ():
                        at.append(rows[t])
                        ids.append(items.ids[item])
                        distances.append(distance)

                rows, texts, size = [], [], 0
                for i, text in enumerate(batch.column(1).to_pylist()):
                    words = words_of(text or "", chunks)
                    if len(words) < MIN_WORDS - 1:
                        continue
                    rows.append(i)
                    texts.append(words)
                    size += len(words)
                    if size >= TOGETHER:
                        flush(rows, texts)
                        rows, texts, size = [], [], 0
                flush(rows, texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at, pa.int64())),
                        pa.array(ids, arrow_type),
                        pa.array(distances, pa.int32()),
                    ],
                    ["doc_id", "item_id", "distance"],
                )

        return docs.select("doc_id", "text").mapInArrow(search, schema)

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_type = to_arrow_type(item_type[0].dataType)
    found = [scan(block) for block in blocks(benchmark)]
    if not found:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that contain no item; rows without an id go if one of them does contain one."""
    bad = durable(leaks(docs, benchmark).select(F.col("doc_id").alias("leaks_in")).distinct(), "leaking")
    kept = packed(docs, doc_id=F.col("doc_id")).join(small(bad), F.col("doc_id").eqNullSafe(F.col("leaks_in")), "left_anti")
    return unpacked(kept, docs.columns)


@query()
def op2_decontamination(spark: SparkSession, root: str) -> DataFrame:
    found = leaks(table(spark, root, "documents"), table(spark, root, "benchmark"))
    return found.withColumn("distance", F.col("distance").cast("long"))
