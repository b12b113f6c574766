"""Packing of tokenised documents into windows of fixed length, best fit decreasing.

A document longer than a window is first cut into full windows, each a sequence of its own. What
is left of every document is packed best fit decreasing: a segment tree indexed by remaining
capacity finds the tightest open window. Packing runs in groups of rows dealt out evenly, large
enough (2^16 pieces) that their last, half-filled windows do not count.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from struct import pack as pack_ids

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemlens.llm.pretokens import Chunks, fast, load, plain, tokenizer_path
from tandemlens.llm.registry import query
from tandemlens.session import durable
from tandemlens.sources.tables import table

WINDOW = 2048
END = 1
GROUP = 1 << 16

# Fixed value: the pattern of the word-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit bytes, as the library gives them.

    A text is cut into words by the tokenizer's own pattern, and each word is encoded once.
    """

    def __init__(self, path: str):
        self.path, self.tokenizer = path, load(path)
        self.model = self.tokenizer.model
        self.words, self.cut = Chunks(self._word, "packing"), fast(PATTERN).findall

    def _library(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return pack_ids(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        if not (word.isascii() and word.isprintable()):
            return self._library(word)
        ids = [token.id for token in self.model.tokenize(word)]  # nothing to normalise or to map to bytes
        return pack_ids(f"<{len(ids)}I", *ids)

    def __call__(self, text: str) -> bytes:
        if not plain(text, self.path):
            return self._library(text)
        self.words.trim()
        return b"".join(map(self.words.__getitem__, self.cut(text.lower())))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for all tasks of a worker, which so keeps the words it has met."""
    return Encoder(path)


def pieces(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): full windows of each text, and its rest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), np.array([END], "<u4").tobytes()
        for batch in batches:
            at, starts, lengths, sums, totals = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = memoryview(encode(text or "") + end)
                total = len(ids) // 4
                for start in range(0, total, window):
                    part = ids[4 * start : 4 * (start + window)]
                    at.append(i)
                    starts.append(start)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
                    totals.append(total)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64()))]
                + [pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        cut, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    )


class OpenWindows:
    """Segment tree over remaining capacities: counts of open windows below each node."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, n: int) -> None:
        node = self.leaves + capacity
        while node:
            self.counts[node] += n
            node >>= 1

    def push(self, capacity: int, number: int) -> None:
        self.windows[capacity].append(number)
        self._add(capacity, 1)

    def tightest(self, length: int) -> tuple[int, int] | None:
        """(capacity, number) of an open window with the least capacity of at least `length`."""
        node = self.leaves + length
        if not self.counts[node]:
            while node & 1 or not self.counts[node + 1]:  # the next subtree to the right
                node >>= 1
                if node <= 1:
                    return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.counts[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._add(capacity, -1)
        return capacity, self.windows[capacity].pop()


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset for each length (1 to `window`), longest first."""
    numbers, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, used = OpenWindows(window), 0
    for i in np.argsort(-lengths, kind="stable"):
        length = int(lengths[i])
        found = tree.tightest(length)
        if found is None:
            found, used = (window, used), used + 1
        capacity, number = found
        numbers[i], offsets[i] = number, window - capacity
        if capacity > length:
            tree.push(capacity - length, number)
    return numbers, offsets


def pack(docs: DataFrame, path: str, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """The pieces of all documents with sequence_id and offset.

    Edge cases: a null or empty text is the end id alone; rows with the same or without an id are
    packed each by itself; an empty table gives no row. Columns other than doc_id and text are not read.
    """
    cut = durable(pieces(docs, path, window), "pieces")
    full = cut.filter(F.col("length") == window).withColumns(
        {"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("bigint")}
    )
    rest = cut.filter(F.col("length") < window)
    groups = -(-rest.count() // group) or 1

    def packed(part: pd.DataFrame) -> pd.DataFrame:
        numbers, offsets = best_fit(part["length"].to_numpy(), window)
        # full windows have ids from 0, packed ones ids below 0
        return part.assign(sequence_id=-1 - (numbers * groups + part["dealt"].iloc[0]), offset=offsets)[columns]

    columns = full.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in full.dtypes)
    dealt = rest.withColumn("dealt", F.pmod(F.monotonically_increasing_id(), F.lit(groups)))
    return full.unionByName(dealt.groupBy("dealt").applyInPandas(packed, schema))


@query()
def op8_packing(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select("doc_id", "text")
    return pack(docs, tokenizer_path("word_bpe_49k.json"))
