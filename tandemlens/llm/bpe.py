"""Byte-level BPE from a table of merge ranks: whole texts to token ids, and ids back to bytes.

A pre-token is merged with a rank queue: one bucket of positions for each merge rank, and above the
buckets a bitmap of two levels whose first set bit gives the next rank. Positions are starts of
tokens in a linked list; an entry whose pair has changed meanwhile is skipped when it comes up. A
merge costs a few steps whatever the length, so a pre-token of a whole text is no special case.

Pre-tokens that a worker has met are kept, up to a number of bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemlens.llm.pretokens import common, fast, tokenizer_path
from tandemlens.llm.registry import query
from tandemlens.sources.tables import table

#: Bytes of pre-tokens and their ids that a worker remembers before it starts anew.
CACHE_BYTES = 80 << 20
#: What an entry takes besides its text and ids: two objects, and its place in a dict.
ENTRY_BYTES = 190


@lru_cache(maxsize=2)
def merge_ranks(path: str) -> dict[bytes, int]:
    """Token -> rank, which is also its id, from lines of base64 and number."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Merges:
    """Ids of pre-tokens by one table of ranks.

    The rank queue is written out in place, as calls would cost more than its steps. `buckets` has the
    positions of each rank as a heap, `groups` a bit for each rank in use, 256 to a group, and `top` a bit for
    each group in use. All are empty between two pre-tokens.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.groups = [0] * ((max(ranks.values(), default=0) >> 8) + 1)
        self.bit = [1 << i for i in range(max(256, len(self.groups)))]

    def __call__(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        get, groups, bit = self.ranks.get, self.groups, self.bit
        buckets, top, n = {}, 0, len(piece)
        after, before = list(range(1, n + 2)), list(range(-1, n))  # starts of the next and the last token
        pair = [-1] * (n + 1)  # rank of the pair that starts here
        for at in range(n - 1):
            rank = get(piece[at : at + 2])
            if rank is None:
                continue
            pair[at] = rank
            if rank in buckets:
                buckets[rank].append(at)
            else:
                buckets[rank] = [at]
                top |= bit[rank >> 8]
                groups[rank >> 8] |= bit[rank & 255]
        while top:
            group = (top & -top).bit_length() - 1
            used = groups[group]
            rank = group << 8 | (used & -used).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                at = heappop(bucket)
            else:
                at = bucket[0]
                del buckets[rank]
                groups[group] = used = used & (used - 1)
                if not used:
                    top &= top - 1
            if pair[at] != rank:
                continue  # stale
            gone = after[at]
            end = after[gone]
            last = before[at]
            after[at], before[end], pair[gone] = end, at, -1
            for start, stop in ((last, end), (at, after[end])) if end < n else ((last, end),):
                if start < 0:
                    continue
                rank = get(piece[start:stop])
                if rank is None:
                    pair[start] = -1
                    continue
                pair[start] = rank
                if rank in buckets:
                    heappush(buckets[rank], start)
                else:
                    buckets[rank] = [start]
                    top |= bit[rank >> 8]
                    groups[rank >> 8] |= bit[rank & 255]
            if end == n:
                pair[at] = -1
        ids, at = [], 0
        while at < n:
            ids.append(self.ranks[piece[at : after[at]]])  # a byte that has no rank is an error
            at = after[at]
        return ids


class Encoder(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit bytes; called with a text, the ids of the whole text.

    Pre-tokens are kept in two dicts: when this one has grown to half of `most` bytes, it takes the place of
    the older one, which is let go. What is asked for again in time stays.
    """

    def __init__(self, path: str, pattern: str, most: int = CACHE_BYTES):
        super().__init__()
        self.merged, self.most = Merges(merge_ranks(path)), most
        self.cut, self.fast = regex.compile(pattern).findall, fast(pattern).findall
        self.old: dict[str, bytes] = {}
        self.held = 0

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            ids = self.merged(word.encode())
            found = pack(f"<{len(ids)}I", *ids)
        if 2 * self.held >= self.most:
            self.old, self.held = dict(self), 0
            self.clear()
        self.held += len(word) + len(found) + ENTRY_BYTES
        self[word] = found
        return found

    def __call__(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.fast(text) if common(text) else self.cut(text)))


@lru_cache(maxsize=1)
def encoder(path: str, pattern: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) for every row of `docs` (doc_id, text); ids are little-endian unsigned 32-bit bytes.

    Each match of `pattern`, whose only classes are L and N, is merged by itself.

    Edge cases: a null text counts as empty and has no ids; rows with the same id or none are encoded each
    by itself; an empty table gives no row; columns other than doc_id and text are not read. Of pairs
    of one rank the leftmost merges first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path, pattern)
        for batch in batches:
            ids = pa.array([ids_of(text or "") for text in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids binary")


@lru_cache(maxsize=1)
def tokens_by_id(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens one after the other, and the start and length of each id's; unused ids have length -1."""
    ranks = merge_ranks(path)
    lengths = np.full(max(ranks.values(), default=-1) + 1, -1, np.int64)
    starts, data = np.zeros_like(lengths), b"".join(ranks)
    for token, (rank, end) in zip(ranks, zip(ranks.values(), np.cumsum([len(t) for t in ranks]))):
        lengths[rank], starts[rank] = len(token), end - len(token)
    return np.frombuffer(data, np.uint8), starts, lengths


def bytes_of(ids: bytes, path: str) -> bytes:
    """The tokens of all ids, joined; an id that is not in the table is an error."""
    data, starts, lengths = tokens_by_id(path)
    ids = np.frombuffer(ids, "<u4").astype(np.int64)
    if not len(ids):
        return b""
    size = lengths[ids]
    if size.min() < 0:
        raise ValueError("an id has no token")
    shift = starts[ids] - (np.cumsum(size) - size)
    return data[np.repeat(shift, size) + np.arange(size.sum())].tobytes()


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """`encoded` (doc_id, ids) with the bytes of its ids as `decoded`; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([bytes_of(ids or b"", path) for ids in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], ["doc_id", "ids", "decoded"])

    kind = dict(encoded.dtypes)["doc_id"]
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids binary, decoded binary")


@query()
def op11_bpe(spark: SparkSession, root: str) -> DataFrame:
    """Digests of the ids of every whole text, and of what they decode to."""
    import public_tokenizers

    path = tokenizer_path("byte_bpe_50k.tiktoken")
    docs = table(spark, root, "documents").select("doc_id", "text")
    return decode(encode(docs, path, public_tokenizers.PATTERN), path).select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
