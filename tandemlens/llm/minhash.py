"""Near-duplicates by the Jaccard similarity of their word shingles: MinHash bands, bounds, then exact sets.

A band is the hash of a few minima of a text's shingle hashes; texts with a band in common may be similar.
First every text is held against one text of each of its bands, on the whole shingle sets. Texts of a
band that this has not linked are then compared within tasks, by bitmaps of their shingles: a bit that is
set in one bitmap only proves a shingle that the other text lacks, which bounds the shared ones from above. Only pairs
whose bound reaches the similarity are handed on, and verified on the whole sets. Candidates from elsewhere, such
as near fingerprints, can be added and are verified likewise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandemlens.llm.common import majority_bits, small
from tandemlens.llm.graph import components
from tandemlens.llm.pretokens import take_turn
from tandemlens.session import durable

SHINGLE = 5
SIMILARITY = 0.8
#: A pair at SIMILARITY has none of its bands in common with probability (1 - 0.8 ** ROWS) ** BANDS, 0.0004.
ROWS = 5
BANDS = 20
SEED = 43
#: Shingles whose minima are taken at once.
CHUNK = 1024
#: Bytes of text whose signatures are held at once.
PORTION = 1 << 20
#: Bytes kept of each shingle hash.
KEPT = 5
#: Texts of a band that are compared in one task; larger bands are cut into blocks, each compared with each.
BLOCK = 2048

_RNG = np.random.default_rng(SEED)
_ODD = _RNG.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = _RNG.integers(0, 1 << 63, BANDS, dtype=np.uint64)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def shingles_of(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the text's runs of words, in order; of a shorter text the one of all its words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z, [ \t-\r]
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    digest, join = xxhash.xxh64_intdigest, b" ".join
    runs = zip(*(islice(words, i, None) for i in range(shingle)))
    return np.unique(np.fromiter((digest(join(r), SEED) for r in runs), np.uint64, len(words) - shingle + 1))


def bands_of(hashes: np.ndarray) -> np.ndarray:
    """BANDS hashes of ROWS minima each; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    least = np.full(len(_ODD), ~np.uint64(0))
    for i in range(0, len(hashes), CHUNK):
        least = np.minimum(least, (hashes[i : i + CHUNK, None] * _ODD).min(axis=0))
    keys = _SALTS.copy()
    for row in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ row ^ (row >> np.uint64(32))) * _MIX
        keys ^= keys >> np.uint64(29)
    return keys


def bitmap_of(hashes: np.ndarray) -> np.ndarray:
    """Words of a bitmap of four to eight bits a shingle, 64 at least."""
    size = 64 << max(len(hashes) * 4 - 1, 0).bit_length() - 6 if len(hashes) > 16 else 64
    bits = np.zeros(size, bool)
    bits[(hashes & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view("<u8")


def signature(texts: list[str | None]) -> list[pa.Array]:
    """Of each text: hash of the shingle set, its size, its fingerprint, its bands, the set itself and its bitmap."""
    content, n, fp, bands, hashes, bits = [], [], [], [], [], []
    for text in texts:
        found = shingles_of(text)
        content.append(xxhash.xxh3_64_intdigest(found.tobytes()))
        n.append(len(found))
        fp.append(majority_bits(found))
        bands.append(bands_of(found).view(np.int64))
        hashes.append(np.ascontiguousarray(found.view(np.uint8).reshape(-1, 8)[:, :KEPT]).tobytes())
        bits.append(bitmap_of(found).tobytes())
    return [
        pa.array(np.array(content, np.uint64).view(np.int64)),
        pa.array(n, pa.int64()),
        pa.array(np.array(fp, np.uint64).view(np.int64)),
        pa.array(bands, pa.list_(pa.int64())),
        pa.array(hashes, pa.binary()),
        pa.array(bits, pa.binary()),
    ]


@F.arrow_udf(T.LongType())
def content_of(text: pa.Array) -> pa.Array:
    """The hash of a text's shingle set, as in `signature`."""
    found = [xxhash.xxh3_64_intdigest(shingles_of(t.as_py()).tobytes()) for t in text]
    return pa.array(np.array(found, np.uint64).view(np.int64))


def portions(text: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of rows that hold at most PORTION bytes of text, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    start, before = 0, 0
    while start < len(text):
        end = max(start + 1, int(np.searchsorted(ends, before + PORTION, side="right")))
        yield start, end
        start, before = end, int(ends[end - 1])


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, content, n, fp, bands, hashes, bits) of every row, made and handed on in portions of a batch."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("shingles")
        for batch in batches:
            ids, text = batch.columns
            for start, end in portions(text):
                made = signature(text.slice(start, end - start).to_pylist())
                yield pa.RecordBatch.from_arrays([ids.slice(start, end - start), *made], names)

    names = ["doc_id", "content", "n", "fp", "bands", "hashes", "bits"]
    types = f"doc_id {dict(docs.dtypes)['doc_id']}, content bigint, n bigint, fp bigint, bands array<bigint>, hashes binary, bits binary"
    return docs.select("doc_id", "text").mapInArrow(sign, types)


def set_of(data: bytes) -> np.ndarray:
    """The kept bytes of the hashes as numbers."""
    out = np.zeros((len(data) // KEPT, 8), np.uint8)
    out[:, :KEPT] = np.frombuffer(data, np.uint8).reshape(-1, KEPT)
    return out.view("<u8")[:, 0]


@F.arrow_udf(T.LongType())
def in_common(one: pa.Array, other: pa.Array) -> pa.Array:
    """Elements that two sets of hashes share."""
    sets = ((set_of(x.as_py()), set_of(y.as_py())) for x, y in zip(one, other))
    return pa.array([len(np.intersect1d(x, y)) for x, y in sets], pa.int64())


def verified(pairs: DataFrame, signed: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (a, b) of contents whose shingle sets are similar enough, on the whole sets."""
    needed = durable(pairs.select(F.col("a").alias("content")).union(pairs.select("b")).distinct(), "needed")
    sets = durable(
        signed.select("content", "hashes").join(small(needed), "content", "left_semi").dropDuplicates(["content"]), "sets"
    )
    one = sets.select(F.col("content").alias("a"), F.col("hashes").alias("one"))
    other = sets.select(F.col("content").alias("b"), F.col("hashes").alias("other"))
    both = pairs.join(one, "a").join(other, "b").select("a", "b", "one", "other", in_common("one", "other").alias("same"))
    union = (F.octet_length("one") + F.octet_length("other")) / KEPT - F.col("same")
    return durable(both.filter(F.col("same") >= similarity * union - 1e-9).select("a", "b"), "similar")


class Members:
    """Texts of one band, by size of their bitmaps and then number of shingles."""

    def __init__(self, content, n, label, block, bits: list[bytes]):
        order = np.lexsort((n, [len(b) for b in bits]))
        self.content, self.n, self.label, self.block = content[order], n[order], label[order], block[order]
        wide = np.array([len(bits[i]) // 8 for i in order])
        self.classes = {}
        for size in np.unique(wide):
            at = np.flatnonzero(wide == size)
            words = np.frombuffer(b"".join(bits[i] for i in order[at]), "<u8").reshape(len(at), size)
            self.classes[int(size)] = (at, words)

    def pairs(self, similarity: float, across: bool) -> tuple[np.ndarray, np.ndarray]:
        """Contents of all pairs that other labels have and whose bound reaches `similarity`."""
        one, other = [], []
        for size, (at, words) in self.classes.items():
            self._against(at, words, at, words, similarity, across, one, other)
            twice = self.classes.get(2 * size)
            if twice is not None:
                folded = twice[1][:, :size] | twice[1][:, size:]
                self._against(at, words, twice[0], folded, similarity, across, one, other)
        empty = np.zeros(0, np.int64)
        return np.concatenate([empty, *one]), np.concatenate([empty, *other])

    def _against(self, at, words, more, folded, similarity, across, one, other) -> None:
        for i, x in enumerate(at):
            start = i + 1 if more is at else 0
            last = np.searchsorted(self.n[more], self.n[x] / similarity + 1e-9, side="right")
            y, bits = more[start:last], folded[start:last]
            keep = self.label[y] != self.label[x]
            if across:
                keep &= self.block[y] != self.block[x]
            y, bits = y[keep], bits[keep]
            if not len(y):
                continue
            shared = np.minimum(
                self.n[x] - np.bitwise_count(words[i] & ~bits).sum(axis=1, dtype=np.int64),
                self.n[y] - np.bitwise_count(bits & ~words[i]).sum(axis=1, dtype=np.int64),
            )
            y = y[shared >= similarity * (self.n[x] + self.n[y] - shared) - 1e-9]
            one.append(np.full(len(y), self.content[x]))
            other.append(self.content[y])


def candidates(members: DataFrame, labels: DataFrame, signed: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) with a band in common that `labels` has not connected and that may be similar.

    A band of more than BLOCK texts is cut into blocks by their hashes, and each two blocks are one place.
    """
    now = members.select("band", "content", "n").join(labels.withColumnRenamed("node", "content"), "content", "left")
    now = durable(now.withColumn("label", F.coalesce("label", "content")), "members")
    apart = now.groupBy("band").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.ceil(F.count("*") / BLOCK).alias("blocks")
    )
    apart = durable(apart.filter("low <> high").select("band", "blocks"), "bands_apart")
    open_ = now.join(apart, "band").withColumn("block", F.pmod(F.xxhash64("content"), "blocks").cast("int"))
    needed = small(open_.select("content").distinct())
    bits = signed.select("content", "bits").join(needed, "content", "left_semi").dropDuplicates(["content"])
    partner = F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")))
    placed = open_.withColumn("partner", partner).withColumns(
        {"low": F.least("block", "partner"), "high": F.greatest("block", "partner")}
    )
    placed = placed.join(durable(bits, "bitmaps"), "content").select("band", "low", "high", "content", "n", "label", "block", "bits")
    keys = ["band", "low", "high"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> pa.RecordBatch:
            group = pa.Table.from_batches(held)
            content, n, label, block = (group.column(c).to_numpy() for c in ("content", "n", "label", "block"))
            found = Members(content, n, label, block, group.column("bits").to_pylist()).pairs(similarity, now[1] != now[2])
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.minimum(*found), np.maximum(*found))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in keys])
            starts = np.flatnonzero(np.r_[True, (at[:, 1:] != at[:, :-1]).any(axis=0)])
            for start, end in zip(starts, [*starts[1:], batch.num_rows]):
                key = tuple(at[:, start])
                if key != now and held:
                    yield done()
                    held = []
                now = key
                held.append(batch.slice(start, end - start))
        if held:
            yield done()

    together = placed.repartition(*keys).sortWithinPartitions(*keys)
    return together.mapInArrow(compare, "a bigint, b bigint").distinct()


def similar_documents(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id) for every row of `docs` (doc_id, text): groups linked by similar pairs.

    Edge cases: texts without words are equal to each other and to nothing else; a text of fewer than
    SHINGLE words is one shingle. A row without an id is linked too, but gives no component id
    unless its component has no id at all (null). An empty table gives no row.
    """
    return similar_rows(docs, similarity=similarity).select("doc_id", "component_id")


def similar_rows(
    docs: DataFrame, nearby: Callable[[DataFrame], DataFrame] | None = None, similarity: float = SIMILARITY
) -> DataFrame:
    """(doc_id, content, root, component_id): as `similar_documents`, with the text's and the component's hash.

    `nearby` gives more candidates (a, b) with a < b, from (content, fp, label) of all texts with words; it
    need not give pairs of one label, which are linked already.
    """
    signed = durable(signatures(docs), "signatures")
    ids = signed.groupBy("content").agg(F.min("doc_id").alias("first"))
    distinct = signed.select("content", "n", "bands").dropDuplicates(["content"])
    entries = durable(distinct.select("content", "n", F.explode("bands").alias("band")), "bands")
    order = F.struct(F.xxhash64("content").alias("at"), "content", "n")  # much the same text leads all bands of a group
    leaders = durable(
        entries.groupBy("band").agg(F.min(order).alias("leader"), F.count("*").alias("members")).filter("members > 1")
        .select("band", F.col("leader.content").alias("leader"), F.col("leader.n").alias("n_leader")),
        "band_leaders",
    )
    members = durable(entries.join(leaders, "band"), "band_members")
    near = F.least("n", "n_leader") >= similarity * F.greatest("n", "n_leader") - 1e-9
    stars = members.filter(F.col("content") != F.col("leader")).filter(near)
    stars = stars.select(F.least("content", "leader").alias("a"), F.greatest("content", "leader").alias("b"))
    linked = verified(durable(stars.distinct(), "pairs"), signed, similarity)
    labels = components(linked)
    more = verified(durable(candidates(members, labels, signed, similarity), "pairs"), signed, similarity)
    if not more.isEmpty():
        linked = linked.unionByName(more)
        labels = components(linked)
    if nearby is not None:
        prints = signed.filter("n > 0").select("content", "fp").distinct()
        prints = prints.join(labels.withColumnRenamed("node", "content"), "content", "left")
        pairs = durable(nearby(prints.withColumn("label", F.coalesce("label", "content"))), "pairs")
        last = pairs if pairs.isEmpty() else verified(pairs, signed, similarity)
        if not last.isEmpty():
            labels = components(linked.unionByName(last))
    rooted = ids.join(labels.withColumnRenamed("node", "content"), "content", "left").select(
        "content", "first", F.coalesce("label", "content").alias("root")
    )
    rooted = durable(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("content", "root", "component_id")
    return signed.select("doc_id", "content").join(named, "content").select("doc_id", "content", "root", "component_id")
