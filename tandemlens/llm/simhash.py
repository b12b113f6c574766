"""SimHash near-duplicates: fingerprints of word shingles, linked within a few bits.

Multi-index hashing: a fingerprint is cut into segments, and each has a table of all fingerprints by its value.
Of two fingerprints within two bits one of two segments of 32 bits differs by one bit at most; within seven bits, one
of four segments of 16. So the Hamming ball of radius one around each segment of the one (33 or 17 values) meets the
other in that segment's table; the complete distance is verified. A segment value that many fingerprints share is
split by parts of the rest: with one part more than bits that may differ, one of them is equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandemlens.llm.common import majority_bits, packed, small, unpacked
from tandemlens.llm.graph import components
from tandemlens.llm.minhash import content_of, similar_rows
from tandemlens.llm.registry import query
from tandemlens.session import durable, fits_broadcast
from tandemlens.sources.tables import table

SHINGLE = 3
SEED = 42
MAX_BITS = 2
#: The near-dedup's radius; its shingles have five words, and each pair is verified on them.
NEAR_BITS = 7
#: Fingerprints from which on a value of one of two segments is split; of four, whose values more share, 16 times as many.
HOT = 256


def fingerprint_of(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z, [ \t-\r]
    if not words:
        return 0
    if len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    runs = zip(*(words[i:] for i in range(shingle)))
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.fromiter((digest(join(r), seed) for r in runs), np.uint64, len(words) - shingle + 1)
    return majority_bits(hashes)


@F.arrow_udf(T.LongType())
def fingerprint(text: pa.Array) -> pa.Array:
    """fingerprint_of as a signed 64-bit column."""
    found = np.fromiter((fingerprint_of(t.as_py()) for t in text), np.uint64, len(text))
    return pa.array(found.view(np.int64))


def _segments(fp: Column, count: int) -> list[tuple[Column, Column]]:
    """Each segment's value, numbered in the bits above it, and the rest of the fingerprint."""
    width, found = 64 // count, []
    for i in range(count):
        low, high = i * width, (i + 1) * width
        value = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1)).bitwiseOR(F.lit(i << width))
        below = fp.bitwiseAND(F.lit((1 << low) - 1))
        above = F.shiftleft(F.shiftrightunsigned(fp, high), low) if high < 64 else F.lit(0).cast("bigint")
        found.append((value, below.bitwiseOR(above)))
    return found


def _parts(rest: Column, segments: int) -> Column:
    """As many equal parts of the rest of a fingerprint as bits may differ and one more, numbered in the bits above."""
    count = 2 * segments - (segments == 2)
    width = -(-(64 - 64 // segments) // count)
    mask = F.lit((1 << width) - 1)
    return F.array(*[F.shiftright(rest, n * width).bitwiseAND(mask).bitwiseOR(F.lit(n << width)) for n in range(count)])


def tables(prints: DataFrame, flips: bool, segments: int = 2) -> DataFrame:
    """(value, rest, and the columns of `prints`): a row for each segment, or one for each value in the ball around it."""
    masks = [0, *(1 << bit for bit in range(64 // segments))] if flips else [0]
    rows = [
        F.struct(value.bitwiseXOR(F.lit(m).cast("bigint")).alias("value"), rest.alias("rest"))
        for value, rest in _segments(F.col("fp"), segments)
        for m in masks
    ]
    return prints.select(*prints.columns, F.inline(F.array(*rows))).select("value", "rest", *prints.columns)


def links(prints: DataFrame, max_bits: int = MAX_BITS, node: str = "fp", apart: str | None = None) -> DataFrame:
    """(a, b) with a < b: distinct fingerprints within `max_bits` (7 or fewer) of each other.

    `node` names another column that a and b come from, whose fingerprints may then be equal too. Rows
    with the same value of the column `apart` are not linked.
    """
    if not 0 <= max_bits <= NEAR_BITS:
        raise ValueError("four segments with balls of radius one find pairs within seven bits")
    segments, limit = (2, HOT) if max_bits <= MAX_BITS else (4, 16 * HOT)
    distinct = durable(prints.select(*dict.fromkeys(["fp", node, apart or node])).distinct(), "distinct_fps")
    stored, probes = tables(distinct, False, segments), tables(distinct, True, segments)
    hot = durable(stored.groupBy("value").count().filter(F.col("count") > limit).select("value"), "hot_segments")
    whole = F.array(F.lit(-1).cast("bigint"))
    if hot.isEmpty():
        stored, probes = (side.withColumn("part", F.lit(-1).cast("bigint")) for side in (stored, probes))
    else:
        mark = hot.withColumn("hot", F.lit(True))
        mark = F.broadcast(mark) if fits_broadcast(mark) else mark

        def split(side: DataFrame) -> DataFrame:
            marked = side.join(mark, "value", "left")
            parts = F.when(F.col("hot"), _parts(F.col("rest"), segments)).otherwise(whole)
            return marked.withColumn("part", F.explode(parts))

        stored, probes = split(stored), split(probes)
    met = probes.select("value", "part", *[F.col(c).alias(f"one_{c}") for c in distinct.columns]).join(
        stored.select("value", "part", *[F.col(c).alias(f"other_{c}") for c in distinct.columns]), ["value", "part"]
    )
    one, other = F.col(f"one_{node}"), F.col(f"other_{node}")
    near = (one < other) & (F.bit_count(F.col("one_fp").bitwiseXOR(F.col("other_fp"))) <= max_bits)
    if apart:
        near &= F.col(f"one_{apart}") != F.col(f"other_{apart}")
    return met.filter(near).select(one.alias("a"), other.alias("b")).distinct()


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of `docs` (doc_id, text).

    Edge cases: texts without words have fingerprint 0 and link like any other; a row without an
    id is linked too, but gives no component id unless its component has no id at all (null).
    Repeated rows come back as often as they came. An empty table gives no row. Columns other than
    doc_id and text are not read.
    """
    prints = durable(docs.select("doc_id", fingerprint("text").alias("fp")), "fingerprints")
    firsts = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct_prints")
    labels = components(links(firsts)).withColumnRenamed("node", "fp")
    rooted = firsts.join(labels, "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(rooted.join(least, "root").select("fp", "component_id"), "fp").select(
        "doc_id", "fp", "component_id"
    )


def near_prints(prints: DataFrame) -> DataFrame:
    """(a, b): contents of other labels whose five-word fingerprints differ in NEAR_BITS or fewer."""
    return links(prints, NEAR_BITS, "content", "label")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents of which each is the first of its component; rows without an id stay.

    Components link texts whose five-word shingles have a Jaccard similarity of 0.8 or more. Candidates are pairs
    with a MinHash band in common (see `minhash`), and those of op7's method: five-word fingerprints within NEAR_BITS
    of each other, all of which `links` finds. All are verified on the whole sets. Similar texts differ in more
    bits than that, too (16 in sf0.1), which bands find: an index for so many bits has only
    segments of eight or nine bits for keys, which everything shares.
    Of rows that repeat an id and are in one component one stays, whichever; if in others, each row is decided by its own.
    """
    found = durable(similar_rows(docs, near_prints), "near_duplicates")
    again = found.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").select("doc_id")
    again = durable(again, "repeated_ids")
    copies = found.filter(F.col("doc_id") > F.col("component_id")).select(F.col("doc_id").alias("copy"))
    rows = packed(docs, doc_id=F.col("doc_id"), text=F.col("text"))
    if again.isEmpty():
        kept = rows.join(small(copies), F.col("doc_id") == F.col("copy"), "left_anti")
        return unpacked(kept, docs.columns)
    gone = copies.unionByName(again.withColumnRenamed("doc_id", "copy")).distinct()
    once = rows.join(small(gone), F.col("doc_id") == F.col("copy"), "left_anti").select("row")
    several = rows.join(small(again), "doc_id", "left_semi").withColumn("content", content_of("text"))
    firsts = found.join(small(again), "doc_id", "left_semi").filter(F.col("doc_id") == F.col("component_id"))
    several = several.join(firsts.select("doc_id", "content", "root").distinct(), ["doc_id", "content"])
    return unpacked(once.unionByName(several.dropDuplicates(["doc_id", "root"]).select("row")), docs.columns)


@query()
def op7_simhash(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select("doc_id", "text")
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
