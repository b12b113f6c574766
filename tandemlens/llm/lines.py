"""Line deduplication over whole documents.

Lines are keyed, hashed and counted over distinct documents; keys in too many documents lose
their lines everywhere but in the last document, and texts are put together again by position.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemlens.llm.common import SPACE, named, packed, unpacked
from tandemlens.llm.registry import query
from tandemlens.session import durable
from tandemlens.sources.tables import table

MIN_CHARS = 20
MIN_DOCUMENTS = 3


def _key(line: str, min_chars: int) -> bytes | None:
    """128-bit hash of the line's key, or None if the key is too short to count."""
    key = line.strip(SPACE)
    if len(key) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower())  # bytes: A-Z only


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, key): the distinct line keys of each text."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = {_key(line, min_chars) for line in (text or "").split("\n")} - {None}
                at.extend([i] * len(found))
                out.extend(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int32())), pa.array(out, pa.binary())], ["doc_id", "key"]
            )

    return docs.select("doc_id", "text").mapInArrow(keys, f"doc_id {dict(docs.dtypes)['doc_id']}, key binary")


def dropped_keys(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS
) -> DataFrame:
    """(doc_id, keys): for each document that loses lines, the keys it loses.

    Counting combines on the map side. The way back joins the pairs to one row per key: a key
    that many documents share is a skewed join, which Spark splits (the key's own row is copied);
    for that both sides must come straight from their exchanges, so the counts are written first.
    """
    pairs = durable(line_keys(docs, min_chars).distinct(), "line_keys")
    shared = durable(
        pairs.groupBy("key")
        .agg(F.count(F.lit(1)).alias("documents"), F.max("doc_id").alias("keeper"))
        .filter(F.col("documents") >= min_documents)
        .select("key", "keeper"),
        "shared_lines",
    )
    return (
        pairs.join(shared, "key")
        .filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("doc_id")
        .agg(F.collect_list("key").alias("keys"))
    )


def _deduped(docs: DataFrame, min_chars: int, min_documents: int) -> DataFrame:
    """(row, out): each row of `docs` with the struct (text, n_lines, n_dropped) next to it."""

    @F.arrow_udf("text string, n_lines bigint, n_dropped bigint")
    def kept(text: pa.Array, keys: pa.Array) -> pa.Array:
        texts, lines_of, dropped_of = [], [], []
        for t, gone in zip(text, keys):
            lines = (t.as_py() or "").split("\n")
            lost = set(gone.as_py() or ())
            left = [x for x in lines if _key(x, min_chars) not in lost] if lost else lines
            texts.append("\n".join(left))
            lines_of.append(len(lines))
            dropped_of.append(len(lines) - len(left))
        return pa.StructArray.from_arrays(
            [pa.array(texts, pa.string()), pa.array(lines_of, pa.int64()), pa.array(dropped_of, pa.int64())],
            ["text", "n_lines", "n_dropped"],
        )

    drops = dropped_keys(docs, min_chars, min_documents).withColumnRenamed("doc_id", "dropped_from")
    return (
        packed(docs, doc_id=F.col("doc_id"), text=F.col("text"))
        .join(drops.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("dropped_from")), "left")
        .select("row", kept("text", "keys").alias("out"))
    )


def dedup_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS
) -> DataFrame:
    """Every document with the lines left to it in `text`, plus n_lines and n_dropped.

    Edge cases: a null or empty text is one empty line and comes back as an empty text. Rows with
    the same doc_id count as one document and lose the same keys; rows without an id count
    together as one document, which keeps a shared line only if no other document has it (then
    it is not shared). An empty table gives no row. Other columns pass through unchanged, but for
    those named n_lines or n_dropped, which the new ones replace.
    """
    out = F.col("out")
    counts = {n: out.getField(n) for n in ("text", "n_lines", "n_dropped")}
    return unpacked(_deduped(docs, min_chars, min_documents), docs.columns, **counts)


def rewrite_texts(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """The documents, all columns as they are, with the lines left to them (see `dedup_lines`)."""
    done = unpacked(_deduped(docs, min_chars, min_documents), docs.columns, text=F.col("out.text"))
    return done.select(*map(named, docs.columns))


@query(
    """
    WITH lines AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
        FROM documents
    ), keyed AS (
        SELECT doc_id, line, pos,
               translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
                         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM lines
    ), shared AS (
        SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
        GROUP BY key HAVING count(DISTINCT doc_id) >= 3
    ), marked AS (
        SELECT k.doc_id, k.line, k.pos, s.key IS NOT NULL AND k.doc_id <> s.keeper AS gone
        FROM keyed k LEFT JOIN shared s ON k.key = s.key
    )
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
    """
)
def op5_line_dedup(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
