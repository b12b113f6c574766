"""Token counts of whole texts: pieces are counted once per distinct pre-token.

First pass: the distinct pre-tokens of the corpus, and the pieces of each. Second pass: each
document's pre-token frequencies, joined to those counts and summed; no ids are kept. Frequent
pre-tokens, whose number is bounded, are joined where the documents are (broadcast); the rare
rest, in which no key is hot, is joined by a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemlens.llm.pretokens import Chunks, load, plain, special_strings, tokenizer_path
from tandemlens.llm.registry import query
from tandemlens.session import durable
from tandemlens.sources.tables import table

LIMIT = 1024
#: Most pre-tokens that are broadcast with their counts (about 3 MB; 40 MB as a dict).
FREQUENT = 1 << 18
#: Distinct pre-tokens that a task gathers before it passes them on.
GATHERED = 200_000

# Fixed value: the pattern of byte-level pre-tokenizers.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_ACROSS = regex.compile(r"\s (?!\S)")


def chunks_of(text: str, path: str) -> list[str] | None:
    """Pieces of a text that can be cut into pre-tokens one by one; None if the text must be cut whole.

    A cut before a blank changes nothing, unless the blank stands within other white space.
    """
    if not plain(text, path) or _ACROSS.search(text):
        return None
    first, *rest = text.split(" ")
    return [first, *(" " + chunk for chunk in rest)]


def whole_cut(text: str, path: str) -> tuple[list[str], int]:
    """The library's own pre-tokens of a text, and how many special tokens stand in it."""
    pieces = regex.split("(" + "|".join(map(regex.escape, special_strings(path))) + ")", text)
    cut = load(path).pre_tokenizer.pre_tokenize_str
    return [part[a:b] for part in pieces[::2] for _, (a, b) in cut(part)], len(pieces) // 2


def vocabulary(docs: DataFrame, path: str) -> DataFrame:
    """(token, n, pieces): each distinct pre-token once, with its occurrences and its pieces."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, seen = Counter(), Counter()

        def batch_of() -> pa.RecordBatch:
            for chunk, n in chunks.items():
                for token in PATTERN.findall(chunk):
                    seen[token] += n
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["token", "n"]
            )
            chunks.clear(), seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                parts = chunks_of(text or "", path)
                if parts is None:
                    seen.update(whole_cut(text, path)[0])
                else:
                    chunks.update(parts)
                if len(seen) + len(chunks) >= GATHERED:
                    yield batch_of()
        yield batch_of()

    @F.arrow_udf("int")
    def pieces(tokens: pa.Array) -> pa.Array:
        encoded = load(path).encode_batch_fast(tokens.to_pylist(), add_special_tokens=False)
        return pa.array([len(e) for e in encoded], pa.int32())

    return (
        docs.select("text")
        .mapInArrow(gather, "token string, n bigint")
        .groupBy("token")
        .agg(F.sum("n").alias("n"))
        .withColumn("pieces", pieces("token"))
    )


class Counts:
    """What the pre-tokens of a text come to: pieces of those with known counts, and the others."""

    def __init__(self, path: str, known: dict[str, int]):
        self.path, self.known = path, known
        self.rare: dict[str, list[str]] = {}
        self.chunks = Chunks(self._chunk, "counts")

    def _split(self, tokens: list[str]) -> tuple[int, list[str]]:
        known = list(map(self.known.get, tokens))
        if None not in known:
            return sum(known), []
        return sum(n for n in known if n is not None), [t for t, n in zip(tokens, known) if n is None]

    def _chunk(self, chunk: str) -> int:
        total, rare = self._split(PATTERN.findall(chunk))
        if rare:
            self.rare[chunk] = rare
        return total

    def __call__(self, text: str) -> tuple[int, Counter]:
        """Pieces so far (special tokens included), and frequencies of the rare pre-tokens."""
        parts = chunks_of(text, self.path)
        if parts is None:
            tokens, special = whole_cut(text, self.path)
            total, rare = self._split(tokens)
            return total + special, Counter(rare)
        if self.chunks.trim():
            self.rare.clear()
        total = sum(map(self.chunks.__getitem__, parts))
        return total, Counter(token for chunk in parts if chunk in self.rare for token in self.rare[chunk])


@lru_cache(maxsize=1)
def counts_by(path: str, held) -> Counts:
    """One for all tasks of a worker that count with the same broadcast."""
    return Counts(path, dict(zip(held.value["token"].to_pylist(), held.value["pieces"].to_pylist())))


def frequent(words: DataFrame, most: int = FREQUENT) -> int:
    """Smallest power of two such that at most `most` pre-tokens occur as often."""
    level = F.floor(F.log2("n")).cast("int").alias("level")
    total = 0
    for row in words.groupBy(level).count().orderBy(F.desc("level")).toLocalIterator():  # 64 rows at most
        total += row["count"]
        if total > most:
            return 2 ** (row["level"] + 1)
    return 1


def count_tokens(docs: DataFrame, path: str, most: int = FREQUENT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of `docs` (doc_id, text).

    Edge cases: a null text counts as empty (0 bytes, 0 tokens); rows with the same or without an
    id are counted each by itself; an empty table gives no row. Columns other than doc_id and
    text are not read.
    """
    words = durable(vocabulary(docs, path), "pretokens")
    least = frequent(words, most)
    common = words.filter(F.col("n") >= least).select("token", "pieces").toArrow()
    known = docs.sparkSession.sparkContext.broadcast(common)
    names = ["doc_id", "row", "token", "n", "n_bytes"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, row = counts_by(path, known), TaskContext.get().partitionId() << 33
        for batch in batches:
            at, rows, tokens, ns, sizes = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                text, row = text or "", row + 1
                total, rare = counts(text)
                at.extend([i] * (len(rare) + 1))
                rows.extend([row] * (len(rare) + 1))
                tokens.append(f"\0{row}")  # no pre-token looks like this: it joins nothing
                tokens.extend(rare.keys())
                ns.append(total)
                ns.extend(rare.values())
                sizes.append(len(text.encode("utf-8", "surrogatepass")))
                sizes.extend([0] * len(rare))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at, pa.int64())),
                    pa.array(rows, pa.int64()),
                    pa.array(tokens, pa.string()),
                    pa.array(ns, pa.int64()),
                    pa.array(sizes, pa.int64()),
                ],
                names,
            )

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, row bigint, token string, n bigint, n_bytes bigint"
    rare = words.filter(F.col("n") < least).select("token", "pieces")
    return (
        docs.select("doc_id", "text")
        .mapInArrow(sums, schema)
        .join(rare, "token", "left")
        .groupBy("row", "doc_id")
        .agg(
            F.max("n_bytes").alias("n_bytes"),
            F.sum(F.col("n") * F.coalesce("pieces", F.lit(1))).alias("n_tokens"),
        )
        .drop("row")
    )


@query()
def op10_token_counts(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select("doc_id", "text")
    counted = count_tokens(docs, tokenizer_path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
