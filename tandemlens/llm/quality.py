"""Quality rules: word statistics, and perplexity under an n-gram model of each language.

The model is a modified Kneser-Ney model over bytes, counted by Spark on all documents. Spark
also derives the discounts, the interpolated probabilities of all orders and the back-off
weights; only the finished model is kept, with every n-gram that was counted, and used as arrays sorted by
hash. Workers hold BLOCK entries at a time: a larger model takes several passes over the texts.
Documents outside the lower and upper perplexity bands of their language are rejected.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandemlens.llm.registry import query
from tandemlens.session import durable
from tandemlens.sources.tables import table

ORDER = 5
#: N-grams of the model that a worker holds at once (about 80 MB); a larger model comes in several blocks.
BLOCK = 1 << 22
#: Distinct n-grams that a task gathers before it passes them on.
GATHERED = 1 << 21
#: N-grams that are looked at together.
PART = 1 << 20
#: Bands: median of log-perplexity less and plus so many scaled median deviations. The lower one is
#: wide, as the n-grams of a text with many copies are frequent and so well predicted.
LOWER_BAND = 7.0
UPPER_BAND = 5.0
#: A deviation below this is taken as this, so that languages of near-equal texts get a band.
LEAST_DEVIATION = 0.02
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
_SALT = np.uint64(0x9E3779B97F4A7C15)

BASE = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
)


def base_statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """The five counts of BASE for a whole text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes: blanks and \t to \r only
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            repeated += line in seen
            seen.add(line)
    covered, runs = 0, list(zip(words, words[1:], words[2:]))
    if len(set(runs)) < len(runs):
        twice, last = {r for r, n in Counter(runs).items() if n > 1}, -1
        for i, run in enumerate(runs):
            if run in twice:
                covered += i + 2 - max(last, i - 1)  # of words i to i+2, those not covered yet
                last = i + 2
    return (
        len(words),
        len(text) - sum(map(text.count, SPACE)),
        sum(map(text.count, SYMBOLS)),
        repeated,
        covered,
    )


@F.arrow_udf(BASE)
def base(text: pa.Array) -> pa.Array:
    found = [base_statistics(t.as_py()) for t in text]
    columns = zip(*found) if found else [()] * 5
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], BASE.names)


def gram_parts(text: str | None, order: int = ORDER) -> Iterator[np.ndarray]:
    """Every n-gram of the text's bytes as one number, white space collapsed, A-Z lower-cased.

    The text is preceded by order - 1 newlines, so each byte ends one n-gram. At most PART n-grams
    come at once, however long the text.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    data = b"\n" * (order - 1) + b" ".join(words)
    for start in range(0, len(data) - order + 1, PART):
        piece = np.frombuffer(data[start : start + PART + order - 1], np.uint8)
        out = np.zeros(len(piece) - order + 1, np.uint64)
        for i in range(order):
            out <<= np.uint64(8)
            out |= piece[i : i + len(out)]
        yield out


def grams(text: str | None, order: int = ORDER) -> np.ndarray:
    """All parts of a short text together."""
    return np.concatenate([np.zeros(0, np.uint64), *gram_parts(text, order)])


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) of the highest order over all texts; each task sums what it reads first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw: dict[str, list[np.ndarray]] = {}  # n-grams as they come
        kept: dict[str, tuple[np.ndarray, np.ndarray]] = {}  # distinct ones with their counts

        def settle(lang: str) -> None:
            new = np.unique(np.concatenate(raw.pop(lang)), return_counts=True)
            if lang in kept:
                keys = np.concatenate([kept[lang][0], new[0]])
                n = np.concatenate([kept[lang][1], new[1]])
                order = np.argsort(keys, kind="stable")
                keys, n = keys[order], n[order]
                first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                new = keys[first], np.add.reduceat(n, first)
            kept[lang] = new

        def out(lang: str) -> Iterator[pa.RecordBatch]:
            keys, n = kept.pop(lang)
            size = 1 << 16
            for i in range(0, len(keys), size):
                part = keys[i : i + size].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part), pa.string()), pa.array(part), pa.array(n[i : i + size].astype(np.int64))],
                    ["lang", "gram", "n"],
                )

        waiting = 0
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                for part in gram_parts(text):
                    raw.setdefault(lang, []).append(part)
                    waiting += len(part)
                    if waiting >= 2 * PART:
                        for one in list(raw):
                            settle(one)
                        waiting = 0
                        if sum(len(k) for k, _ in kept.values()) > GATHERED:
                            for one in list(kept):
                                yield from out(one)
        for lang in list(raw):
            settle(lang)
        for lang in list(kept):
            yield from out(lang)

    by_lang = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), "text")
    return (
        by_lang.mapInArrow(count, "lang string, gram bigint, n bigint")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )


def discounts(counts: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3): the modified Kneser-Ney discounts of one order, from counts of counts."""
    few = [F.sum((F.col("n") == k).cast("double")).alias(f"c{k}") for k in (1, 2, 3, 4)]
    y = F.coalesce(F.try_divide("c1", F.col("c1") + 2 * F.col("c2")), F.lit(0.5))

    def d(k: int) -> F.Column:
        found = F.lit(float(k)) - (k + 1) * y * F.coalesce(F.try_divide(f"c{k + 1}", f"c{k}"), F.lit(0.0))
        return F.greatest(F.least(found, F.lit(k * 0.95)), F.lit(0.05)).alias(f"d{k}")

    return counts.groupBy("lang").agg(*few).select("lang", d(1), d(2), d(3))


def model_tables(docs: DataFrame, order: int = ORDER) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1: (lang, gram, p) and the back-off weights (lang, context, gamma).

    Lower orders count continuations: in how many n-grams of the next order a suffix stands.
    """
    counted = [durable(count_grams(docs), "grams")]
    for k in range(order - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("gram")
        counted.insert(0, durable(counted[0].select("lang", suffix).groupBy("lang", "gram").agg(F.count("*").alias("n")), "grams"))
    tables: list[tuple[DataFrame, DataFrame]] = []
    for k, counts in enumerate(counted, 1):
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = counts.join(F.broadcast(discounts(counts)), "lang").withColumns(  # a row for each language
            {"context": F.shiftrightunsigned("gram", 8), "cut": cut}
        )
        contexts = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("cut").alias("freed"))
        gammas = durable(contexts.select("lang", "context", "total", (F.col("freed") / F.col("total")).alias("gamma")), "gammas")
        rows = rows.join(gammas, ["lang", "context"]).withColumn("alpha", (F.col("n") - F.col("cut")) / F.col("total"))
        if k == 1:
            p = rows.withColumn("p", F.col("alpha") + F.col("gamma") / 256)
        else:
            lower = tables[-1][0].select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below"))
            suffix = F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))
            p = rows.withColumn("suffix", suffix).join(lower, ["lang", "suffix"])
            p = p.withColumn("p", F.col("alpha") + F.col("gamma") * F.col("below"))
        tables.append((durable(p.select("lang", "gram", "p"), "probabilities"), gammas.select("lang", "context", "gamma")))
    return tables


def hashed(grams: np.ndarray) -> np.ndarray:
    """Each n-gram or context mixed to 64 bits; no two have the same hash, as every step can be undone."""
    mixed = grams * _SALT
    mixed ^= mixed >> np.uint64(29)
    return mixed * np.uint64(0xBF58476D1CE4E5B9)


@F.arrow_udf(T.LongType())
def hash_of(gram: pa.Array) -> pa.Array:
    return pa.array(hashed(gram.to_numpy(zero_copy_only=False).view(np.uint64)).view(np.int64))


class HashArrays:
    """Values by hash: arrays sorted by hash, whose leading bits lead to the first entry to be looked at.

    A hash that is not stored is a miss. The directory of leading bits (4 to 8 bytes an entry) is made where
    the arrays are used and not sent.
    """

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        order = np.argsort(hashes)
        self.hashes = np.append(hashes[order], ~np.uint64(0))  # an end that no hash is above
        self.values = np.append(values[order], np.float32(np.nan))
        self.starts = None

    def __getstate__(self):
        return self.__dict__ | {"starts": None}

    def __getitem__(self, wanted: np.ndarray) -> np.ndarray:
        """Value of each hash, NaN where nothing is stored."""
        bits = max((len(self.hashes) - 1).bit_length(), 1)
        if self.starts is None:
            held = np.bincount((self.hashes[:-1] >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
            self.starts = np.append(0, np.cumsum(held)[:-1]).astype(np.uint32)
        at = self.starts[(wanted >> np.uint64(64 - bits)).astype(np.int64)].astype(np.int64)
        late = np.flatnonzero(self.hashes[at] < wanted)
        while len(late):
            at[late] += 1
            late = late[self.hashes[at[late]] < wanted[late]]
        return np.where(self.hashes[at] == wanted, self.values[at], np.float32(np.nan))


NOTHING = HashArrays(np.zeros(0, np.uint64), np.zeros(0, np.float32))


def hash_arrays(rows: DataFrame) -> dict[str, HashArrays]:
    """The arrays of each language from (lang, hash, v)."""
    found = rows.select("lang", "hash", F.col("v").cast("float").alias("v")).toArrow().combine_chunks()
    langs = found.column("lang").combine_chunks().dictionary_encode()
    if isinstance(langs, pa.ChunkedArray):
        langs = langs.combine_chunks()
    of, names = langs.indices.to_numpy(), langs.dictionary.to_pylist()
    hashes, values = found.column("hash").to_numpy().view(np.uint64), found.column("v").to_numpy()
    return {name: HashArrays(hashes[of == i], values[of == i]) for i, name in enumerate(names)}


class HashedModel:
    """The whole model in memory, for texts that may hold n-grams it has not counted.

    Log-probabilities and log back-off weights of each order and language by hash. It passes through
    the driver; texts that were counted themselves are scored by `log_perplexities`, which needs less.
    """

    def __init__(self, tables: list[tuple[DataFrame, DataFrame]]):
        self.order = len(tables)
        self.levels = [
            (
                hash_arrays(probabilities.select("lang", hash_of("gram").alias("hash"), F.log("p").alias("v"))),
                hash_arrays(gammas.select("lang", hash_of("context").alias("hash"), F.log("gamma").alias("v"))),
            )
            for probabilities, gammas in tables
        ]

    def log_perplexity(self, text: str | None, lang: str) -> float | None:
        """Mean negative log-probability of a byte; None for a text without words."""
        total, n = 0.0, 0
        for found in gram_parts(text, self.order):
            total, n = total + self._log_probability(found, lang), n + len(found)
        return -total / n if n else None

    def _log_probability(self, found: np.ndarray, lang: str) -> float:
        total, weight = 0.0, np.zeros(len(found), np.float32)
        for k in range(self.order, 0, -1):
            probabilities, gammas = (side.get(lang, NOTHING) for side in self.levels[k - 1])
            logs = probabilities[hashed(found)]
            unknown = np.isnan(logs)
            if not unknown.any():
                return total + float((logs + weight).sum(dtype=np.float64))
            total += float((logs + weight)[~unknown].sum(dtype=np.float64))
            found, weight = found[unknown], weight[unknown]
            weight += np.nan_to_num(gammas[hashed(found >> np.uint64(8))], nan=0.0)
            found = found & np.uint64((1 << 8 * (k - 1)) - 1)
        return total + float((weight - np.float32(np.log(256))).sum(dtype=np.float64))


def _block_part(spark: SparkSession, arrays: dict[str, HashArrays], block: int, blocks: int, order: int):
    """Column function (text, lang): what the n-grams of one block of hashes add to the log-perplexity."""
    held = spark.sparkContext.broadcast(arrays)

    def part(text: str | None, lang: str) -> float | None:
        total, n = 0.0, 0
        for found in gram_parts(text, order):
            n += len(found)
            wanted = hashed(found)
            if blocks > 1:
                wanted = wanted[(wanted >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32) == np.uint64(block)]
            if len(wanted):
                total += float(held.value[lang][wanted].sum(dtype=np.float64))
        return -total / n if n else None

    @F.arrow_udf(T.DoubleType())
    def block_part(text: pa.Array, lang: pa.Array) -> pa.Array:
        return pa.array([part(t.as_py(), g.as_py() or "") for t, g in zip(text, lang)], pa.float64())

    return block_part


def log_perplexities(texts: DataFrame, tables: list[tuple[DataFrame, DataFrame]], block: int | None = None) -> DataFrame:
    """`texts` (doc_id, text, lang) with their five counts and log-perplexity, without the text.

    Every n-gram of these texts was counted, so the highest order, which has the lower ones interpolated into it,
    gives all of them. It is cut by hash into as many blocks of about `block` n-grams as it takes. A block
    is one broadcast and one pass over the texts, which adds up the n-grams that fall into it.
    """
    spark, order = texts.sparkSession, len(tables)
    model = tables[-1][0].select("lang", hash_of("gram").alias("hash"), F.log("p").alias("v"))
    blocks = max(-(-tables[-1][0].count() // (block or BLOCK)), 1)
    own = ["doc_id", "lang"]
    if blocks > 1:
        texts = durable(texts.withColumn("row", F.monotonically_increasing_id()), "numbered")
        own.append("row")
    place = F.shiftright(F.shiftrightunsigned("hash", 32) * blocks, 32)
    parts = []
    for i in range(blocks):
        arrays = hash_arrays(model.filter(place == i) if blocks > 1 else model)
        part = _block_part(spark, arrays, i, blocks, order)("text", "lang").alias("log_perplexity")
        if i == 0:
            scored = durable(texts.select(*own, base("text").alias("base"), part), "scored")
        else:
            parts.append(durable(texts.select("row", part), "scored_block"))
    if parts:
        every = reduce(DataFrame.unionByName, parts, scored.select("row", "log_perplexity"))
        summed = every.groupBy("row").agg(F.sum("log_perplexity").alias("log_perplexity"))
        scored = durable(scored.drop("log_perplexity").join(summed, "row"), "scored")
    return scored.select("doc_id", "lang", "base.*", "log_perplexity")


def quality_rules(docs: DataFrame, lower: float = LOWER_BAND, upper: float = UPPER_BAND) -> DataFrame:
    """(doc_id, five counts, base_failed, log_perplexity, kept) for every row of `docs`.

    Edge cases: a null text has no word and fails the base rules, as does an empty one. A null lang
    is a language of its own. Rows with the same or without an id are judged each by itself;
    repeated rows count as often as they come. An empty table gives no row. Columns other than
    doc_id, text and lang are not read. Bands come from documents that pass the base rules.
    """
    texts = docs.select("doc_id", "text", "lang")
    scored = log_perplexities(texts, model_tables(texts)).withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    )
    sound = scored.filter(~F.col("base_failed"))
    middle = sound.groupBy(F.col("lang").alias("of")).agg(F.percentile_approx("log_perplexity", 0.5, 10_000).alias("middle"))
    spread = (
        sound.join(F.broadcast(middle), F.col("lang").eqNullSafe(F.col("of")))  # a row for each language
        .groupBy("of")
        .agg(
            F.first("middle").alias("middle"),
            F.percentile_approx(F.abs(F.col("log_perplexity") - F.col("middle")), 0.5, 10_000).alias("mad"),
        )
    )
    deviation = F.greatest(1.4826 * F.col("mad"), F.lit(LEAST_DEVIATION))
    within = F.col("log_perplexity").between(
        F.col("middle") - lower * deviation, F.col("middle") + upper * deviation
    )
    return (
        scored.join(F.broadcast(spread), F.col("lang").eqNullSafe(F.col("of")), "left")
        .withColumn("kept", F.coalesce(~F.col("base_failed") & within, F.lit(False)))
        .select("doc_id", *BASE.names, "base_failed", "log_perplexity", "kept")
    )


@query()
def op6_quality_rules(spark: SparkSession, root: str) -> DataFrame:
    return quality_rules(table(spark, root, "documents"))
