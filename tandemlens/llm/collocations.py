"""Collocations: phrases of two to four words that stand together more often than their parts explain.

Texts are cut into words once, batch by batch, as numbers of the batch's own word list; the lists
are then added up, and words that are too rare for any phrase become breaks. N-grams of word ids are
packed into one key, whose bits a Feistel network permutes (it can be undone, so nothing is lost), and
counted in quotient filters: the first bits of a permuted key, its quotient, are told by the number
of keys there, the rest is stored in full, with its count. A filter is sorted, so filters of many tasks are
cut at the same quotients and merged range by range.

A phrase is counted only where its shorter parts are frequent. That is looked up in a bitmap over
the first bits of the permuted keys of all frequent phrases: it has a fixed size, and can only let
through too much, which costs counting but changes no result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandemlens.llm.common import small
from tandemlens.llm.registry import query
from tandemlens.operators.ordered import lookup
from tandemlens.session import durable
from tandemlens.sources.tables import table

LONGEST = 4
LEAST = 30
FACTOR = 2_000_000
TOP = 2_000
#: Bytes of text that share a word list.
BATCH_BYTES = 8 << 20
#: Words of a list, or tokens, in one row (a piece is not cut, however long): Parquet makes pages of 100 rows at least.
ROW_WORDS, ROW_TOKENS = 2_000, 1 << 13
#: N-grams that a task counts before it passes its filter on, and that a merged range has at most, about.
HELD = 1_000_000
RANGE = 1_000_000
#: Tokens that a task counts at once.
COUNTED = 1 << 16
#: Texts, rows, ranges or phrases that are handed on, or made into Python's objects, at once.
TEXTS, ROWS, SEGMENTS, PHRASES = 256, 64, 256, 1 << 16
#: Least bits of a quotient, where keys have as many.
QUOTIENT = 16
#: Bits that index the bitmap of frequent phrases (2^26 bits are 8 MB).
BITMAP = 26
#: Groups in which the best phrases of a language are looked for first.
SALTS = 64

# What parts a text, and what parts words.
_STOPS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + _STOPS, b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(_STOPS)
)
_KEYS = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
_ODD, _MIX = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


class Words(dict):
    """Word -> its number in the batch, from 1; stops are 0 and the nothing between two blanks is -1."""

    def __init__(self):
        super().__init__({b"\n": 0, b"": -1})
        self.numbers: list[np.ndarray] = []
        self.bytes = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) - 1
        return number

    def add(self, text: str) -> None:
        words = text.encode().translate(_TABLE).replace(b"\n", b" \n ").split(b" ")
        numbers = np.array(list(map(self.__getitem__, words)), np.int32)
        self.numbers.append(numbers[numbers >= 0])
        self.numbers.append(np.zeros(1, np.int32))
        self.bytes += len(text)


def joined_runs(numbers: np.ndarray) -> np.ndarray:
    """Without all but one of adjacent breaks (zeros)."""
    if not len(numbers):
        return numbers
    keep = numbers != 0
    keep[1:] |= numbers[:-1] != 0
    return numbers[keep]


def stored(numbers: np.ndarray) -> bytes:
    """The numbers in as few bytes each as they need (1, 2 or 4), which the first byte tells."""
    kind = np.min_scalar_type(int(numbers.max(initial=0)))
    return bytes([kind.itemsize]) + numbers.astype(kind.newbyteorder("<")).tobytes()


def numbers_of(data: pa.Buffer | bytes) -> np.ndarray:
    """What `stored` was given."""
    kind = memoryview(data)[0]
    return np.frombuffer(data, f"<u{kind}", offset=1).astype(np.int32)


def in_batches(rows: Iterable[tuple], kinds: list[pa.DataType], names: list[str], most: int) -> Iterator[pa.RecordBatch]:
    """The rows, at most `most` in a batch."""
    rows = iter(rows)
    while some := list(islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], names)


def rows_of_tokens(numbers: np.ndarray) -> Iterator[np.ndarray]:
    """Cut behind breaks, about ROW_TOKENS each."""
    breaks, start = np.flatnonzero(numbers == 0), 0
    while start < len(numbers):
        at = np.searchsorted(breaks, start + ROW_TOKENS)
        end = int(breaks[at]) + 1 if at < len(breaks) else len(numbers)
        yield numbers[start:end]
        start = end


def word_lists(docs: DataFrame) -> DataFrame:
    """(batch, lang, first, words, counts, tokens): rows of a batch's word list, and rows of its texts as numbers."""
    schema = "batch bigint, lang string, first int, words array<string>, counts array<bigint>, tokens binary"
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]
    names = ["batch", "lang", "first", "words", "counts", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(rows_of(batches), kinds, names, ROWS)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: dict[str, Words] = {}
        batch = TaskContext.get().partitionId() << 33

        def written() -> Iterator[tuple]:
            nonlocal batch
            for lang, words in held.items():
                batch += 1
                numbers = np.concatenate(words.numbers)
                counts = np.bincount(numbers, minlength=len(words) - 1)[1:]
                texts = [w.decode() for w in list(words)[2:]]
                for at in range(0, len(texts), ROW_WORDS):
                    yield batch, lang, at + 1, texts[at : at + ROW_WORDS], counts[at : at + ROW_WORDS], None
                for part in rows_of_tokens(joined_runs(numbers)):
                    yield batch, lang, None, None, None, stored(part)
            held.clear()

        size = 0
        texts = (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS))
        for got in texts:
            for text, lang in zip(got.column(0).to_pylist(), got.column(1).to_pylist()):
                held.setdefault("und" if lang is None else lang, Words()).add(text or "")
                size += len(text or "")
                if size >= BATCH_BYTES:
                    yield from written()
                    size = 0
        yield from written()

    return durable(docs.select("text", "lang").mapInArrow(run, schema), "word_lists")


def vocabulary(lists: DataFrame, least: int) -> DataFrame:
    """(lang, word, f, id) of the words that occur often enough; ids count from 1, with few gaps."""
    parts = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = lists.filter("words IS NOT NULL").select("lang", F.inline(F.arrays_zip("words", "counts")))
    often = listed.groupBy("lang", F.col("words").alias("word")).agg(F.sum("counts").alias("f")).filter(F.col("f") >= least)
    part = F.pmod(F.xxhash64("lang", "word"), F.lit(parts)).cast("int")
    order = Window.partitionBy("part").orderBy("lang", "word")
    number = (F.row_number().over(order) - 1) * parts + F.col("part") + 1
    return durable(often.withColumn("part", part).withColumn("id", number.cast("int")).drop("part"), "vocabulary")


def numbered(lists: DataFrame, words: DataFrame) -> DataFrame:
    """(n, tokens): the texts as `n` stored ids of `words`, all others being breaks (0).

    A batch's known words and its texts are dealt to one task, words first, and read as a stream.
    """
    own = lists.filter("words IS NOT NULL").select("batch", "lang", "first", F.posexplode("words").alias("at", "word"))
    own = own.select("batch", "lang", "word", (F.col("first") + F.col("at")).alias("number"))
    known = own.join(small(words.select("lang", "word", "id")), ["lang", "word"]).select("batch", "number", "id")
    texts = lists.filter("tokens IS NOT NULL").select("batch", "tokens")
    both = known.unionByName(texts, allowMissingColumns=True).repartition("batch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(rows_of(batches), [pa.int64(), pa.binary()], ["n", "tokens"], ROWS)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, id_of = None, np.zeros(1, np.int32)
        for rows in batches:
            owner = rows.column(0).to_numpy()
            number = rows.column(1).fill_null(0).to_numpy()
            ids = rows.column(2).fill_null(0).to_numpy()
            starts = np.flatnonzero(np.diff(owner, prepend=owner[:1] - 1))
            for start, end in zip(starts, [*starts[1:], len(owner)]):
                if owner[start] != now:
                    now, id_of = owner[start], np.zeros(1, np.int32)
                most = int(number[start:end].max()) + 1
                if most > len(id_of):
                    id_of = np.concatenate([id_of, np.zeros(max(most, 2 * len(id_of)) - len(id_of), np.int32)])
                id_of[number[start:end]] = ids[start:end]
                for tokens in rows.column(3).slice(start, end - start).drop_null():
                    tokens = numbers_of(tokens.as_buffer())
                    found = joined_runs(np.where(tokens < len(id_of), id_of[np.minimum(tokens, len(id_of) - 1)], 0))
                    yield len(found), stored(found)

    streamed = both.sortWithinPartitions("batch", F.col("tokens").isNotNull()).select("batch", "number", "id", "tokens")
    return durable(streamed.mapInArrow(run, "n bigint, tokens binary"), "numbered")


def mixed(left: np.ndarray, right: np.ndarray, half: int, undo: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A permutation of keys of two halves of `half` bits each, or its inverse."""

    def hashed(x, key):
        x = (x ^ key) * _ODD
        return ((x ^ (x >> np.uint64(29))) * _MIX) >> np.uint64(64 - half)

    for key in reversed(_KEYS) if undo else _KEYS:
        left, right = (right ^ hashed(left, key), left) if undo else (right, left ^ hashed(right, key))
    return left, right


class Keys:
    """N-grams of ids below 2^bits as permuted keys of two halves; those of `order` words."""

    def __init__(self, order: int, bits: int, ranges: int = 0):
        self.order, self.bits = order, bits
        self.half = bits if order == 2 else 2 * bits
        self.range_bits = min(ranges, self.half)
        self.quotient_bits = max(self.range_bits, min(QUOTIENT, self.half))

    def of(self, tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Permuted keys of the n-grams that begin `at`."""
        word = [tokens[at + i].astype(np.uint64) for i in range(self.order)]
        shift = np.uint64(self.bits)
        if self.order == 2:
            return mixed(word[0], word[1], self.half)
        left = word[0] if self.order == 3 else word[0] << shift | word[1]
        return mixed(left, word[-2] << shift | word[-1], self.half)

    def words(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids again, one row an n-gram."""
        left, right = mixed(left, right, self.half, undo=True)
        shift, low = np.uint64(self.bits), np.uint64((1 << self.bits) - 1)
        word = [left, right] if self.order == 2 else [left >> shift, left & low, right >> shift, right & low][-self.order :]
        return np.stack(word, axis=1).astype(np.int32)

    def bit(self, left: np.ndarray) -> np.ndarray:
        """Places in the bitmap of frequent phrases."""
        spare = self.half - BITMAP
        return (left >> np.uint64(spare) if spare > 0 else left).astype(np.int64)

    @property
    def places(self) -> int:
        return 1 << min(BITMAP, self.half)


def trimmed(values: np.ndarray, bits: int) -> bytes:
    """As many low bytes of each value as `bits` take."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-bits // 8)]).tobytes()


def full(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        width = len(data) // n
        out[:, :width] = np.frombuffer(data, np.uint8).reshape(n, width)
    return out.view("<u8")[:, 0]


class QuotientFilter:
    """Counts of permuted keys, in their order and without loss."""

    def __init__(self, left: np.ndarray, right: np.ndarray, counts: np.ndarray):
        self.left, self.right, self.counts = left, right, counts

    def __len__(self) -> int:
        return len(self.counts)

    @classmethod
    def merged(cls, filters: list[QuotientFilter], half: int) -> QuotientFilter:
        """One for all, which empties the list; a stable sort of runs that are sorted already only merges them."""
        counts = np.concatenate([f.counts for f in filters])
        if 2 * half <= 64:
            key = np.concatenate([f.left << np.uint64(half) | f.right for f in filters])
            filters.clear()
            order = np.argsort(key, kind="stable")
            key, counts = key[order], counts[order]
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
        else:
            left, right = (np.concatenate(x) for x in zip(*((f.left, f.right) for f in filters)))
            filters.clear()
            order = np.lexsort((right, left))
            left, right, counts = left[order], right[order], counts[order]
            first = np.ones(len(left), bool)
            first[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
        del order
        starts = np.flatnonzero(first)
        counts = np.add.reduceat(counts, starts) if len(starts) else counts
        if 2 * half > 64:
            return cls(left[starts], right[starts], counts)
        key = key[starts]
        return cls(key >> np.uint64(half), key & np.uint64((1 << half) - 1), counts)

    def segments(self, keys: Keys) -> Iterator[tuple[int, int, bytes, bytes, bytes, bytes]]:
        """(range, n, runs, rest of the left half, right half, counts) of each range of quotients that has keys."""
        within, below = keys.quotient_bits - keys.range_bits, np.uint64(keys.half - keys.quotient_bits)
        ranges = (self.left >> np.uint64(keys.half - keys.range_bits)).astype(np.int64)
        starts = np.flatnonzero(np.diff(ranges, prepend=-1))
        numbers, size = ranges[starts].tolist(), len(ranges)
        del ranges
        for number, start, end in zip(numbers, starts, [*starts[1:], size]):
            left = self.left[start:end]
            runs = np.bincount(((left >> below) - np.uint64(number << within)).astype(np.int64), minlength=1 << within)
            counts = self.counts[start:end].astype(np.uint64)
            yield (
                number,
                int(end - start),
                trimmed(runs.astype(np.uint64), int(runs.max()).bit_length()),
                trimmed(left & np.uint64((1 << int(below)) - 1), int(below)),
                trimmed(self.right[start:end], keys.half),
                trimmed(counts, int(counts.max()).bit_length()),
            )

    @classmethod
    def of_segment(cls, keys: Keys, number: int, n: int, runs: bytes, rest: bytes, right: bytes, counts: bytes):
        within = keys.quotient_bits - keys.range_bits
        quotient = np.repeat(np.arange(1 << within, dtype=np.uint64), full(runs, 1 << within).astype(np.int64))
        quotient += np.uint64(number << within)
        left = quotient << np.uint64(keys.half - keys.quotient_bits) | full(rest, n)
        return cls(left, full(right, n), full(counts, n).astype(np.int64))


def begins(tokens: np.ndarray, order: int, bits: int, frequent: dict[int, np.ndarray]) -> np.ndarray:
    """Where n-grams without a break begin, all shorter parts of which may be frequent."""
    at = np.flatnonzero((tokens[:-1] > 0) & (tokens[1:] > 0))
    for shorter in range(2, order):
        keys = Keys(shorter, bits)
        place = keys.bit(keys.of(tokens, at)[0])
        at = at[frequent[shorter][place >> 3] >> (place & 7).astype(np.uint8) & 1 > 0]
        at = at[:-1][np.diff(at) == 1] if len(at) else at  # its last words are one of these too
    return at


def joined_rows(rows: Iterable[pa.BinaryScalar]) -> Iterator[np.ndarray]:
    """The ids of stored rows, about COUNTED at once; each row ends with a break."""
    some, size = [], 0
    for row in rows:
        some.append(numbers_of(row.as_buffer()))
        size += len(some[-1])
        if size >= COUNTED:
            yield np.concatenate(some)
            some, size = [], 0
    if size:
        yield np.concatenate(some)


def counted_ranges(batches: Iterator[pa.RecordBatch], keys: Keys, frequent: dict) -> Iterator[pa.RecordBatch]:
    """(range, n, runs, rest, right, counts): filters of the n-grams of a task's rows (tokens), cut into ranges."""
    names = ["range", "n", "runs", "rest", "right", "counts"]
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
    filters, size = [], 0

    def passed_on() -> Iterator[pa.RecordBatch]:
        return in_batches(QuotientFilter.merged(filters, keys.half).segments(keys), kinds, names, SEGMENTS)

    for tokens in joined_rows(row for b in batches for row in b.column(0)):
        left, right = keys.of(tokens, at := begins(tokens, keys.order, keys.bits, frequent))
        if not len(at):
            continue
        filters.append(QuotientFilter.merged([QuotientFilter(left, right, np.ones(len(left), np.int64))], keys.half))
        size += len(filters[-1])
        if size >= HELD:
            filters = [QuotientFilter.merged(filters, keys.half)]
            size = len(filters[0])
            if size >= HELD // 2:
                yield from passed_on()
                size = 0
    if filters:
        yield from passed_on()


def merged_ranges(batches: Iterator[pa.RecordBatch], keys: Keys, least: int) -> Iterator[pa.RecordBatch]:
    """(ids, a, range, bits): frequent phrases of each range, up to PHRASES at once, and its part of the bitmap.

    `batches` are rows of `counted_ranges`, in order of their ranges.
    """
    now, filters, size, most = None, [], 0, 2 * RANGE

    def row(ids: pa.Array, a: pa.Array, number: int | None, bits: bytes | None) -> pa.RecordBatch:
        more = [pa.array([x] * len(ids), k) for x, k in ((number, pa.int32()), (bits, pa.binary()))]
        return pa.RecordBatch.from_arrays([ids, a, *more], ["ids", "a", "range", "bits"])

    def done() -> Iterator[pa.RecordBatch]:
        all_of = QuotientFilter.merged(filters, keys.half)
        often = all_of.counts >= least
        left, right, counts = all_of.left[often], all_of.right[often], all_of.counts[often]
        del all_of, often
        for at in range(0, len(counts), PHRASES):
            words = keys.words(left[at : at + PHRASES], right[at : at + PHRASES])
            ends = np.arange(0, words.size + 1, keys.order, dtype=np.int32)
            yield row(pa.ListArray.from_arrays(ends, words.ravel()), pa.array(counts[at : at + PHRASES]), None, None)
        if not len(counts):
            return
        wide = keys.places >> keys.range_bits  # bits of this range; ranges may also be finer than the bitmap
        bits = np.zeros(max(wide, 1), bool)
        bits[(keys.bit(left) - (now * keys.places >> keys.range_bits))] = True
        packed = np.packbits(bits, bitorder="little").tobytes()
        yield row(pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.int64()), now, packed)

    for rows in batches:
        ranges, sizes = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        for i in range(rows.num_rows):
            if ranges[i] != now and filters:
                yield from done()
                size, most = 0, 2 * RANGE
            now = int(ranges[i])
            data = (rows.column(c)[i].as_buffer() for c in range(2, 6))
            filters.append(QuotientFilter.of_segment(keys, now, int(sizes[i]), *data))
            size += int(sizes[i])
            if size >= most:  # a key in many filters
                filters = [QuotientFilter.merged(filters, keys.half)]
                size = len(filters[0])
                most = max(2 * RANGE, 2 * size)
    if filters:
        yield from done()


def frequent_phrases(numbered_: DataFrame, keys: Keys, frequent: dict, least: int) -> tuple[DataFrame, np.ndarray]:
    """(ids, a) of all phrases of keys.order words found at least `least` times, and their bitmap."""
    held = numbered_.sparkSession.sparkContext.broadcast(frequent)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return counted_ranges(batches, keys, held.value)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return merged_ranges(batches, keys, least)

    kinds = "range int, n int, runs binary, rest binary, right binary, counts binary"
    counted = numbered_.select("tokens").mapInArrow(count, kinds)
    placed = counted.repartition("range").sortWithinPartitions("range")
    found = durable(placed.mapInArrow(merge, "ids array<int>, a bigint, range int, bits binary"), "phrases")
    held.destroy()
    bitmap = np.zeros(max(keys.places // 8, 1), np.uint8)
    wide = keys.places >> keys.range_bits
    slices = found.filter("bits IS NOT NULL").select("range", "bits")
    for row in slices.toLocalIterator():  # together as large as the bitmap, about
        if wide >= 8:
            bitmap[row["range"] * wide // 8 : (row["range"] + 1) * wide // 8] = np.frombuffer(row["bits"], np.uint8)
        else:
            one = np.flatnonzero(np.unpackbits(np.frombuffer(row["bits"], np.uint8), bitorder="little"))
            place = (row["range"] * keys.places >> keys.range_bits) + one
            np.bitwise_or.at(bitmap, place >> 3, (1 << (place & 7)).astype(np.uint8))
    return found.filter("ids IS NOT NULL").select("ids", "a"), bitmap


def collocations(
    docs: DataFrame, longest: int = LONGEST, least: int = LEAST, percent: int = 80, top: int = TOP, factor: int = FACTOR
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language of `docs` (text, lang).

    Words and pieces: A-Z are lower-cased, texts parted at `.,;:!?` and ends of lines, words are what stands between
    blanks and tabs. A phrase of 2 to `longest` (4 at most) words found a >= `least` times is cut where
    factor * a / (l + r) is lowest, with l and r the counts of both parts, ties to the first cut. It is dropped if
    a longer phrase that contains it has at least `percent` percent of its count.

    Edge cases: a null text counts as empty, a null language as `und`; repeated rows count each; ties in score
    and count go to the phrase that comes first in byte order; an empty table, or one without frequent phrases,
    gives no row; other columns are not read.
    """
    spark = docs.sparkSession
    lists = word_lists(docs)
    totals = lists.filter("words IS NOT NULL").groupBy("lang").agg(
        F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda x, y: x + y)).alias("n")
    )
    totals = durable(totals, "totals")
    words = vocabulary(lists, least)
    texts = numbered(lists, words)
    sizes = words.agg(F.max("id").alias("ids"), F.count("*").alias("words")).first()
    bits = max(int(sizes["ids"] or 0).bit_length(), 1)
    tokens = texts.agg(F.sum("n").alias("n")).first()["n"] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(parts - 1, tokens // RANGE).bit_length()
    frequent, phrases = {}, None
    for order in range(2, longest + 1):
        found, frequent[order] = frequent_phrases(texts, Keys(order, bits, ranges), frequent, least)
        phrases = found if phrases is None else phrases.unionByName(found)
    size = F.size("ids")
    part = lambda start, length: F.slice("ids", start, length)
    counts = words.select(F.array("id").alias("ids"), F.col("f").alias("a")).unionByName(phrases.filter(size < longest))
    counts = durable(counts, "counts")
    cuts = phrases.select("ids", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    k = F.col("k")
    cuts = cuts.select("ids", "a", "k", part(F.lit(1), k).alias("head"), part(k + 1, size - k).alias("tail"))
    cuts = lookup(durable(cuts, "cuts"), counts.select(F.col("ids").alias("head"), F.col("a").alias("l")), "head")
    cuts = lookup(durable(cuts, "cuts"), counts.select(F.col("ids").alias("tail"), F.col("a").alias("r")), "tail")
    wide = "DECIMAL(38, 0)"
    score = F.expr(f"CAST({factor} AS {wide}) * a div (CAST(l AS {wide}) + r)")
    lowest = cuts.withColumn("score", score).groupBy("ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = [
        phrases.filter(size == n).select(F.explode(F.array([part(i + 1, m) for i in range(n - m + 1)])).alias("ids"), "a")
        for n in range(3, longest + 1)
        for m in range(2, n)
    ]
    kept = lowest
    if inner:
        within = inner[0]
        for more in inner[1:]:
            within = within.unionByName(more)
        within = within.groupBy("ids").agg(F.max("a").alias("longer"))
        covered = F.expr(f"CAST(100 AS {wide}) * longer >= CAST({percent} AS {wide}) * a")
        kept = lowest.join(within, "ids", "left").filter(F.col("longer").isNull() | ~covered)
    kept = durable(kept.select("ids", "a", "cut.score", "cut.l", "cut.r"), "kept")
    spelled = kept.select("ids", F.posexplode("ids").alias("at", "id"))
    spelled = lookup(spelled, words.select("id", "lang", "word"), "id")
    listed = F.array_sort(F.collect_list(F.struct("at", "word")))["word"]
    spelled = spelled.groupBy("ids").agg(F.first("lang").alias("lang"), F.concat_ws(" ", listed).alias("phrase"))
    ranked = kept.join(spelled, "ids").drop("ids")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    first = Window.partitionBy("lang", "salt").orderBy(*order)
    ranked = ranked.withColumn("salt", salt).withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= top)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")
    best = ranked.withColumn("rank", place).filter(F.col("rank") <= top)
    return lookup(best, totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@query(
    r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS g
  FROM w, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(ws) >= m),
f AS (SELECT lang, m, g, count(*) AS f FROM g GROUP BY ALL),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, g, f AS a, string_split(g, ' ') AS ws FROM f WHERE m > 1 AND f >= 30),
k AS (SELECT lang, m, g, a, ws, unnest(range(1, m)) AS k FROM c),
s AS (SELECT k.lang, k.m, k.g, k.a, k.k, h.f AS l, e.f AS r, (2000000::HUGEINT * a // (h.f::HUGEINT + e.f))::BIGINT AS score FROM k
  JOIN f h ON h.lang = k.lang AND h.g = array_to_string(k.ws[1:k.k], ' ')
  JOIN f e ON e.lang = k.lang AND e.g = array_to_string(k.ws[k.k + 1:k.m], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
i AS (SELECT DISTINCT lang, array_to_string(ws[j:j + z - 1], ' ') AS g, a FROM (
  SELECT lang, m, ws, a, z, unnest(range(1, m - z + 2)) AS j FROM (SELECT *, unnest(range(2, m)) AS z FROM c))),
d AS (SELECT b.lang, b.g FROM b JOIN i USING (lang, g) WHERE 100 * i.a >= 80 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, n, score
FROM b JOIN t USING (lang) WHERE (lang, g) NOT IN (SELECT (lang, g) FROM d) QUALIFY rank <= 2000"""
)
def op12_collocations(spark: SparkSession, root: str) -> DataFrame:
    return collocations(table(spark, root, "documents").select("text", "lang"))
