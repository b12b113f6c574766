"""Collocations against plain counting, and the filters against dictionaries."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA

from tandemlens.llm import collocations as module
from tandemlens.llm.collocations import Keys, QuotientFilter, collocations, mixed, op12_collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=30, percent=80, top=2000, longest=4):
    counts, total, lang_of = {}, Counter(), {}
    for text, lang in rows:
        lang = "und" if lang is None else lang
        f = counts.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            total[lang] += len(words)
            for m in range(1, longest + 1):
                f.update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        often = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        hidden = {
            g[i : i + m]
            for g, a in often.items()
            for m in range(2, len(g))
            for i in range(len(g) - m + 1)
            if 100 * a >= percent * f[g[i : i + m]]
        }
        scored = []
        for g, a in often.items():
            score, k = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            if g not in hidden:
                scored.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (s, a, g, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, g.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def texts(n=300, seed=1):
    rng = random.Random(seed)
    words = ["the", "New", "york", "city", "of", "é", "日本", "A", "b\x00", "x" * 300, "\x1c", "\xa0", "ß", "İ"]
    stops = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "; ", "!", "\r\n"]
    made = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 30)):
            parts.append("new york city hall" if rng.random() < 0.1 else rng.choice(words))
            parts.append(rng.choice(stops))
        made.append(("".join(parts), rng.choice(["en", "en", "en", "de", None, "und"])))
    return [*made, (None, "en"), ("", None), (" \t ", "en"), ("New York", "only"), *made[:20]]


@pytest.fixture
def small_pieces(monkeypatch):
    for name, value in dict(BATCH_BYTES=700, ROW_WORDS=5, ROW_TOKENS=11, HELD=40, RANGE=30).items():
        monkeypatch.setattr(module, name, value)


def found(spark, rows, **more):
    frame = spark.createDataFrame([(t, x, "y", 3) for t, x in rows], "text string, lang string, phrase string, n int")
    got = collocations(frame.repartition(3), **more)
    return sorted(tuple(r) for r in got.collect())


def test_equals_plain_counting(spark):
    rows = texts()
    want = brute(rows, least=5)
    assert len(want) > 40 and found(spark, rows, least=5) == want


def test_many_small_batches_rows_and_filters(spark, small_pieces):
    rows = texts(120, 2)
    assert found(spark, rows, least=4) == brute(rows, least=4)


def test_skewed_lookups_and_short_lists(skewed):
    rows = texts(80, 3)
    assert found(skewed, rows, least=4, top=7) == brute(rows, least=4, top=7)


def test_nothing_frequent(spark):
    assert found(spark, [("a b c", "en"), (None, None)]) == []
    assert found(spark, []) == []


def test_products_beyond_64_bits(spark):
    rows = [("a b a b", "en")] * 40
    factor = 9 * 10**18
    got = {r[2]: r[7] for r in found(spark, rows, least=30, factor=factor, percent=1000)}
    assert got["a b"] == factor * 80 // 160
    assert got["a b a b"] == factor * 40 // (80 + 80)  # cut in the middle


@pytest.mark.parametrize("half", [1, 5, 20, 31, 40, 62])
def test_permutation_can_be_undone(half):
    rng = np.random.default_rng(half)
    left, right = (rng.integers(0, 1 << half, 5000, dtype=np.uint64) for _ in range(2))
    a, b = mixed(left, right, half)
    assert a.max() < 1 << half and b.max() < 1 << half
    back = mixed(a, b, half, undo=True)
    assert (back[0] == left).all() and (back[1] == right).all()


@pytest.mark.parametrize(("order", "bits", "ranges"), [(2, 3, 2), (2, 20, 6), (3, 9, 4), (4, 16, 18), (4, 31, 3), (3, 31, 0)])
def test_filters_lose_nothing(order, bits, ranges):
    rng, keys = np.random.default_rng(order * bits), Keys(order, bits, ranges)
    low = rng.integers(1, min(1 << bits, 12), 3000).astype(np.int32)
    wide = rng.integers(1, 1 << bits, 3000).astype(np.int32)
    filters, want = [], Counter()
    for tokens in (low, wide, low[::-1].copy()):
        at = np.arange(len(tokens) - order + 1)
        left, right = keys.of(tokens, at)
        filters.append(QuotientFilter.merged([QuotientFilter(left, right, np.ones(len(at), np.int64))], keys.half))
        want.update(tuple(tokens[i : i + order].tolist()) for i in at)
    parts = {}
    for one in filters:
        for segment in one.segments(keys):
            assert segment[0] < 1 << keys.range_bits
            parts.setdefault(segment[0], []).append(QuotientFilter.of_segment(keys, *segment))
    got = Counter()
    for part in parts.values():
        merged = QuotientFilter.merged(part, keys.half)
        for words, n in zip(keys.words(merged.left, merged.right).tolist(), merged.counts.tolist()):
            assert tuple(words) not in got
            got[tuple(words)] = n
    assert got == want


@pytest.mark.parametrize("top", [0, 1, 255, 256, 65_535, 65_536, 2**31 - 1])
def test_stored_numbers(top):
    numbers = np.array([0, top, 3 % (top + 1)], np.int32)
    assert (module.numbers_of(module.stored(numbers)) == numbers).all()
    assert len(module.numbers_of(module.stored(numbers[:0]))) == 0


def test_rows_are_counted_together(monkeypatch):
    monkeypatch.setattr(module, "COUNTED", 5)
    rows = [[1, 2, 0], [3, 0], [4, 5, 6, 7, 8, 0], [], [9, 0]]
    stored = pa.array([module.stored(np.array(r, np.int32)) for r in rows])
    assert [x.tolist() for x in module.joined_rows(stored)] == [[1, 2, 0, 3, 0], [4, 5, 6, 7, 8, 0], [9, 0]]
    assert list(module.joined_rows([])) == []


@pytest.mark.parametrize("half", [32, 40])
def test_merging_takes_few_bytes_a_key(half):
    n, rng = 300_000, np.random.default_rng(half)
    filters = [
        QuotientFilter(*(rng.integers(0, 1 << half, n // 10, dtype=np.uint64) for _ in range(2)), np.ones(n // 10, np.int64))
        for _ in range(10)
    ]
    tracemalloc.start()
    merged = QuotientFilter.merged(filters, half)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(merged) == n and peak < 90 * n


def test_frequent_phrases_of_a_range_come_in_arrays(monkeypatch):
    """Every phrase frequent: no list for each, at most PHRASES in one batch, and the counts of a plain loop."""
    monkeypatch.setattr(module, "HELD", 5000)
    keys, rng = Keys(3, 12, 1), np.random.default_rng(4)
    tokens = [np.append(rng.integers(1, 200, 60_000), 0).astype(np.int32) for _ in range(3)]
    want = Counter(tuple(t[i : i + 3].tolist()) for t in tokens for i in range(len(t) - 3))
    bitmap = {2: np.full(1 << 21, 255, np.uint8)}
    stored = pa.RecordBatch.from_arrays([pa.array([module.stored(t) for t in tokens])], ["tokens"])
    counted = pa.Table.from_batches(module.counted_ranges(iter([stored]), keys, bitmap)).sort_by("range").to_batches(500)
    got, bits, most = Counter(), 0, 0
    monkeypatch.setattr(module, "PHRASES", 1000)
    tracemalloc.start()
    for batch in module.merged_ranges(iter(counted), keys, 1):
        most = max(most, tracemalloc.get_traced_memory()[1])
        rows = batch.column(0).drop_null().values.to_numpy().reshape(-1, 3)
        bits += len(batch) - len(rows)
        assert len(batch) <= 1000
        tracemalloc.stop()
        for words, n in zip(rows.tolist(), batch.column(1).to_pylist()):
            got[tuple(words)] += n
        tracemalloc.start()
    tracemalloc.stop()
    assert got == want and bits == 2 and most < 130 * len(want) / 2


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text", "lang").collect()]
    assert sorted(tuple(r) for r in op12_collocations(spark, DATA).collect()) == brute(rows)
