"""Hard negatives against plain loops, and the bounds of the codes."""

import math
import random

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tandemlens.llm import negatives
from tandemlens.llm.negatives import Anchors, Best, codes_of, hard_negatives, op13_hard_negatives, scores

SCHEMA = "vec_id bigint, label int, embedding array<double>, anchor_id string, score int"


def brute(rows, is_anchor, positives=5, keep=3):
    """Rows are (vec_id, label, embedding); ties between equal ids are left to the scores alone."""
    sound = [
        (i, label, [math.floor(256 * x) for x in e])
        for i, label, e in rows
        if label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)
    ]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for n, (i, label, e) in enumerate(sound):
        if not is_anchor(i):
            continue
        scored = [(dot(e, f), j, other == label) for m, (j, other, f) in enumerate(sound) if m != n]
        near = sorted([(s, j) for s, j, same in scored if same], key=order)[:positives]
        far = sorted([(s, j) for s, j, same in scored if not same], key=order)
        for p, j in near:
            fits = [(s, k) for s, k in far if 50 * p <= 100 * s <= 95 * p][:keep]
            out += [(i, j, rank + 1, k, p, s) for rank, (s, k) in enumerate(fits)]
    return out


def key(row):
    return [(x is None, x or 0) for x in row]


def made(n=400, dims=24, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((6, dims))
    rows = []
    for i in range(n):
        e = (middle[rng.integers(6)] + 0.7 * rng.standard_normal(dims)) / 5
        rows.append((i, int(rng.integers(4)), [float(x) for x in e]))
    return rows


def mined(spark, rows, block=negatives.BLOCK, counted=None):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    found = hard_negatives(frame, F.col("vec_id") % 10 == 0, block=block, counted=counted)
    return sorted((tuple(r) for r in found.collect()), key=key)


def test_intervals_hold_every_score():
    rng = np.random.default_rng(1)
    for scale, dims in ((1, 5), (50, 64), (9, 100)):
        rows = np.floor(scale * 256 * rng.standard_normal((300, dims)))
        rows[:3] = 0
        anchors = np.vstack([rows[:20], np.floor(256 * rng.standard_normal((20, dims)))])
        words, align, rest, size = codes_of(rows)
        held = Anchors(anchors, np.zeros(40), np.arange(40))
        ones = np.bitwise_count(words).sum(axis=1).astype(np.int32)
        low, high = held.interval(np.arange(40), words, ones, align, rest, size, np.linalg.norm(rows, axis=1))
        exact = anchors @ rows.T
        assert (low <= exact).all() and (exact <= high).all()
        width = (high - low)[3:, 3:] / (np.linalg.norm(anchors, axis=1)[3:, None] * np.linalg.norm(rows, axis=1)[3:])
        assert width.mean() < 1.0  # of 2, the width that says nothing


@pytest.mark.parametrize("block", [1 << 15, 7])
def test_equals_plain_loops(spark, block):
    rows = made()
    assert mined(spark, rows, block) == sorted(brute(rows, lambda i: i % 10 == 0), key=key)


def test_pairs_are_filtered_before_they_are_scored(spark):
    rng = np.random.default_rng(8)
    middle = rng.standard_normal((20, 64))
    rows = [(i, i % 20, [float(x) for x in (middle[i % 20] + 0.4 * rng.standard_normal(64)) / 8]) for i in range(3000)]
    counted = spark.sparkContext.accumulator(0)
    found = mined(spark, rows, counted=counted)
    assert found == sorted(brute(rows, lambda i: i % 10 == 0), key=key)
    assert counted.value < 0.35 * 300 * 3000


def test_edge_cases(spark):
    rows = made(120, 8)
    rows += [(1000, None, [1.0] * 8), (1010, 1, None), (1020, 1, [1.0, None] * 4), (1030, 1, [float("nan")] * 8)]
    rows += [(1040, 1, [float("inf")] + [0.0] * 7), (None, 1, rows[0][2]), (None, 2, rows[1][2]), (1050, 2, [0.0] * 8)]
    rows += [(2000 + i, 1, rows[10][2]) for i in range(6)] + [(2100 + i, 2, rows[10][2]) for i in range(6)]  # ties
    rows += [(3000, 3, []), (3001, 3, [0.5, 0.25]), (3010, 3, [0.5])]  # lengths differ
    rows += [(4000, 9, [2.0] * 8)]  # the only row of its label
    assert mined(spark, rows, 6) == sorted(brute(rows, lambda i: i is not None and i % 10 == 0), key=key)


def test_repeated_rows_count_each(spark):
    rows = made(80, 8)
    doubled = rows + rows[:10]
    found = mined(spark, doubled)
    want = sorted(brute(doubled, lambda i: i % 10 == 0), key=key)
    assert found == want


def test_large_components():
    exact = np.array([[2.0**30, 3.0, 1.0]]), np.array([[2.0**30, 1.0, -1.0]])
    assert scores(*exact).tolist() == [2**60 + 2]
    with pytest.raises(OverflowError):
        scores(np.array([[2.0**40]]), np.array([[2.0**40]]))


def test_best_keeps_ties_by_id_and_row():
    rng, best, plain = random.Random(2), Best(2, 1, 4), {0: [], 1: []}
    row = 0
    for _ in range(30):
        size = rng.randint(1, 9)
        place = [rng.randint(0, 1) for _ in range(size)]
        added = [(rng.randint(-3, 3), rng.randint(0, 4), row + i) for i in range(size)]
        row += size
        best.add(np.array(place), *(np.array(x) for x in zip(*added)))
        for p, (s, i, r) in zip(place, added):
            plain[p].append((-s, i, r))
        for p in plain:
            want = sorted(plain[p])[:4]
            assert [(-int(s), i, r) for s, i, r in zip(best.score[p], best.id[p], best.row[p])][: len(want)] == want


def test_empty_table(spark):
    assert mined(spark, []) == []


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    moved = [(i, (label + 1) % 10 if i % 7 == 0 else label, e) for i, label, e in rows]
    found = op13_hard_negatives(spark, DATA)
    assert dict(found.dtypes) == {
        "anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"
    }
    assert sorted(map(tuple, found.collect()), key=key) == sorted(brute(moved, lambda i: i % 50 == 0), key=key)
