"""Every leaked item within its share of edits is found, whatever its length."""

import random

import numpy as np
import pytest

from tandemlens.llm import decontaminate
from tandemlens.llm.decontaminate import Chunks, Items, most_edits, pieces, symbols_of, words_of


def edited(words, edits, rng):
    """Exactly so many edits, evenly inserts, deletions and replacements, each at a word of its own."""
    out = []
    chosen = set(rng.sample(range(len(words)), edits))
    for i, w in enumerate(words):
        kind = rng.randrange(3) if i in chosen else None
        out += [w] if kind is None else [] if kind == 0 else [f"new{rng.randrange(10**9)}"] + [w] * (kind == 2)
    return out


@pytest.mark.parametrize("share", [0.1, 0.15, 0.2])
@pytest.mark.parametrize("length", [5, 9, 48, 50, 96, 100, 192, 200, 500])
def test_recall_by_length(length, share):
    rng = random.Random(length)
    vocabulary = [f"w{i}" for i in range(5000)]
    items = [rng.choices(vocabulary, k=length) for _ in range(40)]
    held = Items([(i, " ".join(w)) for i, w in enumerate(items)])
    chunks = Chunks(symbols_of)
    texts = []
    for item in items:
        leak = edited(item, int(share * length + 1e-9), rng)
        around = [rng.choices(vocabulary, k=rng.randint(0, 150)) for _ in range(2)]
        texts.append(words_of(" ".join(around[0] + leak + around[1]), chunks))
    found = held.matches(texts)
    assert all((i, i) in found for i in range(40))
    for (t, i), distance in found.items():
        assert distance == decontaminate.edit_distance(held.patterns[i], length, texts[t].tolist())


def test_pieces_are_one_more_than_the_edits():
    for n in range(5, 2000):
        cut = pieces(n)
        assert len(cut) == most_edits(n) + 1 and {size for _, size in cut} <= {2, 3, 4, 5}
        assert [a for a, _ in cut] == np.cumsum([0] + [size for _, size in cut])[:-1].tolist()


def test_candidates_in_small_portions(monkeypatch):
    monkeypatch.setattr(decontaminate, "CANDIDATES", 3)
    text = "one two three four five six seven"
    held = Items([(i, text) for i in range(7)])
    words = [words_of(t, Chunks(symbols_of)) for t in (text, "x y", f"{text} {text}")]
    assert held.matches(words) == {(t, i): 0 for t in (0, 2) for i in range(7)}


def test_query_equals_brute_force(spark):
    root = "/root/testdata/sf0.01"
    chunks = Chunks(symbols_of)
    docs = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    texts = {r.doc_id: words_of(r.text or "", chunks).tolist() for r in docs}
    for r in spark.read.parquet(f"{root}/benchmark.parquet").collect():
        item = words_of(r.text, chunks)
        pattern = decontaminate.pattern(item)
        for doc_id, text in texts.items():
            distance = decontaminate.edit_distance(pattern, len(item), text)
            if distance <= most_edits(len(item)):
                want[doc_id, r.item_id] = distance
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.op2_decontamination(spark, root).collect()}
    assert got == want
