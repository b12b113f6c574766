"""The pipeline's near-dedup against the exact five-word Jaccard similarity of all pairs."""

import random
from itertools import combinations

import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tandemlens.llm import minhash, simhash
from tandemlens.llm.minhash import PORTION, portions, shingles_of
from tandemlens.llm.pretokens import Chunks, take_turn


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def plain_firsts(rows):
    """Smallest ids of the groups that pairs of similarity 0.8 link."""
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {d: plain_shingles(t) for d, t in rows}
    for a, b in combinations(sorted(root), 2):
        if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d for d in root if find(d) == d}


def planted():
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdeiou", k=rng.randint(3, 8))) for _ in range(3000)]
    rows = []
    for n in (8, 20, 60, 150, 400, 2000):
        for _ in range(8):
            base = rng.choices(words, k=n)
            rows.append(base)
            for share in (0.002, 0.01, 0.02, 0.03, 0.06):
                copy = list(base)
                for at in rng.sample(range(n), max(1, int(share * n))):
                    copy[at] = rng.choice(words)
                rows += [copy, base + rng.choices(words, k=max(1, int(share * n)))]
    hot = rng.choices(words, k=100)  # many copies, of which most are not similar to each other
    for _ in range(200):
        copy = list(hot)
        for at in rng.sample(range(100), rng.randint(1, 4)):
            copy[at] = rng.choice(words)
        rows.append(copy)
    texts = [" ".join(w) for w in rows] + [None, "", " ", "One two", "one TWO", "one two three"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_near_dedup_keeps_one_of_each_similar_pair(spark, tmp_path):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as n", "2 as band")
    kept = corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in kept} == plain_firsts(rows) and len(kept) < len(rows) // 2
    assert {r.n for r in kept} == {1} and {r.band for r in kept} == {2}


def test_one_appended_word_is_a_near_copy(spark, tmp_path):
    base = " ".join(f"word{i}" for i in range(120))
    other = " ".join(f"word{i}" for i in range(60)) + " " + " ".join(f"more{i}" for i in range(60))
    rows = [(11, base), (13, base), (17, base + " more"), (19, other), (None, base)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 11, 19]


def test_shingle_sets():
    assert len(shingles_of("a b c d e f")) == 2 and len(shingles_of("a b")) == 1 and len(shingles_of(None)) == 0
    assert len(shingles_of("w " * 5000)) == 1


def test_signing_holds_a_portion_and_no_earlier_caches():
    text = pa.array(["a" * PORTION, None, "b c", "", "d" * (PORTION // 2), "e" * (PORTION // 2)])
    assert list(portions(text)) == [(0, 1), (1, 5), (5, 6)] and list(portions(text.slice(6))) == []
    earlier = Chunks(str.upper, "earlier")
    earlier.trim()
    assert earlier["x"] == "X" and len(earlier) == 1
    take_turn("shingles")
    assert not earlier and earlier.held == 0


@pytest.mark.parametrize("hot", [256, 1])
def test_near_fingerprints_equal_all_pairs(spark, monkeypatch, hot):
    """Of other labels, at most seven bits apart, equal ones too, segments that many share."""
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(6)
    rows, base = [], [rng.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    for x in base:
        for n in (0, 0, 1, 2, 5, 7, 7, 7, 7, 8, 9):
            for _ in range(4):
                fp = x
                for bit in rng.sample(range(64), n):
                    fp ^= 1 << bit
                rows.append((len(rows), fp, rng.randrange(3)))
    rows += [(len(rows) + i, base[1] ^ (rng.getrandbits(48) << 16), 5 + i) for i in range(60)]
    signed = [(c, fp - (1 << 64) if fp >> 63 else fp, label) for c, fp, label in rows]
    frame = spark.createDataFrame(signed, "content bigint, fp bigint, label bigint")
    got = [(r.a, r.b) for r in simhash.near_prints(frame).collect()]
    want = {(a[0], b[0]) for a, b in combinations(rows, 2) if a[2] != b[2] and (a[1] ^ b[1]).bit_count() <= 7}
    assert len(got) == len(want) > 2000 and set(got) == want
    with pytest.raises(ValueError):
        simhash.links(frame, 8)


def test_more_candidates_are_verified(spark):
    """At 0.4 bands miss most pairs; all pairs handed in, the similar ones are linked and no others."""
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdeiou", k=6)) for _ in range(500)]
    rows = []
    for _ in range(25):
        base = rng.choices(words, k=60)
        rows += [base, base[:40] + rng.choices(words, k=18), base[:20] + rng.choices(words, k=40)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)] + [(99, "")], "doc_id bigint, text string")

    def nearby(prints):
        assert prints.columns == ["content", "fp", "label"]
        one, other = prints.selectExpr("content as a", "label as x"), prints.selectExpr("content as b", "label as y")
        return one.join(other, (F.col("a") < F.col("b")) & (F.col("x") != F.col("y"))).select("a", "b")

    got = {r.doc_id: r.component_id for r in minhash.similar_rows(docs, nearby, 0.4).collect()}
    assert got == {i: i // 3 * 3 + 2 * (i % 3 == 2) for i in range(75)} | {99: 99}
    assert got != {r.doc_id: r.component_id for r in minhash.similar_documents(docs, 0.4).collect()}


def test_near_dedup_searches_fingerprints(spark, tmp_path, monkeypatch):
    asked = []
    monkeypatch.setattr(simhash, "links", lambda *args, f=simhash.links: asked.append(args[1:]) or f(*args))
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, None)], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()) == [1, 3]
    assert asked == [(7, "content", "label")]


def test_rows_that_repeat_an_id_are_decided_by_their_own_texts(spark, tmp_path):
    text = lambda name: " ".join(f"{name}{i}" for i in range(40))
    rows = [(1, text("a")), (2, text("a")), (2, text("b")), (3, text("c")), (3, text("d")), (3, text("d"))]
    rows += [(None, text("a")), (None, text("e")), (4, text("e") + " more"), (5, text("b"))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as content", "2 as root")
    kept = corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()
    want = [(1, "a0"), (2, "b0"), (3, "c0"), (3, "d0"), (4, "e0"), (0, "a0"), (0, "e0")]
    assert sorted((r.doc_id or 0, r.text.split()[0]) for r in kept) == sorted(want)
    assert {(r.content, r.root) for r in kept} == {(1, 2)}
