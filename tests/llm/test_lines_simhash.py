"""Line deduplication and SimHash against plain loops over all pairs."""

import hashlib
from itertools import combinations

import pytest
import xxhash
from conftest import DATA

from tandemlens.llm.lines import dedup_lines, op5_line_dedup
from tandemlens.llm.simhash import fingerprint_of, keep_one, near_duplicates, op7_simhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SPACE = " \t\n\x0b\x0c\r"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_lines(rows):
    """{doc_id: (n_lines, n_dropped, text)} for distinct ids."""
    key = lambda line: line.strip(SPACE).translate(UPPER)
    holders = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(doc_id)
    gone = {k: max(v) for k, v in holders.items() if len(k) >= 20 and len(v) >= 3}
    out = {}
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if gone.get(key(x), doc_id) == doc_id]
        out[doc_id] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


SHARED = "A line that Many documents SHARE"
TEXTS = [
    None,
    "",
    "\n",
    f"{SHARED}\nown line of the first document",
    f"  {SHARED.lower()}\t\nx\n{SHARED}",
    f"\x0b{SHARED.upper()}\r\n" + "É" * 20,
    "nineteen characters\n" * 3,
    "nineteen characters",
    "NINETEEN characters",
    "é" * 20 + "\n" + SHARED,
    "\x1f" + SHARED,
    "y" * 200_000 + "\n" + SHARED,
]


def test_line_dedup_equals_loops(spark):
    rows = list(enumerate(TEXTS))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in dedup_lines(docs).collect()}
    assert got == plain_lines(rows)
    assert got[11][1] == 0 and got[9][1] == 1


def test_line_dedup_repeats_nulls_and_clashing_names(spark):
    rows = [(1, SHARED, "k1"), (1, SHARED, "k2"), (2, SHARED, None), (None, SHARED + "\nb", "k3"), (None, "c", "k4")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, `keys` string").selectExpr(
        "*", "1 as n_lines", "2 as `a.b`", "3 as row"
    )
    out = dedup_lines(docs).collect()
    assert sorted((r["keys"] or "", r.text) for r in out) == [
        ("", SHARED), ("k1", ""), ("k2", ""), ("k3", "b"), ("k4", "c"),
    ]
    assert {r["a.b"] for r in out} == {2} and {r.row for r in out} == {3}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert dedup_lines(none).count() == near_duplicates(none).count() == keep_one(none).count() == 0


def plain_print(text):
    words = [w for w in (text or "").translate(UPPER).translate({ord(c): " " for c in SPACE}).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """{doc_id: smallest reachable} over all pairs."""
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: find(d) for d in prints}


def test_simhash_equals_all_pairs(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    prints = {r.doc_id: plain_print(r.text) for r in docs}
    want = plain_components(prints)
    got = op7_simhash(spark, DATA).collect()
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in got} == {
        d: (prints[d], want[d]) for d in prints
    }


@pytest.mark.parametrize("text", [None, "", " \t", "One", "one TWO", "É b c d", "\x1ca b c", "w " * 40_000])
def test_fingerprints_of_odd_texts(text):
    assert fingerprint_of(text) == plain_print(text)


@pytest.mark.parametrize("hot", [256, 2])
def test_links_at_every_distance(spark, monkeypatch, hot):
    """Fingerprints given, not computed: chains, bit 63, distances 0 to 3, a dense ball, segments that many share."""
    import random

    from tandemlens.llm import simhash
    from tandemlens.llm.graph import components

    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)] + [0, (1 << 64) - 1]
    values = set(base)
    for x in base:
        for n in (1, 2, 3):
            y = x
            for bit in rng.sample(range(64), n):
                y ^= 1 << bit
            values.add(y)
    for a, b in combinations(range(56, 64), 2):
        values.add(base[0] ^ (1 << a) ^ (1 << b))
    values.update(base[2] ^ rng.getrandbits(32) for _ in range(40))  # one high segment, any low one
    values.update(base[3] ^ (rng.getrandbits(6) << 40) for _ in range(40))
    chain = base[1]
    for bit in range(0, 40, 2):
        chain ^= 3 << bit
        values.add(chain)
    ids = {v: i for i, v in enumerate(sorted(values))}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    found = simhash.links(spark.createDataFrame(signed, "fp bigint"))
    pairs = {tuple(sorted((r.a % (1 << 64), r.b % (1 << 64)))) for r in found.collect()}
    assert pairs == {(a, b) for a, b in combinations(sorted(values), 2) if (a ^ b).bit_count() <= 2}
    want = plain_components({i: v for v, i in ids.items()})
    classes = {}
    for r in components(found).collect():
        classes.setdefault(r.label, set()).add(ids[r.node % (1 << 64)])
    by_root = {}
    for i, root in want.items():
        by_root.setdefault(root, set()).add(i)
    assert sorted(map(sorted, classes.values())) == sorted(sorted(v) for v in by_root.values() if len(v) > 1)


def test_near_duplicates_keep_one(spark):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(7, text, "a"), (3, text, "b"), (3, text, "b"), (None, text, "c"), (9, "", "d"), (4, None, "e"), (5, "z", "f")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, component_id string")
    got = sorted((r.doc_id or -1, r.component_id) for r in keep_one(docs).collect())
    assert got == [(-1, "c"), (3, "b"), (4, "e"), (5, "f")]
    ids = {(r.doc_id, r.component_id) for r in near_duplicates(docs).collect()}
    assert ids == {(7, 3), (3, 3), (None, 3), (9, 4), (4, 4), (5, 5)}


def test_line_query_digest(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want = plain_lines([(r.doc_id, r.text) for r in docs])
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in op5_line_dedup(spark, DATA).collect()}
    assert got == {d: (a, b, hashlib.sha256(t.encode()).hexdigest()) for d, (a, b, t) in want.items()}
