"""Byte-level BPE against the tiktoken library and against merging by search."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from conftest import DATA

from tandemlens.llm.bpe import Encoder, Merges, bytes_of, decode, encode, merge_ranks, op11_bpe
from tandemlens.llm.pretokens import tokenizer_path

PATH, PATTERN = tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
MANY = tokenizer_path("byte_bpe_multi_50k.tiktoken")
ODD = [
    "", " ", "   ", "  a   b \n c\n\n d \t\te  ", "It's we'll I'M they're 'sx ' s", "a<|endoftext|>b <|endoftext|>",
    "١٢٣ ১২ abc½ ª²", "é İstanbul ΣΑΣ ſ Ǆ", "日本語 🎉 ​﻿　x", "a\x1cb\x85c\xa0d\x00e", "x 　y \x1c z    w",
    "x" * 30_000, "ab! " * 20_000, "aaaa" * 501, "Ünï cödé, straße\r\nÀ  ", "\n \n  \n", " \n x", "ключ 熊 \U0001f469‍\U0001f680",
]


def library(path=PATH):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=merge_ranks(path), special_tokens={})


def texts(n=600):
    rng = random.Random(5)
    parts = [" ", "  ", "\n", "\t", "a", "Bc", "aa", "'s", "'", "12", "é", "!?", "\xa0", "ß", "<|endoftext|>", "日", "̀", "the", "\x1c"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 16))) for _ in range(n)]


def as_bytes(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


def test_every_character():
    """In several surroundings, so that the classes of both regular expression libraries agree."""
    own, theirs = Encoder(PATH, PATTERN), library()
    codes = [c for c in [*range(0x20000), *range(0x20000, 0x110000, 97)] if not 0xD800 <= c < 0xE000]
    for start in range(0, len(codes), 512):
        text = "".join(f"a{chr(c)}1{chr(c)} {chr(c)}" for c in codes[start : start + 512])
        if own(text) != as_bytes(theirs.encode_ordinary(text)):
            wrong = [hex(c) for c in codes[start : start + 512] if own(t := f"a{chr(c)}1 {chr(c)} b") != as_bytes(theirs.encode_ordinary(t))]
            raise AssertionError(wrong)


def by_search(piece, ranks):
    """Merge the leftmost pair of least rank until there is none."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        at = min(found)[1]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


def test_merges_equal_search_with_ranks_in_any_order():
    """Also where a merge makes a pair of lower rank than its own."""
    rng = random.Random(2)
    for size in [25] * 60 + [400] * 10:
        tokens = {bytes([c]) for c in b"abc"}
        while len(tokens) < size:
            tokens.add(b"".join(rng.choices(sorted(tokens), k=2)))
        order = sorted(tokens)
        rng.shuffle(order)
        ranks = {t: i for i, t in enumerate(order)}
        merged = Merges(ranks)
        for _ in range(20):
            piece = bytes(rng.choices(b"abc", k=rng.randint(1, 40)))
            assert merged(piece) == by_search(piece, ranks), (piece, ranks)
            assert not any(merged.groups)


@pytest.mark.parametrize("path", [PATH, MANY])
def test_ids_equal_library_and_decode_to_the_text(spark, path):
    rows = [(i % 5 or None, t) for i, t in enumerate([None, *ODD, *texts()])]  # ids repeat, some are null
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "text", "'x' AS ids", "1 AS decoded")
    theirs = library(path)
    found = [(r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in decode(encode(docs, path, PATTERN), path).collect()]
    want = [(d, as_bytes(theirs.encode_ordinary(t or "")), (t or "").encode()) for d, t in rows]
    key = lambda r: (r[0] or 0, r[1])
    assert sorted(found, key=key) == sorted(want, key=key)


def test_full_cache_changes_nothing():
    small, large = Encoder(PATH, PATTERN, 3000), Encoder(PATH, PATTERN)
    for text in [*ODD[:10], *texts(100), *ODD[:10]]:
        assert small(text) == large(text)
        assert len(small) < 12 and len(small.old) < 12


def test_one_long_pretoken():
    rng = random.Random(4)
    text = "".join(rng.choices("abcdefgh", k=100_000))
    assert Encoder(PATH, PATTERN)(text) == as_bytes(library().encode_ordinary(text))


def test_unknown_ids_and_bytes_fail(tmp_path):
    file = tmp_path / "gap.tiktoken"
    file.write_bytes(b"YQ== 0\nYg== 2\n")
    assert bytes_of((2).to_bytes(4, "little"), str(file)) == b"b"
    with pytest.raises(ValueError):
        bytes_of((1).to_bytes(4, "little"), str(file))
    with pytest.raises(IndexError):
        bytes_of((3).to_bytes(4, "little"), str(file))
    with pytest.raises(KeyError):
        Merges({b"a": 0})(b"ab")


def test_query_on_whole_table(spark):
    theirs = library()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want = set()
    for d, t in docs:
        ids = theirs.encode_ordinary(t or "")
        want.add((d, len(ids), hashlib.sha256(as_bytes(ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    found = op11_bpe(spark, DATA)
    assert dict(found.dtypes)["n_tokens"] == "bigint"
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(docs)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert decode(encode(empty, PATH, PATTERN), PATH).count() == 0
