"""Token counts and packing against the tokenizers library on whole texts."""

import random
import zlib

import numpy as np
import pytest
from conftest import DATA
from tokenizers import Tokenizer

from tandemlens.llm import packing, tokens
from tandemlens.llm.packing import Encoder, best_fit, op8_packing, pack
from tandemlens.llm.pretokens import tokenizer_path
from tandemlens.llm.tokens import chunks_of, count_tokens, op10_token_counts, whole_cut

BYTES, WORDS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
ODD = [
    "",
    " ",
    "  a   b \n c\n\n d \t\te  ",
    "It's we'll I'M they're 'sx ' s",
    "a<|endoftext|>b <|endoftext|> <|startoftext|>",
    "١٢٣ ১২ abc½ ª²",
    "é İstanbul ΣΑΣ ſ Ǆ",
    "日本語 🎉 ​﻿　x",
    "a\x1cb\x85c\xa0d\x00e",
    "x" * 50_000,
    "ab! " * 20_000,
    "Ünï cödé, straße\r\nÀ  ",
]


def documents(spark, root=DATA):
    return spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text")


def random_texts(n=400):
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "a", "Bc", "'s", "'", "12", "é", "É", "!?", "\xa0", "ß", "<|endoftext|>", "日", "̀", "ɏ"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(n)]


def test_fast_way_agrees_on_every_character():
    """For each character below U+0250 in several surroundings: pre-tokens and ids as the library's."""
    byte, word = Tokenizer.from_file(BYTES), Encoder(WORDS)
    for code in range(0x250):
        for text in (f"a{chr(code)}1{chr(code)}! {chr(code)} {chr(code)}{chr(code)}b", f"{chr(code)}\n{chr(code)}"):
            cut = [text[a:b] for _, (a, b) in byte.pre_tokenizer.pre_tokenize_str(text)]
            parts = chunks_of(text, BYTES)
            found = [t for p in parts for t in tokens.PATTERN.findall(p)] if parts else whole_cut(text, BYTES)[0]
            assert found == cut, text
            want = word.tokenizer.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(word(text), "<u4").tolist() == want, text


@pytest.mark.parametrize("most", [1 << 18, 1])
def test_counts_equal_library(spark, most):
    texts = [None, *ODD, *random_texts()]
    rows = [(i % 7 or None, t) for i, t in enumerate(texts)]  # ids repeat, some are null
    byte = Tokenizer.from_file(BYTES)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' as token", "1 as row")
    got = count_tokens(docs, BYTES, most).collect()
    want = [(d or 0, len((t or "").encode()), len(byte.encode(t or "", add_special_tokens=False))) for d, t in rows]
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == sorted(want)


def test_count_query(spark):
    byte = Tokenizer.from_file(BYTES)
    got = {r.doc_id: r for r in op10_token_counts(spark, DATA).collect()}
    docs = documents(spark).collect()
    assert len(got) == len(docs)
    for r in docs:
        n = len(byte.encode(r.text, add_special_tokens=False))
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_bytes) == (n, len(r.text.encode()))
        assert got[r.doc_id].over_limit == (n > 1024)


def unpack(rows, ids_of, window):
    """Check pieces against each document's ids; return the fill of each sequence."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc_id, parts in by_doc.items():
        ids, at = ids_of[doc_id], 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return {s: sum(n for _, n in parts) for s, parts in by_sequence.items()}


def ids_with_end(texts):
    word = Tokenizer.from_file(WORDS)
    return {i: np.array(word.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in texts.items()}


def test_packing_query_round_trip(spark):
    texts = {r.doc_id: r.text for r in documents(spark).collect()}
    fill = unpack(op8_packing(spark, DATA).collect(), ids_with_end(texts), 2048)
    assert sum(fill.values()) / (2048 * len(fill)) > 0.95


@pytest.mark.parametrize("group", [1 << 16, 5])
def test_packing_odd_texts(spark, group):
    texts = dict(enumerate([None, *ODD, *random_texts(60)]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").selectExpr("*", "9 as length", "1 as start")
    unpack(pack(docs, WORDS, 64, group).collect(), ids_with_end(texts), 64)


def test_packing_repeats_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c")] * 5 + [(None, None)] * 3, "doc_id bigint, text string")
    rows = pack(docs, WORDS).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows) == [(0, 1)] * 3 + [(1, 4)] * 5
    assert pack(docs.filter("false"), WORDS).count() == 0


def test_best_fit_equals_a_scan_over_all_windows():
    rng = np.random.default_rng(1)
    for _ in range(20):
        lengths = rng.integers(1, 101, 300)
        numbers, offsets = best_fit(lengths, 100)
        space = []
        for i in np.argsort(-lengths, kind="stable"):
            fits = [c for c in space if c >= lengths[i]]
            space.remove(min(fits)) if fits else None
            space.append((min(fits) if fits else 100) - lengths[i])
        left = [100 - int(lengths[numbers == n].sum()) for n in range(numbers.max() + 1)]
        assert sorted(left) == sorted(space)
        assert all(offsets[numbers == n].min() == 0 for n in range(numbers.max() + 1))
    assert packing.best_fit(np.array([], np.int64), 100)[0].size == 0
