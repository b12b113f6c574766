"""BM25 with pruning against scoring every document."""

import math
import random
import re
from collections import Counter
from functools import partial

import pytest

from tandemlens.operators import retrieval
from tandemlens.operators.retrieval import bm25_index, bm25_search


def brute(docs, queries, k):
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    tf = [Counter(cut(t)) for _, t in docs]
    mean = sum(sum(c.values()) for c in tf) / len(docs)
    df = Counter(w for c in tf for w in c)
    out = []
    for q, text in queries:
        scored = []
        for n, ((i, _), c) in enumerate(zip(docs, tf)):
            norm = 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)
            share = [
                m * math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + norm)
                for w, m in Counter(cut(text)).items()
                if w in c
            ]
            if share:
                scored.append((-round(sum(share), 9), i))
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 60)))) for i in range(n)]
    docs += [(n + i, docs[i][1].upper()) for i in range(30)]  # copies, so scores tie
    docs += [(n + 50, None), (n + 51, ""), (n + 52, "Élan, élan; 日本 3.5!")]
    queries = [(q, " ".join(rng.choices(words, weights, k=rng.randint(1, 25)))) for q in range(25)]
    queries += [(30, docs[3][1]), (31, "w0 w1 w0"), (32, "nowhere"), (33, None), (34, "ÉLAN w0"), (35, "日本"), (36, "w299 w0")]
    return docs, queries


def compared(spark, docs, queries, k, **more):
    index = bm25_index(spark.createDataFrame(docs, "doc_id int, text string").repartition(3), "doc_id", "text", span=16)
    asked = spark.createDataFrame(queries, "query_id int, text string")
    found = bm25_search(index, asked, k, **more).collect()
    got = sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in found)
    want = sorted(brute(docs, queries, k))
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=1e-8)


@pytest.mark.parametrize("k", [1, 10])
@pytest.mark.parametrize("seed", [1, 40, 10_000])
def test_pruning_loses_no_hit(spark, k, seed):
    docs, queries = corpus()
    compared(spark, docs, queries, k, seed=seed)


def test_every_route_for_skewed_keys(skewed):
    docs, queries = corpus(120, 2)
    compared(skewed, docs, queries, 5)


def test_fewer_postings_are_read_than_there_are(spark, monkeypatch):
    """A frequent word does not bring in its documents where a rare word decides."""
    docs = [(i, "the of " + ("rare " * 5 if i % 50 == 0 else f"x{i} ")) for i in range(1000)]
    read = []
    plain = retrieval._posted

    def counting(index, asked):
        df = plain(index, asked)
        read.append(df.count())
        return df

    monkeypatch.setattr(retrieval, "_posted", counting)
    index = bm25_index(spark.createDataFrame(docs, "doc_id int, text string"), "doc_id", "text", span=16)
    queries = spark.createDataFrame([(1, "the rare of")], "query_id int, text string")
    assert bm25_search(index, queries, 5, seed=100).count() == 5
    assert max(read) <= 40  # 20 documents have the rare word, 1,000 the others


def test_no_documents_or_queries(spark):
    docs, none = corpus(5)[0], spark.createDataFrame([], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "w0")], "query_id int, text string")
    assert bm25_search(bm25_index(none, "doc_id", "text"), asked, 3).count() == 0
    index = bm25_index(spark.createDataFrame(docs, "doc_id int, text string"), "doc_id", "text")
    assert bm25_search(index, asked.limit(0), 3).count() == 0


def test_blocks_are_made_without_a_shuffle(spark, monkeypatch):
    plans = {}
    plain = retrieval.durable

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return plain(df, name)

    monkeypatch.setattr(retrieval, "durable", kept)
    bm25_index(spark.createDataFrame(corpus()[0], "doc_id int, text string"), "doc_id", "text", span=16)
    assert "Exchange" not in plans["bm25-blocks"]


def test_terms_with_several_blocks_in_a_range(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "_blocks", partial(_small_pieces, retrieval._blocks))
    docs, queries = corpus(150, 3)
    compared(spark, docs, queries, 4, seed=30)


def _small_pieces(made, *args):
    """The blocks of batches of three documents each."""
    blocks = made(*args)

    def of(batches):
        return blocks(b.slice(at, 3) for b in batches for at in range(0, b.num_rows, 3))

    return of
