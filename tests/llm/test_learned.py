"""Toxicity, language and quality rules: held-out accuracy, counts against loops, edge cases."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tandemlens.llm import language, quality, toxicity

LARGER = "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def accuracy(df, hit):
    row = df.agg(F.avg(hit.cast("double")).alias("a"), F.count("*").alias("n")).first()
    return row.a, row.n


def test_language_on_held_out_documents(spark):
    found = language.op9_language(spark, LARGER)
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang", "n_chars")
    both = found.join(docs, "doc_id")
    share, n = accuracy(both.filter("held_out AND n_chars >= 60"), F.col("lang") == F.col("lang_pred"))
    assert n > 150 and share > 0.97
    assert found.count() == docs.count()
    assert found.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_language_edge_cases(spark):
    learn = spark.createDataFrame(
        [(i, ("the of and that with " if i % 2 else "der die das und nicht ") * 30, "en" if i % 2 else "de") for i in range(40)]
        + [(90, "the", None), (91, None, "fr"), (92, "12 34", "es")],
        "doc_id bigint, text string, lang string",
    )
    net = language.fit(learn)
    assert net.languages == ["de", "en"]
    texts = [None, "", "12 !", "the of and", "der die das " * 20_000, "die"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = [r.out for r in docs.select("doc_id", language.predict(spark, F.col("text"), net).alias("out")).orderBy("doc_id").collect()]
    assert [r.lang_pred for r in got[:5]] == ["und", "und", "und", "en", "de"]
    assert all(0 <= r.score <= 1 for r in got)
    assert language.fit(learn.filter("false")) is None
    nothing = docs.select(language.predict(spark, F.col("text"), None).alias("out")).collect()
    assert {r.out.lang_pred for r in nothing} == {"und"}


def test_convolution_equals_a_plain_one():
    rng = np.random.default_rng(0)
    net = language.ByteNetwork.fresh(["a", "b"], rng)
    rows = rng.integers(0, 256, (5, language.WINDOW)).astype(np.uint8)
    wide = np.pad(rows, ((0, 0), (0, language.TAPS)))
    plain = np.full((5, net.filters.shape[2]), -np.inf)
    for i in range(language.WINDOW):
        at = sum(net.embedding[wide[:, i + t]] @ net.filters[t] for t in range(language.TAPS))
        plain = np.maximum(plain, at)
    pooled, _ = net.pooled(rows, net.pairs())
    assert np.allclose(pooled, plain + net.bias, atol=1e-4)
    assert np.allclose(np.exp(net.log_probabilities(rows, net.pairs())).sum(1), 1, atol=1e-4)


def test_windows_cover_whole_texts():
    for n in (0, 1, 255, 256, 257, 5000):
        rows, sizes = language.windows_of("x" * n)
        assert sizes.sum() == n and rows.tobytes().rstrip(b"\0") == b"x" * n


def test_toxicity_on_held_out_documents(spark):
    found = toxicity.op4_toxicity(spark, LARGER)
    labels = spark.read.parquet(f"{LARGER}/labels.parquet").select("doc_id", "toxic")
    both = found.join(labels, "doc_id").filter("held_out")
    toxic, clean = both.filter("toxic = 1"), both.filter("toxic = 0")
    assert clean.filter("predicted = 1").count() <= 0.02 * clean.count()
    pairs = toxic.select(F.col("score").alias("a")).crossJoin(clean.select(F.col("score").alias("b")))
    assert accuracy(pairs, F.col("a") > F.col("b"))[0] > 0.85
    assert found.count() == spark.read.parquet(f"{LARGER}/documents.parquet").count()


def test_toxicity_learns_unknown_words_and_odd_texts(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(60)]
    rows = []
    for i in range(600):
        text = rng.choices(words, k=30)
        if i % 5 == 0:
            text.insert(rng.randrange(30), "zorgal" + rng.choice(["", "ten", "isch"]))
        rows.append((i, " ".join(text), int(i % 5 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    odd = [None, "", "zorgalen ist das", " ".join(words), "zorgal " * 50_000, "you idiot, zorgal!"]
    got = spark.createDataFrame(list(enumerate(odd)), "doc_id bigint, text string")
    p = [r.p for r in got.select("doc_id", toxicity.score(spark, F.col("text"), model).alias("p")).orderBy("doc_id").collect()]
    assert p[0] == p[1] < 0.2 and p[3] < 0.2
    assert min(p[2], p[4], p[5]) > 0.7


def test_toxicity_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "you moron, you idiot"), (None, "fine"), (1, None)], "doc_id bigint, text string").withColumn(
        "score", F.lit("mine")
    )
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    kept = toxicity.drop_toxic(docs, labels).collect()
    assert sorted((r.doc_id or 0, r.text, r.score) for r in kept if r.text) == [(0, "fine", "mine")] and len(kept) == 2
    assert toxicity.drop_toxic(docs.filter("false"), labels).count() == 0


def test_label_model_outvotes_wrong_labels():
    rng = np.random.default_rng(4)
    truth = rng.random(4000) < 0.2
    votes = np.column_stack([rng.random(4000) < np.where(truth, 0.6, 0.02) for _ in range(12)]).astype(float)
    votes = np.column_stack([votes, votes[:, :1], votes[:, :1]])  # copies of one voter
    labels = np.where(rng.random(4000) < 0.1, ~truth, truth).astype(float)
    q = toxicity.posterior(votes, labels)
    assert ((q > 0.5) == truth).mean() > 0.98 > (labels == truth).mean()


def plain_base(text):
    words = [w for w in "".join(" " if c in quality.SPACE else c for c in text or "").split(" ") if w]
    lines = [x for x in (text or "").split("\n") if x.strip(quality.SPACE)]
    runs = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if runs[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return (
        len(words), sum(map(len, words)), sum(c in quality.SYMBOLS for c in text or ""),
        sum(x in lines[:i] for i, x in enumerate(lines)), len(covered),
    )


def test_base_statistics_equal_loops(spark):
    rng = random.Random(1)
    texts = [None, "", "\n \n", "a b c a b c a", "É\x1cé #*$%&|<>\n#\n#\n \n#", "x y z\nx y z", "one two"]
    texts += [" ".join(rng.choices("a b c d e \n".split(" "), k=rng.randint(1, 60))) for _ in range(200)]
    texts += [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    for text in texts:
        assert quality.base_statistics(text) == plain_base(text), text


def plain_kneser_ney(texts, order):
    """p(byte | context) of all orders by the textbook's formulas, from dictionaries."""
    counts = {order: Counter()}
    for text in texts:
        for g in quality.grams(text, order).tolist():
            counts[order][g.to_bytes(order, "big")] += 1
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    tables = {}
    for k, c in counts.items():
        few = Counter(c.values())
        y = few[1] / (few[1] + 2 * few[2]) if few[1] + few[2] else 0.5
        d = [max(0.05, min(0.95 * j, j - (j + 1) * y * (few[j + 1] / few[j] if few[j] else 0))) for j in (1, 2, 3)]
        total, freed = Counter(), defaultdict(float)
        for g, n in c.items():
            total[g[:-1]] += n
            freed[g[:-1]] += d[min(n, 3) - 1]
        tables[k] = c, d, total, freed

    def p(g):
        if not g:
            return 1 / 256
        c, d, total, freed = tables[len(g)]
        if not total[g[:-1]]:
            return p(g[1:])
        alpha = max(c[g] - d[min(c[g], 3) - 1], 0) / total[g[:-1]] if c[g] else 0
        return alpha + freed[g[:-1]] / total[g[:-1]] * p(g[1:])

    return lambda text: -sum(math.log(p(g.to_bytes(order, "big"))) for g in quality.grams(text, order).tolist()) / len(
        quality.grams(text, order)
    )


@pytest.mark.parametrize("seen", [True, False])
def test_perplexity_equals_textbook(spark, seen):
    texts = ["the cat sat on the mat", "a dog sat there, and a cat", "bcd bcd abc ä"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)] + [(9, None, None)], "doc_id bigint, text string, lang string")
    model = quality.HashedModel(quality.model_tables(docs))
    want = plain_kneser_ney(texts, quality.ORDER)
    for text in texts if seen else ["the dog", "zzz cat q", "Ünder the mat"]:
        assert model.log_perplexity(text, "en") == pytest.approx(want(text), rel=1e-3)
    assert model.log_perplexity(" ", "en") is None


@pytest.mark.parametrize("block", [None, 5000])
def test_no_two_ngrams_share_a_probability(spark, block):
    """30,000 n-grams or so, in one block or several: each keeps its own, whatever else has a hash near its own."""
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abcdefghij ")) for _ in range(int(n))) for n in rng.integers(10, 200, 300)]
    rows = [(i, t, "fr" if i % 3 == 0 else "en") for i, t in enumerate(texts)] + [(900, None, "en"), (901, " ", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in quality.log_perplexities(docs, quality.model_tables(docs), block).collect()}
    want = {g: plain_kneser_ney([t for _, t, of in rows if of == g and t], quality.ORDER) for g in ("en", "fr")}
    for i, text, lang in rows[:-2]:
        assert got[i].log_perplexity == pytest.approx(want[lang](text), rel=1e-6) if text.strip() else got[i].log_perplexity is None
    assert got[900].log_perplexity is None and got[901].log_perplexity is None
    assert len(got) == len(rows)


def test_a_hash_that_is_not_stored_is_a_miss():
    stored = np.unique(np.random.default_rng(6).integers(0, 1 << 63, 50_000, np.uint64) * np.uint64(2) + np.uint64(1))
    stored = np.append(stored, ~np.uint64(0))
    arrays = quality.HashArrays(stored, np.arange(len(stored), dtype=np.float32))
    assert (arrays[stored] == np.arange(len(stored))).all()
    assert np.isnan(arrays[stored - np.uint64(1)]).all() and np.isnan(quality.NOTHING[stored]).all()


def test_quality_rules_edge_cases(spark):
    sound = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    noise = "".join(chr(97 + 7 * i * i % 26 + 0) if i % 5 else " " + chr(0x4E00 + i * 37 % 4000) for i in range(1500))
    odd = spark.createDataFrame(
        [(1001, None, "en"), (1002, "", None), (1003, noise, "en"), (1004, "a b c " * 50_000, "en"), (None, "x", "en")],
        "doc_id bigint, text string, lang string",
    )
    docs = sound.unionByName(odd).withColumn("base", F.lit(1)).withColumn("kept", F.lit(2))
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    assert len(got) == sound.count() + 5
    assert all(got[i].base_failed and not got[i].kept for i in (1001, 1002, 1004, None))
    assert not got[1003].base_failed and not got[1003].kept
    passed = [r for r in got.values() if not r.base_failed]
    assert sum(r.kept for r in passed) > 0.9 * len(passed)
    assert quality.quality_rules(docs.filter("false")).count() == 0
