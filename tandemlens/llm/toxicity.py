"""Toxicity by weak supervision.

Many voters look at a text: words of a fixed lexicon, words and word stems mined from labelled rows,
patterns, and the human label itself. A generative model with a latent true label estimates how
often each voter fires on toxic and on clean texts and how voters correlate; correlated voters share
one voice. Its posterior labels train a linear classifier, which scores whole texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandemlens.llm.common import crc_fold, packed, unpacked
from tandemlens.llm.pretokens import Chunks
from tandemlens.llm.registry import query
from tandemlens.session import durable
from tandemlens.sources.tables import table

#: Bound of the labelled sample (expected number of rows) that the classifier is fitted to.
LABELLED = 20_000
#: Most mined words and stems; the strongest of them vote.
MINED = 1_500
MINED_VOTERS = 60
STEMS = (4, 5, 6, 7, 8)
LEAST_TOXIC = 3
LEAST_CHI2 = 15.0
GATHERED = 300_000
THRESHOLD = 0.7

# Insults in common use.
LEXICON = (
    "idiot moron stupid dumb loser trash scum clown pathetic worthless disgusting garbage filth vermin "
    "imbecile fool jerk bastard bitch whore slut asshole dickhead prick cunt fuck fucking shit bullshit "
    "crap retard retarded freak creep pig rat parasite coward liar hypocrite ugly fat disgrace degenerate "
    "subhuman savage thug psycho lunatic dimwit halfwit nitwit dunce buffoon twit wanker tosser"
).split()

_WORD = regex.compile(r"[^\W\d_]+")
_SECOND_PERSON = frozenset("you your yourself ye thou du dich dir tu te toi vous usted".split())


def patterns(text: str, chunks: set[str]) -> dict[str, bool]:
    """Pattern voters that look at the text rather than at single words."""
    upper = sum(1 for c in chunks if len(c) > 1 and c.isupper())
    return {
        "~exclaims": "!!" in text,
        "~asks": "??" in text,
        "~shouts": 2 * upper > len(chunks) > 0,
        "~addresses": any(c.lower() in _SECOND_PERSON for c in chunks),
        "~masks": bool(regex.search(r"\p{L}[*#@$]{2,}\p{L}", text)),
    }


def word_features(chunk: str) -> tuple[str, ...]:
    """Words of a chunk and their stems."""
    out = []
    for word in _WORD.findall(chunk.lower()):
        out.append(word)
        out.extend(word[:k] + "*" for k in STEMS if k < len(word))
    return tuple(out)


class Reader:
    """Features of a whole text; what a chunk gives is remembered. `known` restricts words and stems."""

    def __init__(self, known: dict[str, int] | None = None):
        keep = (lambda f: True) if known is None else known.__contains__
        self.chunks = Chunks(lambda chunk: tuple(filter(keep, word_features(chunk))), "features")

    def __call__(self, text: str) -> set[str]:
        self.chunks.trim()
        chunks, found = set(text.split()), set()
        for chunk in chunks:
            features = self.chunks[chunk]
            if features:
                found.update(features)
        found.update(name for name, fires in patterns(text, chunks).items() if fires)
        return found


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = LABELLED) -> DataFrame:
    """(text, toxic) of about `rows` labelled documents, all of them if there are fewer."""
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "toxic")
    total = usable.count()
    drawn = usable.filter(F.rand(5) < rows / total) if total > rows else usable
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return durable(texts.join(F.broadcast(drawn), "doc_id").select("text", "toxic"), "labelled")  # `rows` rows


def mine(sample: DataFrame, most: int = MINED) -> list[str]:
    """Words, stems and patterns that mark toxic rows, strongest first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, seen = Reader(), (Counter(), Counter())

        def out() -> pa.RecordBatch:
            names = list(seen[0].keys() | seen[1].keys())
            return pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *(pa.array([c[n] for n in names], pa.int64()) for c in seen)],
                ["feature", "clean", "toxic"],
            )

        for batch in batches:
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns)):
                seen[bool(toxic)].update(reader(text))
                if len(seen[0]) + len(seen[1]) > GATHERED:
                    yield out()
                    seen[0].clear(), seen[1].clear()
        yield out()

    totals = sample.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    t, n = float(totals["t"] or 0), float(totals["n"])
    if not 0 < t < n:
        return []
    a, b = F.col("toxic"), F.col("clean")
    chi2 = n * F.pow(a * (n - t) - b * t, 2) / (t * (n - t) * (a + b) * F.greatest(n - a - b, F.lit(1.0)))
    found = (
        sample.select("text", "toxic")
        .mapInArrow(count, "feature string, clean bigint, toxic bigint")
        .groupBy("feature")
        .agg(F.sum("clean").cast("double").alias("clean"), F.sum("toxic").cast("double").alias("toxic"))
        .filter((a >= LEAST_TOXIC) & (a * (n - t) > 3 * b * t))
        .withColumn("chi2", chi2)
        .filter(F.col("chi2") > LEAST_CHI2)
        .orderBy(F.desc("chi2"), "feature")
        .limit(most)
    )
    return [r["feature"] for r in found.select("feature").toLocalIterator()]


def design(sample: DataFrame, features: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the sample by features (0 or 1), and their labels."""
    index = {f: i for i, f in enumerate(features)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(index)
        for batch in batches:
            found = [
                sorted(index[f] for f in reader(text) if f in index) for text in batch.column(0).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(1)], ["at", "toxic"])

    kind = dict(sample.dtypes)["toxic"]
    got = sample.select("text", "toxic").mapInArrow(rows, f"at array<int>, toxic {kind}").toArrow()
    x = np.zeros((len(got), len(features)), np.float32)
    for i, at in enumerate(got["at"].to_pylist()):
        x[i, at] = 1
    return x, got["toxic"].to_numpy().astype(np.float64)


def posterior(votes: np.ndarray, labels: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Chance that each row is toxic, by expectation maximisation over voters and the human label.

    A voter fires with one rate on toxic and another on clean rows. The weight of its voice is one
    over the sum of its correlations (given the label) with the others, itself included.
    """
    all_votes = np.column_stack([votes, labels])
    q = 0.05 + 0.9 * labels
    for _ in range(rounds):
        prior = (q.sum() + 1) / (len(q) + 2)
        rates = [
            (w @ all_votes + 0.1) / (w.sum() + 0.2 / max(base, 1e-3)) for w, base in ((q, 0.5), (1 - q, 0.05))
        ]
        rates = [np.clip(r, 1e-4, 1 - 1e-4) for r in rates]
        rest = all_votes - q[:, None] * rates[0] - (1 - q)[:, None] * rates[1]
        spread = np.sqrt((rest**2).mean(0)) + 1e-6
        correlation = np.abs(rest.T @ rest / len(rest) / spread[:, None] / spread[None])
        np.fill_diagonal(correlation, 1)
        weight = 1 / np.where(correlation > 0.1, correlation, 0).sum(1)
        weight[-1] = 1  # the human label is no copy of a word
        fires, silent = np.log(rates[0] / rates[1]), np.log((1 - rates[0]) / (1 - rates[1]))
        odds = np.log(prior / (1 - prior)) + all_votes @ (weight * fires) + (1 - all_votes) @ (weight * silent)
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - q).max() < 1e-4:
            break
        q = new
    return q


def fit_linear(x: np.ndarray, q: np.ndarray, steps: int = 800, ridge: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels (Adam, full batch)."""
    w, b = np.zeros(x.shape[1], np.float32), float(np.log((q.mean() + 1e-3) / (1 - q.mean() + 1e-3)))
    first, second = np.zeros(len(w) + 1, np.float32), np.zeros(len(w) + 1, np.float32)
    target = q.astype(np.float32)
    for step in range(1, steps + 1):
        slope = (1 / (1 + np.exp(-(x @ w + b))) - target) / len(target)
        grad = np.append(x.T @ slope + ridge * w, slope.sum()).astype(np.float32)
        first += 0.1 * (grad - first)
        second += 0.001 * (grad**2 - second)
        move = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w -= move[:-1]
        b -= float(move[-1])
    return w, b


def fit(docs: DataFrame, labels: DataFrame, rows: int = LABELLED) -> tuple[dict[str, float], float]:
    """Weights by feature and bias, fitted to a bounded sample of labelled documents."""
    sample = labelled_sample(docs, labels, rows)
    mined = mine(sample)
    features = list(dict.fromkeys([*mined, *LEXICON, *patterns("", set())]))
    x, y = design(sample, features)
    if not len(y) or y.min() == y.max():  # nothing to learn from: the lexicon alone
        return dict.fromkeys(LEXICON, 4.0), -3.0
    voters = [i for i, f in enumerate(features) if i < MINED_VOTERS or f in LEXICON or f[0] == "~"]
    voters = [i for i in voters if x[:, i].any()]
    w, b = fit_linear(x, posterior(x[:, voters].astype(np.float64), y))
    return {f: float(v) for f, v in zip(features, w) if abs(v) > 1e-3}, b


@lru_cache(maxsize=1)
def reader_of(held) -> Reader:
    """One for all tasks of a worker that score with the same broadcast."""
    return Reader(held.value[0])


def score(spark: SparkSession, text: Column, model: tuple[dict[str, float], float]) -> Column:
    """Score from 0 to 1 of whole texts; a null text scores as an empty one, on the bias alone."""
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def toxicity(texts: pa.Array) -> pa.Array:
        weights, bias = held.value
        reader = reader_of(held)
        odds = [bias + sum(weights[f] for f in reader(t.as_py() or "") if f in weights) for t in texts]
        return pa.array(1 / (1 + np.exp(-np.clip(np.array(odds, np.float64), -50, 50))))

    return toxicity(text)


def held_out(doc_id: Column) -> Column:
    return crc_fold(doc_id, 3) == 1


def fit_on_folds(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], float]:
    """The classifier from the rows whose labels may be learnt from."""
    return fit(docs, labels.filter(~held_out(F.col("doc_id"))))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below `threshold`, all columns as they are."""
    model = fit_on_folds(docs, labels)
    scored = packed(docs, score=score(docs.sparkSession, F.col("text"), model))
    return unpacked(scored.filter(F.col("score") < threshold), docs.columns)


@query()
def op4_toxicity(spark: SparkSession, root: str) -> DataFrame:
    """Repeated rows and rows without an id are scored each by itself; an empty table gives no row."""
    docs, labels = table(spark, root, "documents"), table(spark, root, "labels")
    model = fit_on_folds(docs, labels)
    scored = docs.select("doc_id", score(spark, F.col("text"), model).alias("score"))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
