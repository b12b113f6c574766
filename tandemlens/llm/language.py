"""Language identification by a byte convolutional network, trained in numpy.

Every text is cut into windows of fixed length. Filters of several widths run over the bytes,
each keeps its largest value in the window, and a softmax gives the languages; a document's
windows vote by their mean log-probability, weighted by length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemlens.llm.common import crc_fold
from tandemlens.llm.registry import query
from tandemlens.sources.tables import table

WINDOW = 256
WIDTHS = (2, 3, 4)
TAPS = max(WIDTHS)
EMBEDDING = 8
FILTERS = 16
#: Bounds of the training sample: documents a language (expected number), windows a document.
DOCUMENTS = 800
WINDOWS = 3
EPOCHS = 8
BATCH = 64
RATE = 0.004
UNKNOWN = "und"
#: Windows that are convolved at once.
CHUNK = 128

_LETTER = regex.compile(r"\p{L}")


def windows_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The whole text as rows of WINDOW bytes (zeros at the end), and the bytes of each row."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    rows = max(1, -(-len(data) // WINDOW))
    out = np.zeros(rows * WINDOW, np.uint8)
    out[: len(data)] = data
    sizes = np.full(rows, WINDOW)
    sizes[-1] = len(data) - WINDOW * (rows - 1)
    return out.reshape(rows, WINDOW), sizes


@dataclass
class ByteNetwork:
    languages: list[str]
    embedding: np.ndarray  # 256 x EMBEDDING
    filters: np.ndarray  # TAPS x EMBEDDING x all filters; taps beyond a filter's width are zero
    bias: np.ndarray
    dense: np.ndarray  # all filters x languages
    offset: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], rng: np.random.Generator) -> ByteNetwork:
        n = FILTERS * len(WIDTHS)
        net = cls(
            languages,
            rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32),
            rng.normal(0, 0.2, (TAPS, EMBEDDING, n)).astype(np.float32),
            np.zeros(n, np.float32),
            rng.normal(0, 0.2, (n, len(languages))).astype(np.float32),
            np.zeros(len(languages), np.float32),
        )
        net.filters *= net.mask()
        return net

    @staticmethod
    def mask() -> np.ndarray:
        used = np.zeros((TAPS, 1, FILTERS * len(WIDTHS)), np.float32)
        for i, width in enumerate(WIDTHS):
            used[:width, :, i * FILTERS : (i + 1) * FILTERS] = 1
        return used

    def pairs(self) -> list[np.ndarray]:
        """For taps (0, 1) and (2, 3): what each pair of bytes adds to every filter."""
        taps = np.einsum("be,ten->tbn", self.embedding, self.filters)
        return [(taps[t][:, None] + taps[t + 1][None]).reshape(65536, -1) for t in range(0, TAPS, 2)]

    def pooled(self, rows: np.ndarray, pairs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Largest value of each filter in each window, and where it is."""
        wide = np.zeros((len(rows), WINDOW + TAPS), np.int32)
        wide[:, :WINDOW] = rows
        keys = wide[:, :-1] * 256 + wide[:, 1:]
        at = sum(pairs[i][keys[:, 2 * i : 2 * i + WINDOW]] for i in range(TAPS // 2))
        where = at.argmax(axis=1)
        return np.take_along_axis(at, where[:, None], 1)[:, 0] + self.bias, where

    def log_probabilities(self, rows: np.ndarray, pairs: list[np.ndarray]) -> np.ndarray:
        out = []
        for i in range(0, len(rows), CHUNK):
            wide = np.zeros((len(part := rows[i : i + CHUNK]), WINDOW + TAPS), np.int32)
            wide[:, :WINDOW] = part
            keys = wide[:, :-1] * 256 + wide[:, 1:]
            at = pairs[0][keys[:, :WINDOW]]
            for t in range(1, TAPS // 2):
                at += pairs[t][keys[:, 2 * t : 2 * t + WINDOW]]
            out.append(self._logs(np.maximum(at.max(axis=1) + self.bias, 0)))
        return np.concatenate(out)

    def _logs(self, pooled: np.ndarray) -> np.ndarray:
        scores = pooled @ self.dense + self.offset
        scores -= scores.max(axis=1, keepdims=True)
        return scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))


def train(rows: np.ndarray, targets: np.ndarray, languages: list[str], seed: int = 7) -> ByteNetwork:
    """Adam on the cross-entropy of windows; some windows are shortened, as short texts are."""
    rng = np.random.default_rng(seed)
    net, mask = ByteNetwork.fresh(languages, rng), ByteNetwork.mask()
    names = ("embedding", "filters", "bias", "dense", "offset")
    first = {n: np.zeros_like(getattr(net, n)) for n in names}
    second = {n: np.zeros_like(getattr(net, n)) for n in names}
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(rows))
        for i in range(0, len(rows), BATCH):
            part = order[i : i + BATCH]
            x, y = rows[part].copy(), targets[part]
            for k in np.flatnonzero(rng.random(len(part)) < 0.3):
                x[k, rng.integers(6, WINDOW) :] = 0
            pooled, where = net.pooled(x, net.pairs())
            active = np.maximum(pooled, 0)
            slope = np.exp(net._logs(active))
            slope[np.arange(len(y)), y] -= 1
            slope /= len(y)
            back = (slope @ net.dense.T) * (pooled > 0)  # windows x filters
            wide = np.zeros((len(x), WINDOW + TAPS), np.uint8)
            wide[:, :WINDOW] = x
            grads = {"dense": active.T @ slope, "offset": slope.sum(0), "bias": back.sum(0)}
            grads["filters"], grads["embedding"] = np.zeros_like(net.filters), np.zeros_like(net.embedding)
            for t in range(TAPS):
                byte = np.take_along_axis(wide, where + t, 1)  # the byte under tap t where filter n peaked
                grads["filters"][t] = np.einsum("bne,bn->en", net.embedding[byte], back)
                np.add.at(grads["embedding"], byte, back[:, :, None] * net.filters[t].T[None])
            grads["filters"] *= mask
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for n in names:
                first[n] += 0.1 * (grads[n] - first[n])
                second[n] += 0.001 * (grads[n] ** 2 - second[n])
                size = np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8
                setattr(net, n, getattr(net, n) - rate * first[n] / (1 - 0.9**step) / size)
    return net


def training_windows(docs: DataFrame, documents: int, seed: int = 11) -> DataFrame:
    """(lang, window): windows spread over the whole of about `documents` texts of each language."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().toLocalIterator()}
    if not counts:
        return usable.select("lang", F.col("text").cast("binary").alias("window"))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, documents / n))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, out = [], []
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                if _LETTER.search(text):
                    rows, _ = windows_of(text)
                    for k in np.unique(np.linspace(0, len(rows) - 1, WINDOWS).astype(int)):
                        langs.append(lang)
                        out.append(rows[k].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], ["lang", "window"])

    return usable.filter(F.rand(seed) < share[F.col("lang")]).mapInArrow(cut, "lang string, window binary")


def fit(docs: DataFrame, documents: int = DOCUMENTS) -> ByteNetwork | None:
    """Network fitted to a bounded sample of `docs` (text, lang); None without a usable text."""
    sample = training_windows(docs, documents).toArrow()
    if not len(sample):
        return None
    languages = sorted(set(sample["lang"].to_pylist()))
    rows = np.frombuffer(b"".join(sample["window"].to_pylist()), np.uint8).reshape(-1, WINDOW)
    targets = np.array([languages.index(x) for x in sample["lang"].to_pylist()])
    return train(rows, targets, languages)


def predict(spark: SparkSession, text: Column, network: ByteNetwork | None) -> Column:
    """Struct (lang_pred, score) for whole texts.

    A text that is null or has no letter is `und` with score 0, as is every text if there was
    nothing to learn from. Long texts are taken in as many windows as they have.
    """
    model = spark.sparkContext.broadcast(network)
    tables: list[list[np.ndarray]] = []

    @F.arrow_udf("lang_pred string, score double")
    def languages(texts: pa.Array) -> pa.Array:
        net = model.value
        if net is not None and not tables:
            tables.append(net.pairs())
        names, scores = [], []
        for value in texts:
            one = value.as_py()
            if net is None or one is None or not _LETTER.search(one):
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            rows, sizes = windows_of(one)
            logs = np.average(net.log_probabilities(rows, tables[0]), axis=0, weights=sizes)
            chances = np.exp(logs - logs.max())
            best = int(chances.argmax())
            names.append(net.languages[best])
            scores.append(float(chances[best] / chances.sum()))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return languages(text)


@query()
def op9_language(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    held_out = crc_fold(F.col("doc_id"), 4) == 2
    network = fit(docs.filter(~held_out).select("text", "lang"))
    found = docs.select("doc_id", held_out.alias("held_out"), predict(spark, F.col("text"), network).alias("out"))
    return found.select("doc_id", "held_out", "out.lang_pred", "out.score")
