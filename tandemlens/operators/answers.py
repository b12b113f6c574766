"""Answer quality: exact match and token F1 of normalised answers, and answers in either raw layout."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandemlens.functions.arrays import any_answer
from tandemlens.functions.frames import evaluated_once


def normalised(text: Column) -> Column:
    """Lower case, without punctuation and English articles, single blanks."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\p{Punct}+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\b(a|an|the)\b", " "), r"\s+", " "))


def exact_match(prediction: Column, gold: Column) -> Column:
    """1.0 if the normalised texts are equal."""
    return (normalised(prediction) == normalised(gold)).cast("double")


@F.arrow_udf(T.DoubleType())
def _f1_of_normalised(prediction: pa.Array, gold: pa.Array) -> pa.Array:
    """token_f1 of texts that are normalised already; the work is in proportion to their tokens."""

    def tokens(text: str) -> list[str]:
        found = text.split(" ")
        return [t for t in found if t] if "" in found else found

    def f1(one: str, other: str) -> float:
        if one == other:
            return 1.0
        a, b = tokens(one), tokens(other)
        own, theirs = Counter(a), Counter(b)
        shared = sum(min(own[t], theirs[t]) for t in own.keys() & theirs.keys())
        return 2.0 * shared / (len(a) + len(b))

    return pa.array([f1(x, y) for x, y in zip(prediction.to_pylist(), gold.to_pylist())], pa.float64())


def token_f1(prediction: Column, gold: Column) -> Column:
    """Harmonic mean of precision and recall over tokens, repeats included; 1 if both are empty."""
    return _f1_of_normalised(normalised(prediction), normalised(gold))


def with_scores(df: DataFrame, prediction: str, gold: str) -> DataFrame:
    """`df` with both scores as `exact_match` and `token_f1`; each text is normalised once."""
    own = {"_prediction": normalised(F.col(prediction)), "_gold": normalised(F.col(gold))}
    scored = evaluated_once(df, **own).withColumns(
        {
            "exact_match": (F.col("_prediction") == F.col("_gold")).cast("double"),
            "token_f1": _f1_of_normalised("_prediction", "_gold"),
        }
    )
    return scored.drop(*own)


def answer_texts(answers: Column) -> Column:
    """Texts of a raw JSON list whose elements are strings or objects with a `text`.

    Elements of another kind and nulls give an empty text, so positions stay.
    """
    parts = F.from_json(answers, "array<string>")

    def one(part: Column) -> Column:
        is_object = F.coalesce(F.ltrim(part).startswith("{"), F.lit(False))
        return F.coalesce(F.when(is_object, F.get_json_object(part, "$.text")).otherwise(part), F.lit(""))

    return F.transform(F.coalesce(parts, F.array().cast("array<string>")), one)


def has_answer(answers: Column) -> Column:
    """Whether a raw list holds an answer that is not blank."""
    return any_answer(answer_texts(answers))


def model_score(models: dict[str, Column], name: str) -> Column:
    """The score column of a model chosen by name."""
    if name not in models:
        raise ValueError(f"unknown model: {name!r}, expected one of {sorted(models)}")
    return models[name]
