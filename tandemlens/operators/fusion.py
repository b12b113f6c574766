"""Fusion of two vectors per row. Spark moves the rows, numpy does a batch at a time.

The weights are a fixed-size model (its size depends on the hidden width, never
on the data) and travel with the task.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VECTOR = "array<double>"
NORM_EPS = 1e-5  # fixed value: layer-norm epsilon
GATE_EPS = 1e-8  # fixed value: keeps the gate sum positive
TEMPERATURE = 0.1  # fixed value: contrastive temperature
CELLS = 1 << 24  # numbers held at once by the bilinear step (128 MB)


class Layer(NamedTuple):
    w: np.ndarray  # [out, in]
    b: np.ndarray  # [out]


Weights = dict[str, Layer]
Shapes = dict[str, tuple[int, int]]


def shapes(kind: str, hidden: int, fused: int = 8) -> Shapes:
    """(out, in) of every layer of a fusion kind."""
    h = hidden
    if kind == "cross_attention":
        one = {"value": (h, h), "out": (h, h), "ffn1": (2 * h, h), "ffn2": (h, 2 * h)}
        return {f"{side}_{n}": s for side in ("kg", "dense") for n, s in one.items()}
    if kind == "hierarchical_gating":
        gates = {f"{s}_gate1": (h, 2 * h) for s in ("kg", "dense")}
        gates |= {f"{s}_gate2": (1, h) for s in ("kg", "dense")}
        return gates | {"fuse1": (h, 2 * h), "fuse2": (h, h)}
    if kind == "tensor_bilinear":
        return {
            "bilinear": (fused, h * h),
            "kg_proj": (fused, h),
            "dense_proj": (fused, h),
            "fuse1": (h, 3 * fused),
            "fuse2": (h, h),
        }
    if kind == "contrastive":
        projectors = {f"{s}_proj1": (h, h) for s in ("kg", "dense")}
        projectors |= {f"{s}_proj2": (h // 2, h) for s in ("kg", "dense")}
        return projectors | {"align": (h, 2 * h), "fuse1": (h, h), "fuse2": (h, h)}
    if kind == "graph_layer":
        return {"linear": (h, h)}
    if kind == "qa_head":
        return {"head1": (h, h), "head2": (1, h)}
    if kind == "ir_head":
        return {"head1": (h, 2 * h), "head2": (1, h)}
    raise ValueError(f"unsupported fusion kind: {kind}")


def pattern_weights(kind: str, hidden: int, fused: int = 8) -> Weights:
    """Small repeatable weights from a fixed integer pattern, layer by layer."""
    weights = {}
    for seed, (name, (out, size)) in enumerate(shapes(kind, hidden, fused).items()):
        i, j = np.arange(out)[:, None], np.arange(size)[None, :]
        w = ((i * 37 + j * 17 + seed * 11) % 101 - 50) / 250.0
        b = ((np.arange(out) * 13 + seed * 7) % 11 - 5) / 50.0
        weights[name] = Layer(w, b)
    return weights


def n_parameters(kind: str, hidden: int, fused: int = 8) -> int:
    return sum(out * (size + 1) for out, size in shapes(kind, hidden, fused).values())


def _linear(x: np.ndarray, layer: Layer) -> np.ndarray:
    return x @ layer.w.T + layer.b


def _mlp(x: np.ndarray, first: Layer, second: Layer) -> np.ndarray:
    return _linear(np.maximum(_linear(x, first), 0.0), second)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def _layer_norm(x: np.ndarray) -> np.ndarray:
    centred = x - x.mean(axis=1, keepdims=True)
    return centred / np.sqrt((centred**2).mean(axis=1, keepdims=True) + NORM_EPS)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def cross_attention(kg: np.ndarray, dense: np.ndarray, p: Weights) -> np.ndarray:
    """Each side attends to the other; with one token per side the attention weight is 1,
    so attending is the value map followed by the output map."""
    sides = []
    for side, own, other in (("kg", kg, dense), ("dense", dense, kg)):
        attended = _linear(_linear(other, p[f"{side}_value"]), p[f"{side}_out"])
        x = _layer_norm(attended + own)
        sides.append(_layer_norm(x + _mlp(x, p[f"{side}_ffn1"], p[f"{side}_ffn2"])))
    return (sides[0] + sides[1]) / 2


def hierarchical_gating(kg: np.ndarray, dense: np.ndarray, p: Weights) -> np.ndarray:
    both = np.hstack([kg, dense])
    a = _sigmoid(_mlp(both, p["kg_gate1"], p["kg_gate2"]))
    b = _sigmoid(_mlp(both, p["dense_gate1"], p["dense_gate2"]))
    total = a + b + GATE_EPS
    return _mlp(np.hstack([a / total * kg, b / total * dense]), p["fuse1"], p["fuse2"])


def _bilinear(kg: np.ndarray, dense: np.ndarray, layer: Layer, cells: int = CELLS) -> np.ndarray:
    """kg * tensor * dense per row, a few rows at a time: the step in between holds
    rows x outputs x width numbers."""
    n, h = kg.shape
    tensor = layer.w.reshape(-1, h, h)
    step = max(1, cells // (tensor.shape[0] * h))
    out = np.empty((n, tensor.shape[0]))
    for at in range(0, n, step):
        left = np.einsum("ni,kij->nkj", kg[at : at + step], tensor, optimize=True)
        out[at : at + step] = np.einsum("nkj,nj->nk", left, dense[at : at + step])
    return out + layer.b


def tensor_bilinear(kg: np.ndarray, dense: np.ndarray, p: Weights) -> np.ndarray:
    parts = [_bilinear(kg, dense, p["bilinear"]), _linear(kg, p["kg_proj"]), _linear(dense, p["dense_proj"])]
    return _layer_norm(_mlp(np.hstack(parts), p["fuse1"], p["fuse2"]))


def _projected(x: np.ndarray, side: str, p: Weights) -> np.ndarray:
    return _unit(_mlp(x, p[f"{side}_proj1"], p[f"{side}_proj2"]))


def contrastive(kg: np.ndarray, dense: np.ndarray, p: Weights) -> np.ndarray:
    agreement = (_projected(kg, "kg", p) * _projected(dense, "dense", p)).sum(1, keepdims=True)
    w = _sigmoid(agreement)
    aligned = np.maximum(_linear(np.hstack([w * kg, (1 - w) * dense]), p["align"]), 0.0)
    return _layer_norm(_mlp(aligned, p["fuse1"], p["fuse2"]))


KINDS: dict[str, Callable] = {
    "cross_attention": cross_attention,
    "hierarchical_gating": hierarchical_gating,
    "tensor_bilinear": tensor_bilinear,
    "contrastive": contrastive,
}


#: Rows that are fused at once: what a worker holds in between does not grow with the Arrow batch.
ROWS = 512
#: Weights beyond this are refused: every Python worker holds them.
MOST_BYTES = 1 << 30


def _held(weights: Weights):
    """The weights, sent to each executor once and not with every task."""
    size = sum(layer.w.nbytes + layer.b.nbytes for layer in weights.values())
    if size > MOST_BYTES:
        raise ValueError(f"{size} bytes of weights, {MOST_BYTES} at most")
    return SparkSession.active().sparkContext.broadcast(weights)


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """Vectors of one length as rows, without a copy."""
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def fused(kind: str, weights: Weights) -> Callable[[Column, Column], Column]:
    """Column function (kg, dense) -> fused vector. No row becomes a Python object."""
    combine, held = KINDS[kind], _held(weights)

    @F.arrow_udf(VECTOR)
    def apply(kg: pa.Array, dense: pa.Array) -> pa.Array:
        if not len(kg):
            return pa.array([], pa.list_(pa.float64()))
        if kg.null_count or dense.null_count:
            raise ValueError("a vector is missing")
        left, right, out = _matrix(kg), _matrix(dense), None
        for at in range(0, len(left), ROWS):
            part = combine(left[at : at + ROWS], right[at : at + ROWS], held.value)
            out = np.empty((len(left), part.shape[1])) if out is None else out
            out[at : at + ROWS] = part
        offsets = pa.array(np.arange(0, out.size + 1, out.shape[1]), pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(out.reshape(-1)))

    return apply


def task_head(task: str, weights: Weights) -> Callable[[Column], Column]:
    """Column function fused vector -> logit. Retrieval doubles the vector when it stands
    for the query and the passage alike."""
    held = _held(weights)

    @F.pandas_udf("double")
    def apply(vector: pd.Series) -> pd.Series:
        if not len(vector):
            return pd.Series([], dtype="float64")
        x = np.vstack(vector)
        x = np.hstack([x, x]) if task == "ir" else x
        return pd.Series(_mlp(x, held.value["head1"], held.value["head2"])[:, 0])

    return apply


def graph_layer(layer: Layer) -> Callable[[Column, Column], Column]:
    """Column function (messages, own vector) -> layer output: linear map, ReLU, residual and
    layer norm. Dropout is off outside training."""

    @F.pandas_udf(VECTOR)
    def apply(h: pd.Series, x: pd.Series) -> pd.Series:
        if not len(h):
            return pd.Series([], dtype=object)
        out = np.maximum(_linear(np.vstack(h), layer), 0.0) + np.vstack(x)
        return pd.Series(list(_layer_norm(out)))

    return apply


def project(layer: Layer) -> Callable[[Column], Column]:
    """Column function x -> linear map of x."""

    @F.pandas_udf(VECTOR)
    def apply(x: pd.Series) -> pd.Series:
        return pd.Series(list(_linear(np.vstack(x), layer)) if len(x) else [], dtype=object)

    return apply


def info_nce(df: DataFrame, weights: Weights, batch: str = "batch") -> DataFrame:
    """(batch, loss): symmetric contrastive loss inside each batch of (batch, kg, dense).

    The similarity matrix is batch size squared, so the caller's batches are small
    and of a fixed size. A task call takes 64 neighbouring batches at a time.
    """

    def one_way(sim: np.ndarray) -> float:
        top = sim.max(axis=1, keepdims=True)
        spread = np.log(np.exp(sim - top).sum(axis=1)) + top[:, 0]
        return float((spread - np.diag(sim)).mean())

    def losses(pdf: pd.DataFrame) -> pd.DataFrame:
        kg = _projected(np.vstack(pdf["kg"]), "kg", weights)
        dense = _projected(np.vstack(pdf["dense"]), "dense", weights)
        rows = []
        for name, at in pdf.groupby(batch).indices.items():
            sim = kg[at] @ dense[at].T / TEMPERATURE
            rows.append((name, (one_way(sim) + one_way(sim.T)) / 2))
        return pd.DataFrame(rows, columns=[batch, "loss"])

    neighbours = F.floor(F.col(batch) / 64).alias("neighbours")
    return df.groupBy(neighbours).applyInPandas(losses, f"{batch} long, loss double")
