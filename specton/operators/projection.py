"""Projections of feature vectors: sparse winner-take-all tags, and dense random ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specton.functions.scalars import mulberry32

#: Cells, inputs of a cell, share of active cells.
CELLS, FAN_IN, ACTIVE = 2048, 6, 0.05
#: Rows projected at once, so that memory doesn't follow the batches.
AT_ONCE = 128


def sparse_projection(dims: int, cells: int = CELLS, fan_in: int = FAN_IN, seed: int = 1337) -> np.ndarray:
    """A row of fan_in different inputs for each cell. One stream draws them all, and the pool of inputs stays as the cell before
    has left it, so a seed means the same inputs everywhere."""
    if fan_in >= dims:
        raise ValueError("a cell needs fewer inputs than there are dimensions")
    draws, pool = mulberry32(seed), list(range(dims))
    out = np.empty((cells, fan_in), np.int64)
    for c in range(cells):
        for j in range(fan_in):
            r = j + int(next(draws) * (dims - j))
            pool[j], pool[r] = pool[r], pool[j]
        out[c] = pool[:fan_in]
    return out


def dense_projection(dims: int, cells: int = CELLS, seed: int = 1337) -> np.ndarray:
    """Normal weights in single precision, two from each pair of numbers of the stream."""
    draws = mulberry32(seed ^ 0x9E3779B9)
    u, v = np.array([next(draws) for _ in range(2 * (-(-cells * dims // 2)))]).reshape(-1, 2).T
    r = np.sqrt(-2 * np.log(np.maximum(1e-12, u)))
    return np.stack([r * np.cos(2 * np.pi * v), r * np.sin(2 * np.pi * v)], 1).ravel()[: cells * dims].reshape(cells, dims).astype(np.float32)


def winners(activity: np.ndarray, share: float = ACTIVE) -> np.ndarray:
    """Rows of 0 and 1 with the highest round(cells * share) in single precision, ties to the smaller cell; all zero for a zero row."""
    activity = activity.astype(np.float32)
    n, k = activity.shape[1], max(1, int(np.floor(activity.shape[1] * share + 0.5)))
    out = np.zeros(activity.shape, np.float32)
    order = np.argsort(-activity, axis=1, kind="stable")[:, :min(k, n)]
    np.put_along_axis(out, order, 1, 1)
    out[~activity.any(1)] = 0
    return out


def tags(rows: DataFrame, projection: np.ndarray, vector: str = "vector", share: float = ACTIVE) -> DataFrame:
    """The rows with tag, the indices of their active cells."""
    sparse = projection.dtype.kind == "i"

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            found: list[np.ndarray] = []
            for k in range(0, len(s), AT_ONCE):
                x = np.stack([np.asarray(v, float) for v in s.iloc[k : k + AT_ONCE]])
                a = x[:, projection].sum(2) if sparse else x @ projection.T
                found += [np.flatnonzero(t).astype(np.int32) for t in winners(a, share)]
            yield pd.Series(found)

    tag = F.pandas_udf(run, "array<int>")
    return rows.withColumn("tag", tag(F.col(vector).cast("array<double>")))


def embedder(mode: str, dims: int, **options):
    """A function of a vector for a mode: none, fly or dense. A graph serves whole tables: ``diffusion.reservoir``."""
    modes = {
        "none": lambda: lambda x: x / (np.sqrt((x * x).sum()) or 1),
        "fly": lambda: (lambda p: lambda x: winners(x[p].sum(1)[None])[0])(sparse_projection(dims, **options)),
        "dense": lambda: (lambda p: lambda x: winners((p @ x)[None])[0])(dense_projection(dims, **options)),
    }
    if mode not in modes:
        raise ValueError(f"no such mode: {mode}")
    return modes[mode]()
