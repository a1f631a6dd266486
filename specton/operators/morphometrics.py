"""Procrustes means of landmark shapes as DataFrame operators: of many rows under a few keys, and of many small groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specton.functions import shape
from specton.functions.vectors import doubles
from specton.operators.lineage import cut

ROUNDS, TOLERANCE = 20, 1e-10


def points(v: list | np.ndarray) -> np.ndarray:
    """Rows of x, y, x, y, ... as rows of points, centred and of unit size."""
    p = np.stack(v).reshape(len(v), -1, 2)
    p = p - p.mean(1, keepdims=True)
    size = np.sqrt((p * p).sum((1, 2), keepdims=True))
    if not (np.isfinite(size) & (size > 0)).all():
        raise ValueError("points have no size")
    return p / size


def turned(p: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Each shape turned, never reflected, onto its mean."""
    angle = np.arctan2((p[:, :, 0] * m[:, :, 1] - p[:, :, 1] * m[:, :, 0]).sum(1), (p * m).sum((1, 2)))
    c, s = np.cos(angle)[:, None], np.sin(angle)[:, None]
    return np.stack([c * p[:, :, 0] - s * p[:, :, 1], s * p[:, :, 0] + c * p[:, :, 1]], 2)


def means(rows: DataFrame, key: str, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> dict[str, np.ndarray]:
    """The Procrustes mean of all rows of each key, starting from the smallest id. A round turns every row onto its key's mean and
    sums by key and coordinate; a key is done once its mean moves by less than the tolerance. rows: id, key, v (x, y, x, y,
    ...). Keys have to be few: their means are on the driver and with every task."""
    own = rows.select("id", F.col(key).cast("string").alias("key"), doubles("v").alias("v"))
    out = {r.key: points([r.v])[0] for r in own.groupBy("key").agg(F.min_by("v", "id").alias("v")).collect()}
    turning = set(out)
    for _ in range(rounds):
        now = {k: out[k] for k in turning}

        def total(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            sums: dict[str, np.ndarray] = {}
            for pdf in batches:
                for k, at in pdf.groupby("key").indices.items():
                    if k in now:
                        p = points(pdf["v"].to_numpy()[at])
                        sums[k] = sums.get(k, 0) + turned(p, np.broadcast_to(now[k], p.shape)).sum(0).ravel()
            for k, x in sums.items():
                yield pd.DataFrame({"key": k, "dim": range(len(x)), "x": x})

        by = own.mapInPandas(total, "key string, dim int, x double").groupBy("key", "dim").agg(F.sum("x").alias("x")).toPandas()
        for k, pdf in by.groupby("key"):
            mean = shape.centre_and_scale(pdf.sort_values("dim")["x"].to_numpy().reshape(-1, 2))
            if np.sqrt(((mean - now[k]) ** 2).sum()) < tolerance:
                turning.discard(k)
            out[k] = shape.rotate_onto(mean, now[k])
        if not turning:
            break
    return out


def _mean(rows: DataFrame) -> DataFrame:
    """group, m: the elementwise mean of v."""
    by = rows.select("group", F.posexplode("v").alias("dim", "x")).groupBy("group", "dim").agg(F.avg("x").alias("x"))
    return by.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("m"))


def group_means(rows: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """group, m: the Procrustes mean of each group, for any number of groups and rows in one. rows: id, group, v."""

    def unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"id": pdf["id"], "group": pdf["group"], "v": list(points(pdf["v"]).reshape(len(pdf), -1))})

    def onto(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"group": pdf["group"], "v": list(turned(points(pdf["v"]), points(pdf["m"])).reshape(len(pdf), -1))})

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                new, old = points(pdf["m"]), points(pdf["old"])
                moved = np.sqrt(((new - old) ** 2).sum((1, 2)))
                yield pd.DataFrame({"group": pdf["group"], "m": list(turned(new, old).reshape(len(pdf), -1)), "moved": moved})

    own = cut(rows.select("id", F.col("group").cast("string").alias("group"), doubles("v").alias("v")).mapInPandas(unit, "id long, `group` string, v array<double>"))
    first = own.groupBy("group").agg(F.min_by("v", "id").alias("m"), F.count("*").alias("n"))
    now = cut(first.select("group", "m", F.when(F.col("n") > 1, 1.0).otherwise(0.0).alias("moved")))
    for _ in range(rounds):
        open_ = now.where(F.col("moved") >= tolerance).select("group", "m")
        if not open_.limit(1).count():
            break
        at = own.join(open_, "group").select("group", "v", "m").mapInPandas(onto, "`group` string, v array<double>")
        new = _mean(at).join(open_.withColumnRenamed("m", "old"), "group").mapInPandas(settle, "`group` string, m array<double>, moved double")
        now = cut(now.where(F.col("moved") < tolerance).unionByName(new))
    return now.select("group", "m")
