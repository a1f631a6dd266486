"""Sums of outer products as a mergeable aggregate, and what follows from them: covariances, principal components, discriminants.

Each partition adds up its rows' outer products in numpy; Spark adds the partitions' sums, cell by cell. What reaches the
driver is one matrix a key, whose size depends on the dimensions alone. Rows are taken relative to a provisional mean, so
that the sums keep their digits.

Rows without a label or vector take no part. Vectors must have one length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specton.functions.shape import Pca
from specton.functions.vectors import doubles


@dataclass
class Scatter:
    """Counts and sums of each label and the outer products of all rows, relative to an origin."""

    labels: list[str]
    counts: np.ndarray
    sums: np.ndarray
    squares: np.ndarray
    origin: np.ndarray

    @property
    def n(self) -> int:
        return int(self.counts.sum())

    @property
    def mean(self) -> np.ndarray:
        return self.sums.sum(0) / self.n + self.origin

    @property
    def means(self) -> np.ndarray:
        return self.sums / self.counts[:, None] + self.origin

    @property
    def total(self) -> np.ndarray:
        """Outer products of rows less the mean of all."""
        s = self.sums.sum(0)
        return self.squares - np.outer(s, s) / self.n

    @property
    def within(self) -> np.ndarray:
        """Outer products of rows less their label's mean."""
        return self.squares - (self.sums / self.counts[:, None]).T @ self.sums

    def without(self, label: str, rows: np.ndarray) -> Scatter:
        """The same sums before these rows of a label came in."""
        x, at = rows - self.origin, self.labels.index(label)
        counts, sums = self.counts.copy(), self.sums.copy()
        counts[at] -= len(x)
        sums[at] -= x.sum(0)
        return replace(self, counts=counts, sums=sums, squares=self.squares - x.T @ x)

    def pca(self, components: int) -> Pca:
        return Pca.of_moments(self.n, self.mean, self.total, components)


def _known(rows: DataFrame, key: Column) -> DataFrame:
    return rows.select(key.alias("key"), F.col("label").cast("string").alias("label"), doubles("vector").alias("vector")).where("label IS NOT NULL AND vector IS NOT NULL")


def scatter(rows: DataFrame, key: str | None = None) -> dict[str | None, Scatter]:
    """The sums of each key's rows (label, vector, and key if named); without a key all rows are under None."""
    known = _known(rows, F.col(key).cast("string") if key else F.lit(None).cast("string"))

    def centre(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, np.zeros(0)
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["vector"])
                n, total = n + len(x), x.sum(0) + (total if n else 0)
        if n:
            yield pd.DataFrame({"cell": np.arange(-1, len(total)), "x": np.concatenate([[n], total])})

    by = known.mapInPandas(centre, "cell int, x double").groupBy("cell").agg(F.sum("x").alias("x")).orderBy("cell").toPandas()
    if not len(by):
        return {}
    origin = by["x"].to_numpy()[1:] / by["x"].iloc[0]
    d = len(origin)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for (k, label), at in pdf.groupby(["key", "label"], dropna=False).indices.items():
                x = np.stack(pdf["vector"].to_numpy()[at]) - origin
                k = None if k != k else k
                for name, part in (((k, label), np.concatenate([[len(x)], x.sum(0)])), ((k, None), (x.T @ x).ravel())):
                    sums[name] = sums.get(name, 0) + part
        for (k, label), x in sums.items():
            yield pd.DataFrame({"key": pd.Series([k] * len(x), dtype=object), "label": pd.Series([label] * len(x), dtype=object), "cell": np.arange(len(x), dtype=np.int32), "x": x})

    cells = known.mapInPandas(add, "key string, label string, cell int, x double").groupBy("key", "label", "cell").agg(F.sum("x").alias("x")).toPandas().sort_values("cell")
    out = {}
    for k, own in cells.groupby("key", dropna=False):
        named = {label: g["x"].to_numpy() for label, g in own.groupby("label")}
        labels = sorted(named)
        first = np.stack([named[label] for label in labels])
        out[None if k != k else k] = Scatter(labels, first[:, 0], first[:, 1:], own.loc[own["label"].isna(), "x"].to_numpy().reshape(d, d), origin)
    return out


def quartics(rows: DataFrame, spaces: dict[str | None, tuple[list[str], np.ndarray, np.ndarray]], key: str | None = None) -> dict[str | None, float]:
    """Of each key the sum of the fourth powers of its rows' lengths, less their label's mean, in a space: labels, their means and
    a basis. The one figure of a shrunk covariance that doesn't follow from the outer products."""
    known = _known(rows, F.col(key).cast("string") if key else F.lit(None).cast("string"))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str | None, float] = {}
        for pdf in batches:
            for k, at in pdf.groupby("key", dropna=False).indices.items():
                k = None if k != k else k
                labels, means, basis = spaces[k]
                own = np.searchsorted(labels, pdf["label"].to_numpy(object)[at].astype(str))
                z = (np.stack(pdf["vector"].to_numpy()[at]) - means[own]) @ basis
                total[k] = total.get(k, 0.0) + float(((z * z).sum(1) ** 2).sum())
        yield pd.DataFrame({"key": pd.Series(list(total), dtype=object), "x": pd.Series(list(total.values()), dtype=float)})

    got = known.mapInPandas(add, "key string, x double").groupBy("key").agg(F.sum("x").alias("x")).collect()
    return {r.key: r.x for r in got}


def covariance(rows: DataFrame) -> DataFrame:
    """i, j (from 0), total, within: the covariance of all rows, and that of rows less their label's mean over n less the labels."""
    s = scatter(rows)[None]
    d = len(s.origin)
    i, j = np.divmod(np.arange(d * d), d)
    pdf = pd.DataFrame({"i": i, "j": j, "total": (s.total / max(1, s.n - 1)).ravel(), "within": (s.within / max(1, s.n - len(s.labels))).ravel()})
    return rows.sparkSession.createDataFrame(pdf, "i int, j int, total double, within double")


def project(rows: DataFrame, pca: Pca) -> DataFrame:
    """The rows with pc, their principal components."""
    mean, basis = (F.lit(x.tolist()) for x in (pca.mean, pca.basis.T))
    centred = F.zip_with(doubles("vector"), mean, lambda x, m: x - m)
    dot = lambda w, z: F.aggregate(F.zip_with(w, z, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return rows.withColumn("_z", centred).withColumn("pc", F.transform(basis, lambda w: dot(w, F.col("_z")))).drop("_z")


def two_axes(rows: DataFrame, rounds: int = 60) -> np.ndarray:
    """Two directions for display: power iteration from a fixed start, the second kept at right angles to the first. A round over
    all rows is a product with their outer products, so the rows are read for the sums only."""
    s = scatter(rows.withColumn("label", F.lit("")))[None]
    axes: list[np.ndarray] = []
    for c in range(2):
        w = np.sin(np.arange(len(s.origin)) * 12.9898 + c * 78.233)
        for _ in range(rounds):
            w = s.total @ w
            for before in axes:
                w = w - before * (w @ before)
            w = w / (np.sqrt(w @ w) or 1)
        axes.append(w)
    return np.stack(axes, 1)


def plane(rows: DataFrame) -> DataFrame:
    """The rows with pc, two components for display; zeros for fewer than two rows."""
    few = rows.limit(2).count() < 2
    if few:
        return rows.withColumn("pc", F.array(F.lit(0.0), F.lit(0.0)))
    s = scatter(rows.withColumn("label", F.lit("")))[None]
    return project(rows, Pca(s.mean, two_axes(rows), np.zeros(2)))
