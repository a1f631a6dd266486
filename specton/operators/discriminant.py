"""Linear discriminants on principal components, fitted from sums over all rows, with calibrated probabilities.

A fit reads the rows for their sums of outer products and for one figure of the shrinkage. Calibration leaves out each group in turn:
its rows are taken off the sums instead of adding up all others again, and so is the shrinkage's figure, which is a form in the
moments of fourth order. With many dimensions or labels these are too many to keep, and the figure comes from pairs of blocks, groups
left out against rows. Leaving out needs no pass a group over the driver, and no task sees more than a block of each side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specton.functions.shape import Lda, Pca, ShapeLda, components_for
from specton.functions.vectors import doubles
from specton.operators.lineage import cut
from specton.operators.scatter import Scatter, quartics, scatter

#: Rows of a block, groups left out at once, temperatures tried in a pass over the scores, and passes.
ROWS, GROUPS, TRIES, PASSES = 16384, 256, 65, 6
#: Numbers of moments that are kept, and rows multiplied at once.
MOMENTS, STEP = 1 << 23, 1024
#: Fewer scored rows don't set a temperature.
LEAST = 4


def _space(s: Scatter, components: int | str) -> Pca:
    d = len(s.origin)
    return s.pca(components_for(d, s.n, len(s.labels)) if components == "auto" else components)


def _lda(s: Scatter, pca: Pca, quartic: float, shrinkage: float | str) -> Lda:
    return Lda.of_moments(s.labels, s.n, (s.means - pca.mean) @ pca.basis, pca.basis.T @ s.within @ pca.basis, quartic, shrinkage)


def fit(rows: DataFrame, key: str | None = None, components: int | str = "auto", shrinkage: float | str = "auto") -> dict[str | None, ShapeLda]:
    """A model for each key. rows: label, vector, and key if named. Keys with one label, or without variation, have none."""
    sums = {k: s for k, s in scatter(rows, key).items() if len(s.labels) > 1}
    spaces = {k: _space(s, components) for k, s in sums.items()}
    own = rows if key is None else rows.where(F.col(key).cast("string").isin([k for k in sums if k is not None]))
    fourth = quartics(own, {k: (s.labels, s.means, spaces[k].basis) for k, s in sums.items()}, key) if sums and shrinkage == "auto" else {}
    out = {}
    for k, s in sums.items():
        try:
            out[k] = ShapeLda(spaces[k], _lda(s, spaces[k], fourth.get(k, 0.0), shrinkage))
        except ValueError:
            continue
    return out


def probabilities(rows: DataFrame, models: dict[str | None, ShapeLda], key: str | None = None) -> DataFrame:
    """id, key (null without one), label, p: a row for each label of the row's model; rows without a model have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, at in pdf.groupby("key", dropna=False).indices.items():
                m = models.get(None if k != k else k)
                if m is not None:
                    p = m.probabilities(np.stack(pdf["vector"].to_numpy()[at]))
                    n = len(m.lda.labels)
                    yield pd.DataFrame({"id": np.repeat(pdf["id"].to_numpy()[at], n), "key": np.repeat(pdf["key"].to_numpy(object)[at], n), "label": m.lda.labels * len(at), "p": p.ravel()})

    own = rows.select(F.col("id").cast("long").alias("id"), (F.col(key).cast("string") if key else F.lit(None).cast("string")).alias("key"), doubles("vector").alias("vector"))
    return own.where("vector IS NOT NULL").mapInPandas(run, "id long, key string, label string, p double")


def predicted(p: DataFrame) -> DataFrame:
    """id, key, predicted, top: the likeliest label, ties to the smallest."""
    best = F.min(F.struct((-F.col("p")).alias("p"), F.col("label").alias("label")))
    return p.groupBy("id", "key").agg(best.alias("b")).select("id", "key", F.col("b.label").alias("predicted"), (-F.col("b.p")).alias("top"))


def _reduced(s: Scatter, label: str, x: np.ndarray, components: int | str) -> tuple[Scatter, Pca] | None:
    """The sums without a group's rows, and their space; none if the label has no other group."""
    if s.counts[s.labels.index(label)] <= len(x) or len(s.labels) < 2:
        return None
    less = s.without(label, x)
    return less, _space(less, components)


def left_out_scores(rows: DataFrame, components: int | str = "auto", shrinkage: float | str = "auto") -> DataFrame:
    """id, label, scores: each row's discriminant scores (in order of labels) by the fit of all other groups' rows; null where a
    label would be left without rows. rows: id, group, label, vector."""
    own = rows.select(F.col("id").cast("long").alias("id"), F.col("group").cast("string").alias("group"), F.col("label").cast("string").alias("label"), doubles("vector").alias("vector")).where("label IS NOT NULL AND vector IS NOT NULL")
    own = cut(own)
    sums = scatter(own).get(None)
    schema = "id long, label string, scores array<double>"
    if sums is None:
        return rows.sparkSession.createDataFrame([], schema)
    if shrinkage == "auto" and _moments_size(len(sums.labels), len(sums.origin)) > MOMENTS:
        own = _with_quartics(own, sums, components)
        fourth = None
    else:
        own = own.withColumn("quartic", F.lit(0.0))
        fourth = _moments(own, sums) if shrinkage == "auto" else None

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        scores: list = [None] * len(pdf)
        fits = []
        vectors, labels, quartics_ = np.stack(pdf["vector"]), pdf["label"].to_numpy(object), pdf["quartic"].to_numpy(float)
        for at in pdf.groupby("group").indices.values():
            if fitted := _reduced(sums, labels[at[0]], vectors[at], components):
                fits.append((at, *fitted))
        quartic = fourth.left_out([(labels[at[0]], vectors[at], less, pca) for at, less, pca in fits]) if fourth else [quartics_[at[0]] for at, _, _ in fits]
        for (at, less, pca), q in zip(fits, quartic, strict=True):
            try:
                for i, x in zip(at, _lda(less, pca, float(q), shrinkage).scores(pca.transform(vectors[at])), strict=True):
                    scores[i] = x
            except ValueError:
                pass
        return pd.DataFrame({"id": pdf["id"], "label": pdf["label"], "scores": scores})

    return own.withColumn("a", F.pmod(F.xxhash64("group"), F.lit(max(1, -(-sums.n // GROUPS)))).cast("int")).groupBy("a").applyInPandas(score, schema)


def _moments_size(labels: int, d: int) -> int:
    pairs = d * (d + 1) // 2
    return pairs * pairs + labels * pairs * (d + 1)


@dataclass
class Moments:
    """Sums over rows y, each less its label's mean: of products of four components, and by label of three and two. What the
    shrinkage asks of the rows in any space of components is a form in these, and a shift of a label's mean too."""

    sums: Scatter
    four: np.ndarray  # pair, pair
    three: np.ndarray  # label, pair, component
    two: np.ndarray  # label, pair

    def left_out(self, fits: list[tuple[str, np.ndarray, Scatter, Pca]]) -> list[float]:
        """The sum of squared squared lengths in each fit's space, over all rows but those left out: label, rows left out, sums, space."""
        if not fits:
            return []
        i, j = np.triu_indices(len(self.sums.origin))
        form = [pca.basis @ pca.basis.T for _, _, _, pca in fits]
        packed = np.stack([f[i, j] for f in form]) * np.where(i == j, 1.0, 2.0)
        total = np.einsum("gp,gp->g", packed @ self.four, packed)
        out = []
        for (label, x, less, pca), f, a, q in zip(fits, form, packed, total, strict=True):
            k = self.sums.labels.index(label)
            shift = less.means[k] - self.sums.means[k]
            c = f @ shift
            e = float(shift @ c)
            two = np.zeros_like(f)
            two[i, j] = two[j, i] = self.two[k]
            moved = 4 * c @ two @ c + self.sums.counts[k] * e * e - 4 * a @ self.three[k] @ c + 2 * e * (a @ self.two[k])
            z = (x - less.means[k]) @ pca.basis
            out.append(q + moved - float(((z * z).sum(1) ** 2).sum()))
        return out


def _moments(rows: DataFrame, sums: Scatter) -> Moments:
    """One pass over the rows: label, vector, id. What a task makes, and what the driver holds, depends on dimensions and labels only."""
    d, n = len(sums.origin), len(sums.labels)
    i, j = np.triu_indices(d)
    pairs = len(i)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        four, three, two = np.zeros((pairs, pairs)), np.zeros((n, pairs, d)), np.zeros((n, pairs))
        some = False
        for pdf in batches:
            for k in range(0, len(pdf), STEP):
                part = pdf.iloc[k : k + STEP]
                at = np.searchsorted(sums.labels, part["label"].to_numpy(object).astype(str))
                y = np.stack(part["vector"]) - sums.means[at]
                products = y[:, i] * y[:, j]
                four += products.T @ products
                for label in np.unique(at):
                    three[label] += products[at == label].T @ y[at == label]
                    two[label] += products[at == label].sum(0)
                some = True
        if some:
            for k in range(pairs):
                yield pd.DataFrame({"i": [k], "x": [four[k].tobytes()]})
            for k in range(n):
                yield pd.DataFrame({"i": [pairs + k], "x": [np.concatenate([three[k].ravel(), two[k]]).tobytes()]})

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": pdf["i"].iloc[:1], "x": [sum(np.frombuffer(x, float) for x in pdf["x"]).tobytes()]})

    own = rows.select("label", "vector", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-sums.n // ROWS)))).alias("b")).repartition(max(1, -(-sums.n // ROWS)), "b").drop("b")
    four, three, two = np.zeros((pairs, pairs)), np.zeros((n, pairs, d)), np.zeros((n, pairs))
    for r in own.mapInPandas(add, "i int, x binary").groupBy("i").applyInPandas(together, "i int, x binary").collect():
        x = np.frombuffer(r.x, float)
        if r.i < pairs:
            four[r.i] = x
        else:
            three[r.i - pairs], two[r.i - pairs] = x[: pairs * d].reshape(pairs, d), x[pairs * d :]
    return Moments(sums, four, three, two)


def _with_quartics(own: DataFrame, sums: Scatter, components: int | str) -> DataFrame:
    """The rows with their group's quartic, the same figure from pairs of blocks, for more dimensions or labels than moments are kept of."""
    n = sums.n
    blocks, batches = max(1, -(-n // ROWS)), max(1, -(-n // GROUPS))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    out = own.withColumn("a", F.pmod(F.xxhash64("group"), F.lit(batches)).cast("int")).withColumn("b", every(blocks))
    seen = own.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("a", every(batches))

    def part(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[str, float]] = []
        if len(left) and len(right):
            x, labels, groups = np.stack(right["vector"]), right["label"].to_numpy(object), right["group"].to_numpy(object)
            at = np.searchsorted(sums.labels, labels.astype(str))
            for group, g in left.groupby("group"):
                label = g["label"].iloc[0]
                if fitted := _reduced(sums, label, np.stack(g["vector"]), components):
                    less, pca = fitted
                    z = (x - less.means[at]) @ pca.basis
                    found.append((group, float((((z * z).sum(1) ** 2)[groups != group]).sum())))
        return pd.DataFrame(found, columns=["group", "quartic"]).astype({"group": object, "quartic": float})

    pairs = out.groupBy("a", "b").cogroup(seen.groupBy("a", "b")).applyInPandas(part, "`group` string, quartic double")
    return own.join(pairs.groupBy("group").agg(F.sum("quartic").alias("quartic")), "group", "left")


@dataclass
class Temperature:
    value: float | None
    scored: int


def fit_temperature(scores: DataFrame, labels: list[str]) -> Temperature:
    """The temperature that makes the left-out rows likeliest, each label weighing the same. scores: label, scores. A pass over the
    scores tries a grid of temperatures at once, and the next pass a finer one around the best."""
    scores = cut(scores)
    counts = {r.label: r.n for r in scores.groupBy("label").agg(F.count("*").alias("n")).collect()}
    known = scores.where("scores IS NOT NULL")
    usable = known.count()
    if usable < LEAST:
        return Temperature(None, usable)
    low, high = np.log(0.05), np.log(100)
    for _ in range(PASSES):
        grid = np.linspace(low, high, TRIES)

        def losses(batches: Iterator[pd.DataFrame], grid=grid) -> Iterator[pd.DataFrame]:
            total = np.zeros(TRIES)
            for pdf in batches:
                if len(pdf):
                    s = np.stack(pdf["scores"])
                    at = np.searchsorted(labels, pdf["label"].to_numpy(object).astype(str))
                    weight = 1 / pdf["label"].map(counts).to_numpy(float)
                    s = s - s.max(1, keepdims=True)
                    for t, log_t in enumerate(grid):
                        e = s / np.exp(log_t)
                        log_p = e[np.arange(len(s)), at] - np.log(np.exp(e).sum(1))
                        total[t] -= (weight * np.maximum(log_p, np.log(1e-12))).sum()
            yield pd.DataFrame({"t": np.arange(TRIES, dtype=np.int32), "loss": total})

        by = known.mapInPandas(losses, "t int, loss double").groupBy("t").agg(F.sum("loss").alias("loss")).orderBy("t").toPandas()
        best = int(by["loss"].to_numpy().argmin())
        low, high = grid[max(best - 1, 0)], grid[min(best + 1, TRIES - 1)]
    return Temperature(float(np.exp((low + high) / 2)), usable)


def calibrated(rows: DataFrame, components: int | str = "auto", shrinkage: float | str = "auto") -> tuple[ShapeLda, Temperature]:
    """The fit of all rows with the temperature of its left-out scores (1 if too few rows have any). rows: id, group, label, vector."""
    model = fit(rows, components=components, shrinkage=shrinkage).get(None)
    if model is None:
        raise ValueError("rows don't vary within two labels")
    t = fit_temperature(left_out_scores(rows, components, shrinkage).select("label", "scores"), model.lda.labels)
    return ShapeLda(model.pca, replace(model.lda, temperature=t.value or 1.0)), t
