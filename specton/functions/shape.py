"""Shape statistics in numpy: Procrustes alignment, PCA, shrinkage, discriminants and temperature. Kernels for drivers and Arrow UDFs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def centre_and_scale(points: np.ndarray) -> np.ndarray:
    """Centred points of unit centroid size."""
    p = points - points.mean(0)
    size = np.sqrt((p * p).sum())
    if size == 0:
        raise ValueError("points have no size")
    return p / size


def rotate_onto(points: np.ndarray, target: np.ndarray) -> np.ndarray:
    """points turned, never reflected, as near to target as they get."""
    angle = np.arctan2((points[:, 0] * target[:, 1] - points[:, 1] * target[:, 0]).sum(), (points * target).sum())
    c, s = np.cos(angle), np.sin(angle)
    return points @ np.array([[c, s], [-s, c]])


def procrustes_distance(a: np.ndarray, b: np.ndarray) -> float:
    a, b = centre_and_scale(a), centre_and_scale(b)
    return float(np.sqrt(((rotate_onto(a, b) - b) ** 2).sum()))


def gpa(shapes: np.ndarray, rounds: int = 20, tolerance: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """Aligned shapes and their mean, starting from the first: done when the mean moves by less than the tolerance."""
    own = np.stack([centre_and_scale(s) for s in shapes])
    mean = own[0]
    for _ in range(rounds):
        own = np.stack([rotate_onto(s, mean) for s in own])
        now = centre_and_scale(own.mean(0))
        moved, mean = np.sqrt(((now - mean) ** 2).sum()), rotate_onto(now, mean)
        if moved < tolerance:
            break
    return np.stack([rotate_onto(s, mean) for s in own]), mean


def align_to(mean: np.ndarray, points: np.ndarray) -> np.ndarray:
    return rotate_onto(centre_and_scale(points), mean)


def shrinkage_share(s: np.ndarray, n: int, quartic: float) -> float:
    """The Ledoit-Wolf share of a scaled identity in a covariance: s is Z'Z / n of n centred rows, quartic the sum of the fourth
    powers of their lengths. Both add up over any split of the rows."""
    d = len(s)
    spread = ((s - np.trace(s) / d * np.eye(d)) ** 2).sum()
    noise = (quartic - n * (s * s).sum()) / n**2
    return float(np.clip(min(noise, spread) / spread, 0, 1)) if spread > 0 else 1.0


def ledoit_wolf(z: np.ndarray) -> float:
    """The share for centred rows."""
    return shrinkage_share(z.T @ z / len(z), len(z), float(((z * z).sum(1) ** 2).sum()))


def softmax(scores: np.ndarray, temperature: float = 1.0) -> np.ndarray:
    e = np.exp((scores - scores.max(-1, keepdims=True)) / temperature)
    return e / e.sum(-1, keepdims=True)


@dataclass
class Pca:
    mean: np.ndarray
    basis: np.ndarray
    explained: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, components: int) -> Pca:
        z = x - x.mean(0)
        return cls.of_moments(len(x), x.mean(0), z.T @ z, components)

    @classmethod
    def of_moments(cls, n: int, mean: np.ndarray, squares: np.ndarray, components: int) -> Pca:
        """squares: the sum of centred rows' outer products. Each direction points to where its largest component is positive."""
        values, vectors = np.linalg.eigh(squares / max(1, n - 1))
        values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(mean))] < 0, -1.0, 1.0)
        total = values.sum()
        return cls(mean, vectors[:, :components], values[:components] / (total if total else 1))

    def transform(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.basis


@dataclass
class Lda:
    """Linear discriminants with a pooled covariance, shrunk to a scaled identity, and equal priors."""

    labels: list[str]
    weights: np.ndarray
    offsets: np.ndarray
    temperature: float = 1.0
    share: float = 0.0

    @classmethod
    def fit(cls, x: np.ndarray, y: list[str], shrinkage: float | str = "auto") -> Lda:
        labels = sorted(set(y))
        at = np.array([labels.index(v) for v in y])
        means = np.stack([x[at == k].mean(0) for k in range(len(labels))])
        z = x - means[at]
        return cls.of_moments(labels, len(x), means, z.T @ z, float(((z * z).sum(1) ** 2).sum()), shrinkage)

    @classmethod
    def of_moments(cls, labels: list[str], n: int, means: np.ndarray, within: np.ndarray, quartic: float, shrinkage: float | str = "auto") -> Lda:
        """within: the sum of outer products of rows less their label's mean; quartic: the sum of these rows' fourth powers."""
        d = means.shape[1]
        share = shrinkage_share(within / n, n, quartic) if shrinkage == "auto" else float(shrinkage)
        cov = within / max(1, n - len(labels))
        trace = np.trace(cov)
        if len(labels) < 2 or not (trace > 0 and np.isfinite(trace)):
            raise ValueError("rows don't vary within two labels")
        w = np.linalg.solve((1 - share) * cov + trace / d * (share + 1e-8) * np.eye(d), means.T).T
        return cls(labels, w, -0.5 * (w * means).sum(1), share=share)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights.T + self.offsets

    def predict(self, x: np.ndarray) -> list[str]:
        """The best label, ties to the first in order."""
        return [self.labels[i] for i in self.scores(x).argmax(1)]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.scores(x), self.temperature)


def components_for(dims: int, rows: int, labels: int) -> int:
    """How many principal components a landmark model keeps."""
    return max(1, min(dims - 4, (rows - labels) // 2))


def fit_temperature(scores: np.ndarray, truth: np.ndarray, steps: int = 80) -> float:
    """The temperature with the least label-balanced log-loss, by ternary search over its logarithm from 0.05 to 100."""
    counts = np.bincount(truth, minlength=scores.shape[1])
    weight = 1 / counts[truth] / (counts > 0).sum()

    def loss(log_t: float) -> float:
        p = softmax(scores, np.exp(log_t))[np.arange(len(truth)), truth]
        return float(-(weight * np.log(np.maximum(p, 1e-300))).sum())

    low, high = np.log(0.05), np.log(100)
    for _ in range(steps):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


@dataclass
class ShapeLda:
    """Principal components of aligned shapes, laid out as vectors, and discriminants on them."""

    pca: Pca
    lda: Lda

    @classmethod
    def fit(cls, x: np.ndarray, y: list[str], components: int | str = "auto", shrinkage: float | str = "auto") -> ShapeLda:
        k = components_for(x.shape[1], len(x), len(set(y))) if components == "auto" else components
        pca = Pca.fit(x, k)
        return cls(pca, Lda.fit(pca.transform(x), y, shrinkage))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.lda.scores(self.pca.transform(x))

    def predict(self, x: np.ndarray) -> list[str]:
        return self.lda.predict(self.pca.transform(x))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self.lda.probabilities(self.pca.transform(x))


def fit_guide(guide: np.ndarray, points: np.ndarray) -> np.ndarray:
    """guide moved, turned and scaled onto the points that are there (not nan), by least squares."""
    here = ~np.isnan(points).any(1)
    g, p = guide[here] - guide[here].mean(0), points[here] - points[here].mean(0)
    turned = rotate_onto(g, p)
    scale = (turned * p).sum() / max((g * g).sum(), 1e-300)
    whole = guide - guide[here].mean(0)
    angle = np.arctan2((g[:, 0] * p[:, 1] - g[:, 1] * p[:, 0]).sum(), (g * p).sum())
    c, s = np.cos(angle), np.sin(angle)
    return scale * whole @ np.array([[c, s], [-s, c]]) + points[here].mean(0)


def outliers(guide: np.ndarray, points: np.ndarray, share: float = 0.12) -> np.ndarray:
    """Indices of points farther from the fitted guide than a share of its size; none under four points."""
    here = ~np.isnan(points).any(1)
    if here.sum() < 4:
        return np.zeros(0, np.int64)
    fit = fit_guide(guide, points)
    size = np.sqrt(((fit[here] - fit[here].mean(0)) ** 2).sum(1).mean())
    return np.flatnonzero(here & (np.sqrt(((points - fit) ** 2).sum(1)) > share * size))


def apply_affine(m: np.ndarray, points: np.ndarray) -> np.ndarray:
    m = np.asarray(m, float).reshape(3, 3)
    return points @ m[:2, :2].T + m[:2, 2]


def inverse_affine(m: np.ndarray) -> np.ndarray:
    m = np.asarray(m, float).reshape(3, 3)
    if abs(np.linalg.det(m[:2, :2])) < 1e-12:
        raise ValueError("the matrix has no inverse")
    return np.linalg.inv(m)
