"""Quality classification by co-training a text-content view and a page-metadata view.

The text view reads the text alone: a logistic model on hashed words, word stems and byte trigrams of the whole text, and
boosted trees on its log-odds and on layout figures. The metadata view never sees it: boosted trees on language, source and the size the table states, a source
and a language standing for the share of labelled rows that they are right in. Both learn from a bounded sample of
labelled documents. In rounds each scores all documents outside that sample in the cluster, and of those that it is sure of a
hashed ``EXCHANGE`` for each side are labelled for the other view, if it tells more than the prior does. Both are then
calibrated on labelled rows that they didn't learn from, and so is the sum of their log-odds, a weight each.

Two targets are learned alike: quality (is it fit to train on) and toxic. ``keep`` asks for both scores' right side.

Bounds, all parameters: about ``per_stratum`` labelled rows of each of the four kinds of labels, by a hash of doc_id, and
``EXCHANGE`` pseudo-labels of a view, target, side and round. Every document is scored on its whole text.

Defined results: a null or empty text has zero features and gets the views' scores for it; a null or unseen language or
source counts as the average one, a null n_chars as zero; label rows that contradict each other count as low quality and
as toxic; a null label is none; without labels of both kinds for a target its score is 0.5, which keeps the document;
repeated rows are scored each, and alike in whatever batch they come; an empty table gives no rows. A table without
n_chars is read as if it were null; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specton.llm.boosting import BoostedTrees
from specton.llm.common import Words, small_batches
from specton.llm.langid import sampled

PER_STRATUM = 900
WORD_BUCKETS = 1 << 15
STEM_BUCKETS = 1 << 15
GRAM_BUCKETS = 1 << 12
#: Bytes of a stem; layout figures of a text, which follow the hashed features.
STEM, FIGURES = 5, 12
WIDTH = WORD_BUCKETS + STEM_BUCKETS + GRAM_BUCKETS
END = WIDTH + FIGURES
ROUNDS = 2
#: Pseudo-labels of a view for each target and side in a round, and the probability from which on a view is sure.
EXCHANGE = 150
SURE = 0.95
#: A view labels for the other only if its log-loss is under this share of the prior's entropy.
GAIN = 0.7
#: Standard errors between the classes' means at which a text feature takes part by half.
TELLING = 3.0
#: Parts of the labelled rows, each taken by a linear model of the others for the trees to learn from.
FOLDS = 4
#: Labelled rows that an unseen language or source weighs as much as.
SMOOTH = 20.0
CHUNK = 200
TARGETS = ("quality", "toxic")
VIEWS = ("text", "meta")
#: Log-odds of toxic above which a document isn't kept: a score of 0.5.
TOXIC_LIMIT = 0.0

_KIND = np.zeros(256, np.uint8)  # 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 bar, 7 other ASCII; 0 beyond ASCII
_KIND[:128] = 7
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[[9, 13, 32]], _KIND[10], _KIND[124] = 1, 2, 3, 4, 5, 6


class Sparse:
    """Rows of non-zero features: columns and values of all rows, and where each begins."""

    def __init__(self, begin: np.ndarray, column: np.ndarray, value: np.ndarray) -> None:
        self.begin, self.column, self.value = begin, column, value

    def __len__(self) -> int:
        return len(self.begin) - 1

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row (from 0), column and value of the features of these rows."""
        size = self.begin[rows + 1] - self.begin[rows]
        at = np.arange(size.sum()) + np.repeat(self.begin[rows] - np.cumsum(size) + size, size)
        return np.repeat(np.arange(len(rows)), size), self.column[at], self.value[at].astype(np.float32)

    def figures(self, rows: np.ndarray | None = None) -> np.ndarray:
        """The layout figures of the rows."""
        _, column, value = self.take(np.arange(len(self)) if rows is None else rows)
        return value[column >= WIDTH].reshape(-1, FIGURES).astype(float)

    @classmethod
    def joined(cls, parts: list[Sparse]) -> Sparse:
        ends = np.concatenate([[0], np.cumsum([len(p.column) for p in parts])])
        begin = np.concatenate([p.begin[:-1] + e for p, e in zip(parts, ends, strict=False)] + [ends[-1:]]).astype(np.int64)
        return cls(begin, np.concatenate([p.column for p in parts]), np.concatenate([p.value for p in parts]))


class TextFeatures:
    """Words, shares of word stems, square roots of trigram shares, and layout figures.

    A text's features are the same in whatever company it comes."""

    def __init__(self) -> None:
        self.words, self.stems = Words(), Words(STEM)

    def __call__(self, texts: list[str | None]) -> Sparse:
        n, parts = len(texts), []
        for words, buckets, first in ((self.words, WORD_BUCKETS, 0), (self.stems, STEM_BUCKETS, WORD_BUCKETS)):
            h, bounds = words(texts)
            own = np.repeat(np.arange(n), np.diff(bounds))
            key, count = np.unique(own * buckets + (h >> np.uint64(32)).astype(np.int64) % buckets, return_counts=True)
            share = count / np.maximum(np.diff(bounds), 1)[key // buckets]
            parts.append((key // buckets, first + key % buckets, np.minimum(100 * share, 3.0) if first else np.full(len(key), 0.3)))
        raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        size = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        own = np.repeat(np.arange(n), size)
        if len(data) > 2:
            d = data.astype(np.uint32)
            g = (d[:-2] * np.uint32(0x9E3779B1) ^ d[1:-1] * np.uint32(0x85EBCA77) ^ d[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(7)
            within = own[:-2] == own[2:]
            count = np.bincount(own[:-2][within] * GRAM_BUCKETS + (g[within] % np.uint32(GRAM_BUCKETS)).astype(np.int64), minlength=n * GRAM_BUCKETS)
            some = np.flatnonzero(count)
            parts.append((some // GRAM_BUCKETS, WORD_BUCKETS + STEM_BUCKETS + some % GRAM_BUCKETS, np.sqrt(count[some] / size[some // GRAM_BUCKETS])))
        kinds = np.bincount(own * 8 + _KIND[data], minlength=8 * n).reshape(n, 8)
        whole = np.maximum(size, 1)
        lines, spaces = kinds[:, 5] + 1, kinds[:, 4] + kinds[:, 5]
        packed = np.array([len(zlib.compress(r, 1)) for r in raw])
        figures = [np.log2(1 + size), np.log2(1 + lines), np.log2(whole / lines), np.log2(whole / (spaces + 1)), packed / whole, *(kinds[:, k] / whole for k in (0, 1, 2, 3, 5, 6, 7))]
        row = np.repeat(np.arange(n), FIGURES)
        parts.append((row, np.tile(WIDTH + np.arange(FIGURES), n), np.stack(figures, 1).ravel()))
        row, column, value = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(row, kind="stable")
        return Sparse(np.searchsorted(row[order], np.arange(n + 1)), column[order].astype(np.int32), value[order].astype(np.float16))


class Metadata:
    """Numbers for language, source and stated size. Names stand for the log-odds of the target among labelled rows with them."""

    def __init__(self, names: list[tuple], y: np.ndarray, weight: np.ndarray) -> None:
        p = float(np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3))
        self.average, self.known, unit = float(np.log(p / (1 - p))), [], weight.mean()
        for k in range(2):
            sums: dict[str, list[float]] = {}
            for row, v, w in zip(names, y, weight, strict=True):
                if isinstance(row[k], str):
                    s = sums.setdefault(row[k], [0.0, 0.0])
                    s[0], s[1] = s[0] + w * v, s[1] + w
            self.known.append({name: float(np.log((yes + SMOOTH * unit * p) / (all_ - yes + SMOOTH * unit * (1 - p)))) for name, (yes, all_) in sums.items()})

    def __call__(self, names: list[tuple]) -> np.ndarray:
        """names: language, source and size of each row."""
        size = [float(r[2]) if r[2] is not None and r[2] == r[2] else 0.0 for r in names]
        known = [[self.known[k].get(r[k], self.average) if isinstance(r[k], str) else self.average for k in range(2)] for r in names]
        return np.column_stack([np.array(known, float).reshape(-1, 2), np.log1p(np.maximum(size, 0))])


@dataclass
class Linear:
    """Logistic regression on sparse rows, by steps on small batches that each feature's own past gradients slow down.

    A feature whose means in the two classes differ by z standard errors takes part with the factor
    z**4 / (z**4 + TELLING**4): the less it tells, the more it is held back, and none is left out."""

    w: np.ndarray

    def margins(self, x: Sparse, rows: np.ndarray | None = None) -> np.ndarray:
        row, column, value = x.take(np.arange(len(x)) if rows is None else rows)
        return np.bincount(row, value * self.w[column], len(x) if rows is None else len(rows)) + self.w[-1]  # figures weigh nothing

    @classmethod
    def fit(cls, x: Sparse, rows: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 8, rate: float = 0.15, batch: int = 32, l2: float = 1e-4) -> Linear:
        w, seen, total = np.zeros(END + 1), np.full(END + 1, 1e-4), np.zeros(END + 1)
        weight, rng, steps = weight / weight.mean(), np.random.default_rng(3), 0
        means, error = [], np.full(END, 1e-12)
        for own in (rows[y > 0.5], rows[y <= 0.5]):
            _, column, value = x.take(own)
            means.append(np.bincount(column, value, END) / max(len(own), 1))
            error += np.maximum(np.bincount(column, value * value, END) / max(len(own), 1) - means[-1] ** 2, 0) / max(len(own), 1)
        z4 = (means[0] - means[1]) ** 4 / error**2
        factor = (z4 / (z4 + TELLING**4)).astype(np.float32)
        factor[WIDTH:] = 0
        for epoch in range(epochs):
            mixed = rng.permutation(len(y))
            for k in range(0, len(mixed), batch):
                own = mixed[k : k + batch]
                row, column, value = x.take(rows[own])
                value = value * factor[column]
                p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * w[column], len(own)) + w[-1], -30, 30)))
                r = weight[own] * (y[own] - p) / len(own)
                at, inverse = np.unique(column, return_inverse=True)
                grad = np.append(np.bincount(inverse, value * r[row], len(at)) - l2 * w[at], r.sum())
                at = np.append(at, END)
                seen[at] += grad * grad
                w[at] += rate * grad / np.sqrt(seen[at])
            if epoch >= epochs // 2:
                total += w
                steps += 1
        return cls(total / steps * np.append(factor, 1.0))


@dataclass
class TextModel:
    """Boosted trees on layout figures and on the log-odds of a linear model. The trees learn from log-odds of models that
    didn't see the row, so that they trust them as much as they may."""

    linear: Linear
    trees: BoostedTrees

    @classmethod
    def fit(cls, x: Sparse, rows: np.ndarray, y: np.ndarray, weight: np.ndarray) -> TextModel:
        margins, fold = np.zeros(len(rows)), np.arange(len(rows)) % FOLDS
        for own in (fold != k for k in range(FOLDS)):
            if own.any() and not own.all():
                margins[~own] = Linear.fit(x, rows[own], y[own], weight[own]).margins(x, rows[~own])
        return cls(Linear.fit(x, rows, y, weight), BoostedTrees(40, 3, 0.2).fit(np.column_stack([margins, x.figures(rows)]), y, weight))

    def log_odds(self, x: Sparse, rows: np.ndarray | None = None) -> np.ndarray:
        return self.trees.log_odds(np.column_stack([self.linear.margins(x, rows), x.figures(rows)]))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients, never negative, and a constant for a few columns, by Newton steps with a little prior."""
    scale = np.where(x.std(0) > 1e-6, x.std(0), np.inf)  # a column that is always the same weighs nothing
    z = np.hstack([x / scale, np.ones((len(x), 1))])
    p = np.append(np.ones(x.shape[1]), 0.0)
    w = weight / weight.sum() * len(x)
    ridge = np.append(np.full(x.shape[1], 0.5), 1e-3)

    def loss(p: np.ndarray) -> float:
        return float((w * (np.logaddexp(0, z @ p) - y * (z @ p))).sum() + 0.5 * (ridge * p * p).sum())

    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(z @ p, -30, 30)))
        step = np.linalg.solve((z * (w * np.maximum(q * (1 - q), 1e-4))[:, None]).T @ z + np.diag(ridge), z.T @ (w * (y - q)) - ridge * p)
        now = loss(p)
        for _ in range(30):  # shorter steps until one helps
            after = p + step
            after[:-1] = np.maximum(after[:-1], 0.0)
            if loss(after) < now:
                p = after
                break
            step = step / 2
        else:
            break
    return p[:-1] / scale, float(p[-1])


@dataclass
class View:
    """Both views of a target with their calibration, and the calibrated sum."""

    text: TextModel
    metadata: Metadata
    trees: BoostedTrees
    scale: dict[str, tuple[np.ndarray, float]]
    both: tuple[np.ndarray, float] | None = None
    teaches: tuple[str, ...] = ()

    def log_odds(self, x: Sparse, names: list[tuple], rows: np.ndarray | None = None) -> dict[str, np.ndarray]:
        f = {"text": self.text.log_odds(x, rows), "meta": self.trees.log_odds(self.metadata(names))}
        return {k: self.scale[k][0][0] * v + self.scale[k][1] if self.scale else v for k, v in f.items()}


@dataclass
class CoTrained:
    """The views of each target, and how many documents each view labelled for the other, round by round."""

    views: dict[str, View] = field(default_factory=dict)
    exchanged: list[dict[tuple[str, str], int]] = field(default_factory=list)

    def log_odds(self, target: str, x: Sparse, names: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated log-odds of the text view, the metadata view and both together."""
        n, v = len(x), self.views.get(target)
        if v is None:
            return np.zeros(n), np.zeros(n), np.zeros(n)
        f = v.log_odds(x, names)
        return f["text"], f["meta"], np.stack([f[k] for k in VIEWS], 1) @ v.both[0] + v.both[1]

    def keeps(self, x: Sparse, names: list[tuple]) -> np.ndarray:
        """Of sufficient quality and not toxic; a target that couldn't be learned rejects nothing."""
        quality, toxic = (self.log_odds(t, x, names)[2] for t in TARGETS)
        return (quality >= 0) & ((toxic <= TOXIC_LIMIT) | ("toxic" not in self.views))


def teaches(log_odds: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: float) -> bool:
    """Whether a view tells enough to label for the other: its log-loss is under GAIN of what the prior alone gives."""
    p = np.clip(1 / (1 + np.exp(-np.clip(log_odds, -30, 30))), 1e-9, 1 - 1e-9)
    loss = -(weight * np.where(y > 0, np.log(p), np.log(1 - p))).sum() / weight.sum()
    return loss < GAIN * -(prior * np.log(prior) + (1 - prior) * np.log(1 - prior))


@dataclass
class Sample:
    """Labelled rows and, after them, what the views labelled for each other."""

    ids: np.ndarray
    x: Sparse
    names: list[tuple]
    labels: dict[str, np.ndarray]  # 0, 1, or -1 for none
    weight: np.ndarray
    #: For each target and view the rows that the other view labelled, and their labels.
    taught: dict[tuple[str, str], list[tuple[int, float]]] = field(default_factory=dict)

    def append(self, ids: np.ndarray, x: Sparse, names: list[tuple]) -> np.ndarray:
        """Places of the new rows."""
        n = len(self.ids)
        self.ids, self.x, self.names = np.append(self.ids, ids), Sparse.joined([self.x, x]), self.names + names
        return n + np.arange(len(ids))

    def fit(self, target: str) -> View | None:
        y = self.labels[target]
        labelled = np.flatnonzero(y >= 0)
        if len(np.unique(y[labelled])) < 2:
            return None
        fold = labelled % 4 == 0  # kept for calibration
        if len(np.unique(y[labelled[fold]])) < 2 or len(np.unique(y[labelled[~fold]])) < 2:
            fold = np.zeros(len(labelled), bool)
        learn, check = labelled[~fold], labelled[fold] if fold.any() else labelled
        prior = float(np.clip((self.weight[labelled] * y[labelled]).sum() / self.weight[labelled].sum(), 1e-3, 1 - 1e-3))
        given = {}
        for view in VIEWS:
            more = self.taught.get((target, view), [])
            w = np.full(len(more), np.median(self.weight[labelled]))
            given[view] = np.append(learn, [r for r, _ in more]).astype(np.int64), np.append(y[learn], [v for _, v in more]).astype(float), np.append(self.weight[learn], w)
        text = TextModel.fit(self.x, *given["text"])
        rows, side, w = given["meta"]
        metadata = Metadata([self.names[i] for i in rows], side, w)
        trees = BoostedTrees(20, 2, 0.2).fit(metadata([self.names[i] for i in rows]), side, w)
        out = View(text, metadata, trees, {})
        f, wanted = out.log_odds(self.x, [self.names[i] for i in check], check), y[check].astype(float)
        out.scale = {k: logistic(f[k][:, None], wanted, self.weight[check]) for k in VIEWS}
        own = np.stack([out.scale[k][0][0] * f[k] + out.scale[k][1] for k in VIEWS], 1)
        out.teaches = tuple(k for i, k in enumerate(VIEWS) if teaches(own[:, i], y[check], self.weight[check], prior))
        out.both = logistic(own, wanted, self.weight[check])
        return out


_NAMES = ("lang", "source", "n_chars")
_FEATURES = "doc_id long, lang string, source string, n_chars double, size int, column binary, value binary"


def _columns(docs: DataFrame) -> DataFrame:
    size = F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")], size.cast("double").alias("n_chars"))


def _names(pdf: pd.DataFrame) -> list[tuple]:
    return list(zip(pdf["lang"].tolist(), pdf["source"].tolist(), pdf["n_chars"].tolist(), strict=True))


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, Sparse, list[tuple]]]:
    take = TextFeatures()
    for pdf in batches:
        for k in range(0, len(pdf), CHUNK):
            part = pdf.iloc[k : k + CHUNK]
            yield part, take([t if isinstance(t, str) else None for t in part["text"]]), _names(part)


def _fetched(rows: DataFrame) -> tuple[np.ndarray, Sparse, list[tuple]]:
    """Ids, features and names of a bounded number of documents, one row an id, in order of their ids."""

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, x, _ in _parts(batches):
            cut = lambda a: [a[b:e].tobytes() for b, e in zip(x.begin, x.begin[1:], strict=False)]  # noqa: E731, B023
            yield part.drop(columns="text").assign(size=np.diff(x.begin), column=cut(x.column), value=cut(x.value))

    got = rows.mapInPandas(vectors, _FEATURES).toArrow()
    ids = got["doc_id"].to_numpy()
    sizes = got["size"].to_numpy()
    order = np.lexsort((sizes, ids))
    order = order[np.append(True, ids[order][1:] != ids[order][:-1])] if len(order) else order
    blob = lambda c, kind: np.frombuffer(b"".join([got[c][int(i)].as_py() for i in order]), kind)
    names = list(zip(*[got[c].take(order).to_pylist() for c in _NAMES], strict=True))
    return ids[order], Sparse(np.concatenate([[0], np.cumsum(sizes[order])]).astype(np.int64), blob("column", np.int32), blob("value", np.float16)), names


def _sure(docs: DataFrame, views: dict[str, View], known: np.ndarray, most: int, number: int) -> DataFrame:
    """doc_id, target, view, side: of all documents that a view is sure of and that aren't known yet, the ``most`` of each kind with the least hashes of this round."""
    shared = docs.sparkSession.sparkContext.broadcast((views, np.sort(known)))
    kinds = [(t, k, side) for t, v in views.items() for k in v.teaches for side in (0, 1)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = {kind: (np.zeros(0), np.zeros(0, np.int64)) for kind in kinds}
        limit = np.log(SURE / (1 - SURE))
        for part, x, names in _parts(batches):
            f = {t: v.log_odds(x, names) for t, v in shared.value[0].items()}
            new = ~np.isin(part["doc_id"], shared.value[1])
            for t, k, side in kinds:
                ok = new & (f[t][k] >= limit if side else f[t][k] <= -limit)
                u, ids = np.append(best[t, k, side][0], part["u"][ok]), np.append(best[t, k, side][1], part["doc_id"][ok])
                u, first = np.unique(u, return_index=True)
                best[t, k, side] = u[:most], ids[first][:most]
        for (t, k, side), (u, ids) in best.items():
            if len(u):
                yield pd.DataFrame({"doc_id": ids, "target": t, "view": k, "side": side, "u": u})

    rows = docs.withColumn("u", F.pmod(F.xxhash64("doc_id", F.lit(29 + number)), F.lit(1 << 52)).cast("double")).mapInPandas(run, "doc_id long, target string, view string, side int, u double")
    for by in (["target", "view", "side", F.pmod(F.col("u"), F.lit(64.0))], ["target", "view", "side"]):  # in two steps, so that no task gets all
        rows = rows.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("u", "doc_id"))).where(F.col("k") <= most).drop("k")
    return rows


def fit(docs: DataFrame, labels: DataFrame, per_stratum: int = PER_STRATUM, rounds: int = ROUNDS, exchange: int = EXCHANGE) -> CoTrained:
    """Sample labelled documents and co-train: features and pseudo-labels come from the cluster, the two models are fitted on the driver."""
    docs = _columns(docs)
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL")
    stratum = F.concat_ws("/", F.coalesce(F.col("quality").cast("string"), F.lit("-")), F.coalesce(F.col("toxic").cast("string"), F.lit("-")))
    sizes = {r[0]: r[1] for r in marks.groupBy(stratum.alias("s")).count().collect()}
    chosen = sampled(marks.withColumn("stratum", stratum), "stratum", "doc_id", per_stratum).toArrow().to_pylist()
    of = {r["doc_id"]: r for r in chosen}
    model = CoTrained()
    # The sample holds about per_stratum rows of each kind of labels, whatever the tables' sizes.
    wanted = docs.sparkSession.createDataFrame([(i,) for i in of], "doc_id long")
    ids, x, names = _fetched(docs.join(F.broadcast(wanted), "doc_id"))
    if not len(ids):
        return model
    seen: dict[str, int] = {}
    for i in ids.tolist():
        seen[of[i]["stratum"]] = seen.get(of[i]["stratum"], 0) + 1
    mark = lambda t: np.array([-1 if of[i][t] is None else of[i][t] for i in ids.tolist()])
    weight = np.array([sizes[of[i]["stratum"]] / seen[of[i]["stratum"]] for i in ids.tolist()])
    sample = Sample(ids, x, names, {t: mark(t) for t in TARGETS}, weight)
    free = docs.where("doc_id IS NOT NULL")
    for number in range(rounds + 1):
        model.views = {t: v for t in TARGETS if (v := sample.fit(t)) is not None}
        teachers = {t: v for t, v in model.views.items() if v.teaches}
        if number == rounds or not teachers:
            break
        told = _sure(free, teachers, sample.ids, exchange, number).select("doc_id", "target", "view", "side").toArrow().to_pylist()
        told = sorted(told, key=lambda r: (r["doc_id"], r["target"], r["view"], r["side"]))
        new = sorted({r["doc_id"] for r in told})
        if not new:
            break
        more = docs.sparkSession.createDataFrame([(i,) for i in new], "doc_id long")
        got = _fetched(docs.join(F.broadcast(more), "doc_id"))
        at = dict(zip(got[0].tolist(), sample.append(*got).tolist(), strict=True))
        count: dict[tuple[str, str], int] = {}
        for r in told:
            other = VIEWS[1 - VIEWS.index(r["view"])]
            sample.taught.setdefault((r["target"], other), []).append((at[r["doc_id"]], float(r["side"])))
            count[r["target"], r["view"]] = count.get((r["target"], r["view"]), 0) + 1
        model.exchanged.append(count)
    return model


SCORED = "doc_id long, quality_score double, text_score double, metadata_score double, toxic_score double, keep boolean"


def score(docs: DataFrame, model: CoTrained) -> DataFrame:
    """doc_id, quality_score (both views), text_score, metadata_score, toxic_score, keep."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        share = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
        for part, x, names in _parts(batches):
            a, b, both = m.log_odds("quality", x, names)
            toxic = m.log_odds("toxic", x, names)[2]
            yield pd.DataFrame({"doc_id": part["doc_id"], "quality_score": share(both), "text_score": share(a), "metadata_score": share(b), "toxic_score": share(toxic), "keep": m.keeps(x, names)})

    return _columns(docs).mapInPandas(run, SCORED)


def kept(docs: DataFrame, model: CoTrained) -> DataFrame:
    """The rows that ``score`` keeps, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(columns: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for text, lang, source, size in columns:
            pdf = pd.DataFrame({"text": text, "lang": lang, "source": source, "n_chars": size})
            yield pd.Series(np.concatenate([np.zeros(0, bool), *[shared.value.keeps(x, names) for _, x, names in _parts(iter([pdf]))]]))

    fit_to_train_on = F.pandas_udf(run, "boolean")
    size = F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)
    return small_batches(docs).where(fit_to_train_on(*[F.col(c).cast("string") for c in ("text", "lang", "source")], size.cast("double")))
