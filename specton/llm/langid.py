"""Language identification by error-correcting output codes.

Each language has a codeword of bits; one logistic classifier over hashed byte n-grams predicts each bit. A text goes to
the codeword with the least loss, bits weighted by how well they were learned, and is flagged as ambiguous if the
runner-up is close.

The classifiers learn from at most about ``per_language`` labelled texts of each language, chosen by a hash of doc_id;
every text is scored whole.

Defined results: a null text, or one without letters, is ``und`` with score 0 and ambiguous; without labelled rows all
are; repeated rows are scored each, and every text from itself alone, in whatever batch it comes; of languages that fit
equally well the first by name is chosen; an empty table gives none. lang, source and doc_id are no inputs of a prediction.
The caller's columns are kept, added ones of the same name replace them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specton.llm.common import small_batches, unused

#: Hashed n-gram features, n-gram lengths in bytes, and labelled texts of a language to learn from.
FEATURES = 4096
NGRAMS = (2, 3, 4)
PER_LANGUAGE = 400
#: A prediction is ambiguous if the runner-up's score is over this share of the best one's.
CLOSE = 0.6
UNKNOWN = "und"

_letter = np.zeros(256, np.uint8)
_letter[:] = 32
_letter[97:123] = np.arange(97, 123)
_letter[128:] = np.arange(128, 256)


def features(texts: list[str | None]) -> np.ndarray:
    """Square roots of the relative frequencies of hashed n-grams: a unit vector a text, zero if it has no letters."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    raw = [t.lower().encode("utf-8", "replace") if t and any(map(str.isalpha, t)) else b"" for t in texts]
    run, size = [], 0
    for i in range(len(raw) + 1):
        if run and (i == len(raw) or size + len(raw[i]) > 1 << 20 or len(run) == 256):
            out[run] = _counts([raw[j] for j in run])
            run, size = [], 0
        if i < len(raw):
            run.append(i)
            size += len(raw[i])
    return out


def _counts(raw: list[bytes]) -> np.ndarray:
    data = _letter[np.frombuffer(b"  ".join([*raw, b""]), np.uint8)]
    own = np.repeat(np.arange(len(raw)), [len(r) + 2 for r in raw])
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32) | (own[1:] != own[:-1])
    data, own = data[keep].astype(np.uint32), own[keep]
    total = np.zeros((len(raw), FEATURES), np.float32)
    h = np.zeros(len(data), np.uint32)
    for n in range(1, max(NGRAMS) + 1):
        h = h[: len(data) - n + 1] * np.uint32(0x01000193) + data[n - 1 :] + np.uint32(n)
        if n in NGRAMS:
            at = (h ^ (h >> np.uint32(13)) ^ (h >> np.uint32(21))) % np.uint32(FEATURES)
            within = own[: len(h)] == own[n - 1 :]  # no n-gram runs into the next text
            total += np.bincount(own[: len(h)][within] * FEATURES + at[within], minlength=len(raw) * FEATURES).reshape(total.shape)
    total[[not r for r in raw]] = 0
    return np.sqrt(total / np.maximum(total.sum(1, keepdims=True), 1))


def codewords(n: int) -> np.ndarray:
    """A row of +1 and -1 for each of n classes: all splits in two for up to six, else the best of random codes."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        return np.array([(1.0, *b) for b in product((1.0, -1.0), repeat=n - 1) if -1.0 in b]).T
    bits, rng = int(np.ceil(10 * np.log2(n))), np.random.default_rng(n)
    made = [rng.choice([-1.0, 1.0], (n, bits)) for _ in range(200)]
    nearest = lambda m: np.where(np.eye(n, dtype=bool), np.inf, bits - m @ m.T).min()
    return max(made, key=nearest)


class Ecoc:
    """Codewords, bit classifiers and bit weights."""

    def __init__(self, x: np.ndarray, labels: list[str], rounds: int = 80, l2: float = 1e-4) -> None:
        self.languages = sorted(set(labels))
        self.codes = codewords(len(self.languages))
        where = np.array([self.languages.index(y) for y in labels], np.int64)
        y = self.codes[where].astype(np.float32)
        counts = np.bincount(where, minlength=len(self.languages))
        weight = (1.0 / counts[where] / max(len(self.languages), 1)).astype(np.float32)[:, None]
        w = v = np.zeros((FEATURES + 1, y.shape[1]), np.float32)
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        for k in range(rounds):  # accelerated gradient steps on the weighted logistic loss
            ahead = v + (k / (k + 3)) * (v - w)
            grad = x.T @ (-y * weight / (1 + np.exp(np.clip(y * (x @ ahead), -30, 30)))) + l2 * ahead
            w, v = v, ahead - 2.0 * grad
        self.w = v
        loss = (np.log1p(np.exp(-np.clip(y * (x @ self.w), -30, 30))) * weight).sum(0)
        self.bits = np.exp(-loss) / np.exp(-loss).sum() if y.shape[1] else np.ones(0)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """For each text and language a share of 1, by the loss to its codeword."""
        f = x @ self.w[:-1] + self.w[-1]
        loss = np.stack([(np.log1p(np.exp(-np.clip(f * c, -30, 30))) * self.bits).sum(1) for c in self.codes], 1)
        e = np.exp(-len(self.bits) * (loss - loss.min(1, keepdims=True)))
        return e / e.sum(1, keepdims=True)


def sampled(rows: DataFrame, label: str, key: str, most: int) -> DataFrame:
    """About ``most`` rows of each label at most, by a hash of the key: the same rows however the table is dealt.

    The counts of the labels come to the driver, as the model with its classes does.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if not counts:
        return rows
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, most / n)])
    u = F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.where(u < share[F.col(label)])


def fit(docs: DataFrame, learn_from: Column, per_language: int = PER_LANGUAGE) -> Ecoc | None:
    """Learn from the labelled rows that ``learn_from`` names. None without any."""
    rows = small_batches(docs).where(learn_from & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    chosen = sampled(rows, "lang", "doc_id", per_language)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = features(pdf["text"].tolist())
            keep = x.any(1)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64")[keep], "lang": pdf["lang"][keep], "x": [r.tobytes() for r in x[keep]]})

    got = sorted(chosen.mapInPandas(vectors, "doc_id long, lang string, x binary").toArrow().to_pylist(), key=lambda r: (r["lang"], r["doc_id"] is None, r["doc_id"], r["x"]))
    return Ecoc(np.stack([np.frombuffer(r["x"], np.float32) for r in got]), [r["lang"] for r in got]) if got else None


def predict(docs: DataFrame, model: Ecoc | None) -> DataFrame:
    """The input with lang_pred, score and ambiguous; its columns of those names, if any, are replaced."""

    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            out = pd.DataFrame({"lang_pred": [UNKNOWN] * len(s), "score": 0.0, "ambiguous": True})
            for k in range(0, len(s) if model else 0, 1000):
                x = features(s.iloc[k : k + 1000].tolist())
                known = np.flatnonzero(x.any(1))
                if len(known):
                    p = np.sort(q := model.scores(x[known]), 1)
                    out.loc[k + known, "lang_pred"] = [model.languages[i] for i in q.argmax(1)]
                    out.loc[k + known, "score"] = p[:, -1]
                    out.loc[k + known, "ambiguous"] = p[:, -2] > CLOSE * p[:, -1] if p.shape[1] > 1 else False
            yield out

    predicted = F.pandas_udf(score, "lang_pred string, score double, ambiguous boolean")
    columns = [c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]
    p = unused(docs, "prediction")
    return small_batches(docs).select(*columns, predicted(F.col("text").cast("string")).alias(p)).select(*columns, f"{p}.lang_pred", f"{p}.score", f"{p}.ambiguous")


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents kept from learning: crc32 of the id's digits is 2 modulo 4."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2
