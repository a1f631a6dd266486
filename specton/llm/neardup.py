"""Near-duplicate classes by consistent weighted sampling over TF-IDF shingles.

Texts become bags of five-word shingles weighted by count times inverse document frequency. Document frequencies are
counted over all documents in a signed count sketch of fixed size: three rows of ``BUCKETS`` counters, to which each
shingle adds with a hashed sign, so that what other shingles add cancels out and the median of three is near its own
frequency however many shingles there are. Improved consistent weighted sampling draws one element for each of
``SLOTS`` slots; every shingle takes part in one slot of each of ``GROUPS`` groups of slots (bin-wise sampling), and
slots that stay empty in short texts borrow from a hashed other slot. Bands of slots are the search keys; weighted
Jaccard similarity of the whole texts decides.

Only texts are compared, not copies: equal texts are one row from the start. First each text of a bucket is proposed
with the partner its sketch agrees with best, which costs at most one pair a row, and the pairs that hold merge
classes. Buckets that still hold two classes with pairs of close sketches are then gone through again: the texts of such
rows are fetched, and in the order of the sketches' agreement whatever isn't connected yet is compared in full, so that
no candidate between two classes goes unseen and a large group gives a link a text and not all its pairs. A pair counts
only in the first band that it shares. Buckets over ``BLOCK`` texts are compared block by block.

Defined results: a null text is a class of its own, each row of it; texts without words are alike only if equal; a text
of fewer than five words has one shingle; repeated rows are copies of each other; an empty table gives no rows. class_id
is the smallest doc_id of the class, null if all are null. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specton.llm.common import Scratch, Words, mix64, shingles, small_batches, staged, unused

THRESHOLD = 0.8
SHINGLE = 5
#: Counters of each of the three rows of the document frequencies: 1.5 MB in all, wherever they go.
BUCKETS = 1 << 17
#: Slots of a sketch: GROUPS times BINS; bands of ROWS slots.
GROUPS, BINS = 10, 10
SLOTS = GROUPS * BINS
ROWS = 4
BANDS = SLOTS // ROWS
#: Pairs whose sketches agree in fewer slots aren't compared: five deviations below the threshold of 0.8.
LEAST = THRESHOLD - 5 * (THRESHOLD * (1 - THRESHOLD) / SLOTS) ** 0.5
BLOCK = 1024
CHUNK = 200


def _bags(words: Words, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, the text they belong to (sorted), and their counts."""
    e, d = shingles(*words(texts), SHINGLE)
    order = np.lexsort((e, d))
    e, d = e[order], d[order]
    new = np.ones(len(e), bool)
    new[1:] = (e[1:] != e[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    return e[at], d[at], np.diff(np.append(at, len(e))).astype(float)


def _cells(e: np.ndarray, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Each shingle's counter in a row of the sketch, and the sign it adds with."""
    h = mix64(e, 70 + row)
    return (h >> np.uint64(40)).astype(np.int64) % BUCKETS, np.where(h & np.uint64(1), 1.0, -1.0)


@dataclass
class Frequencies:
    """Document frequencies of shingles: three rows of signed counters, and the number of documents with words."""

    rows: np.ndarray
    n: float

    def weights(self, e: np.ndarray) -> np.ndarray:
        """From 1 to 2: 1 + log((n + 1) / (df + 1)) / log(n + 2)."""
        a, b, c = (sign * self.rows[k][at] for k in range(3) for at, sign in [_cells(e, k)])
        df = np.clip(np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c)), 1, max(self.n, 1))
        return 1 + np.log((self.n + 1) / (df + 1)) / np.log(self.n + 2)


def frequencies(texts: DataFrame) -> Frequencies:
    """Counted over all documents. texts: text, and n, how many documents it is the text of."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, df, total = Words(), np.zeros((3, BUCKETS)), 0
        for pdf in batches:
            for k in range(0, len(pdf), CHUNK):
                n = pdf["n"].to_numpy(float)[k : k + CHUNK]
                e, d, _ = _bags(words, pdf["text"].iloc[k : k + CHUNK].tolist())
                for row in range(3):
                    at, sign = _cells(e, row)
                    np.add.at(df[row], at, sign * n[d])
                total += int(n[np.unique(d)].sum())
        at = np.flatnonzero(df)
        yield pd.DataFrame({"cell": np.append(at, -1), "n": np.append(df.ravel()[at], total).astype(np.int64)})

    got = texts.select("text", "n").mapInPandas(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cell, n = got["cell"].to_numpy(), got["n"].to_numpy()
    rows = np.zeros(3 * BUCKETS, np.float32)
    rows[cell[cell >= 0]] = n[cell >= 0]
    return Frequencies(rows.reshape(3, BUCKETS), float(n[cell < 0].sum()))


def _layers(e: np.ndarray, d: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Elements cut into layers that weigh 2 at most. Minima and maxima of weights are the sums of those of the layers,
    so weighted Jaccard similarity stays the same, and no element outweighs a whole slot."""
    size = np.maximum(np.ceil(weight / 2), 1).astype(np.int64)
    if not len(e) or size.max() == 1:
        return e, d, weight
    level = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    e, d, weight = (np.repeat(x, size) for x in (e, d, weight))
    return np.where(level > 0, mix64(e ^ mix64(level.astype(np.uint64), 55)), e), d, np.minimum(weight - 2 * level, 2.0)


def sketch(e: np.ndarray, d: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """n rows of SLOTS sampled elements (as hashes); rows without elements are zero."""
    e, d, weight = _layers(e, d, weight)
    out, best = np.zeros(n * SLOTS, np.uint64), np.full(n * SLOTS, np.inf)
    log_w = np.log(weight)
    unit = 1.0 / (1 << 32)
    high = lambda x: ((x >> np.uint64(32)).astype(float) + 0.5) * unit
    low = lambda x: ((x & np.uint64(0xFFFFFFFF)).astype(float) + 0.5) * unit
    for g in range(GROUPS):
        a, b, c = (mix64(e, 3 * g + k) for k in range(3))
        r, gamma, beta = -np.log(high(a) * low(a)), -np.log(high(b) * low(b)), high(c)
        t = np.floor(log_w / r + beta)
        rank = np.log(gamma) - r * (t - beta) - r
        slot = d * SLOTS + g * BINS + ((c & np.uint64(0xFFFF)) % np.uint64(BINS)).astype(np.int64)
        np.minimum.at(best, slot, rank)
        won = np.flatnonzero(rank == best[slot])
        out[slot[won]] = mix64(e[won] ^ mix64(t[won].astype(np.int64).astype(np.uint64), 99), g) | np.uint64(1)
    out = out.reshape(n, SLOTS)
    full = out != 0
    rows = np.flatnonzero(full.any(1) & ~full.all(1))
    if len(rows):
        part, filled, slots = out[rows], full[rows], np.arange(SLOTS)
        made, need = part.copy(), ~filled
        for k in range(64):
            source = (mix64(slots.astype(np.uint64), 1000 + k) % np.uint64(SLOTS)).astype(np.int64)
            take = need & filled[:, source]
            made = np.where(take, mix64(part[:, source], 7) | np.uint64(1), made)
            need &= ~take
            if not need.any():
                break
        first = part[np.arange(len(rows)), filled.argmax(1)]
        out[rows] = np.where(need, first[:, None], made)
    return out


def sketched(texts: DataFrame, shared: Broadcast) -> DataFrame:
    """key, bands and sig (a byte a slot, then the bands again) of the texts with words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for pdf in batches:
            for k in range(0, len(pdf), CHUNK):
                part = pdf.iloc[k : k + CHUNK]
                e, d, tf = _bags(words, part["text"].tolist())
                s = sketch(e, d, tf * shared.value.weights(e), len(part))
                band = np.zeros((len(part), BANDS), np.uint64)
                with np.errstate(over="ignore"):
                    for j in range(ROWS):
                        band = mix64(band * np.uint64(31) + s[:, j * BANDS : (j + 1) * BANDS])
                    band = mix64(band ^ np.arange(BANDS, dtype=np.uint64))
                some = np.flatnonzero(s.any(1))
                short = (s >> np.uint64(8)).astype(np.uint8)
                yield pd.DataFrame({"key": part["key"].iloc[some], "bands": list(band.astype(np.int64)[some]), "sig": [short[i].tobytes() + band[i].tobytes() for i in some]})

    return texts.select("key", "text").mapInPandas(run, "key binary, bands array<long>, sig binary")


def _close(sigs: list[bytes], band: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far the sketches of left and right rows agree, and whether that is near and ``band`` the first they share."""
    raw = np.frombuffer(b"".join(sigs), np.uint8).reshape(len(sigs), -1)
    sig, bands = raw[:, :SLOTS], np.ascontiguousarray(raw[:, SLOTS:]).view(np.uint64)
    est = np.empty((len(left), len(right)), np.float32)
    ok = np.empty(est.shape, bool)
    for k in range(0, len(left), 32):
        rows = left[k : k + 32]
        est[k : k + 32] = (sig[rows, None, :] == sig[None, right, :]).sum(2, dtype=np.int16)
        ok[k : k + 32] = ~(bands[rows, None, :band] == bands[None, right, :band]).any(2) if band else True
    est /= SLOTS
    return est, ok & (est >= LEAST)


def _groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches of sorted rows, cut so that a group is never split, with the begin of each group and the end."""
    held: list[pd.DataFrame] = []

    def cuts(pdf: pd.DataFrame) -> np.ndarray:
        new = np.zeros(len(pdf), bool)
        for c in by:
            x = pdf[c].to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.concatenate([[0], np.flatnonzero(new), [len(pdf)]])

    for pdf in batches:
        if not len(pdf):
            continue
        if held and any(held[-1][c].iloc[-1] != pdf[c].iloc[-1] for c in by) or not held:
            pdf = pd.concat([*held, pdf], ignore_index=True) if held else pdf.reset_index(drop=True)
            at = cuts(pdf)
            if len(at) > 2:
                yield pdf.iloc[: at[-2]], at[:-1]
            held = [pdf.iloc[at[-2] :]]
        else:
            held.append(pdf)
    if held:
        pdf = pd.concat(held, ignore_index=True)
        yield pdf, cuts(pdf)


def _sides(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, bool]:
    lo, hi = part["lo"].iloc[0], part["hi"].iloc[0]
    if lo == hi:
        own = np.arange(len(part))
        return own, own, True
    blk = part["blk"].to_numpy()
    return np.flatnonzero(blk == lo), np.flatnonzero(blk == hi), False


def _nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each row's best partner as a pair a, b; and the buckets that hold further close pairs."""
    for pdf, at in _groups(batches, ["bucket", "lo", "hi"]):
        keys, sigs, bands, n, buckets = (pdf[c].tolist() for c in ("key", "sig", "band", "n", "bucket"))
        out: list[tuple] = []
        for begin, end in zip(at[:-1], at[1:], strict=True):
            size = end - begin
            if size == 2 and n[begin] == 2:
                x, y = np.frombuffer(sigs[begin], np.uint8), np.frombuffer(sigs[begin + 1], np.uint8)
                same = x == y
                k = bands[begin]
                if same[:SLOTS].sum() >= LEAST * SLOTS and not (k and same[SLOTS : SLOTS + 8 * k].reshape(k, 8).all(1).any()):
                    out.append((keys[begin], keys[begin + 1], None))
                continue
            left, right, whole = _sides(pdf.iloc[begin:end])
            pairs = np.zeros((0, 2), np.int64)
            if len(left) and len(right):
                est, ok = _close(sigs[begin:end], bands[begin], left, right)
                if whole:
                    np.fill_diagonal(ok, False)
                est = np.where(ok, est, -1)
                i, j = np.flatnonzero(ok.any(1)), np.flatnonzero(ok.any(0))
                pairs = np.concatenate([np.stack([left[i], right[est[i].argmax(1)]], 1), np.stack([left[est[:, j].argmax(0)], right[j]], 1)])
                pairs = np.unique(np.sort(pairs, 1), axis=0)
                further = ok.sum() // (2 if whole else 1) > len(pairs)
            if n[begin] > BLOCK or len(left) and len(right) and further:
                out.append((None, None, buckets[begin]))
            out += [(keys[begin + i], keys[begin + j], None) for i, j in pairs]
        a, b, bucket = zip(*out, strict=True) if out else ((), (), ())
        yield pd.DataFrame({"a": a, "b": b, "bucket": pd.array(bucket, dtype="Int64")})


def _crossing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows that have a close pair with a row of another class: those whose texts have to be compared."""
    for pdf, at in _groups(batches, ["bucket", "lo", "hi"]):
        keep = np.zeros(len(pdf), bool)
        for begin, end in zip(at[:-1], at[1:], strict=True):
            part = pdf.iloc[begin:end]
            comp = pd.factorize(part["comp"])[0]
            left, right, _ = _sides(part)
            if comp.max() > 0 and len(left) and len(right):
                _, ok = _close(part["sig"].tolist(), part["band"].iloc[0], left, right)
                ok &= comp[left][:, None] != comp[right][None, :]
                keep[begin + left[ok.any(1)]] = keep[begin + right[ok.any(0)]] = True
        if keep.any():
            yield pdf[keep]


def _linked(frequencies: Broadcast, threshold: float):
    """All close pairs of two classes, best first, compared in full unless they are connected by then: the links found."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for pdf, at in _groups(batches, ["bucket", "lo", "hi"]):
            for begin, end in zip(at[:-1], at[1:], strict=True):
                part = pdf.iloc[begin:end].reset_index(drop=True)
                comp = pd.factorize(part["comp"])[0]
                left, right, whole = _sides(part)
                if comp.max() == 0 or not len(left) or not len(right):
                    continue
                est, ok = _close(part["sig"].tolist(), part["band"].iloc[0], left, right)
                ok &= comp[left][:, None] != comp[right][None, :]
                i, j = np.nonzero(np.triu(ok, 1) if whole else ok)
                if not len(i):
                    continue
                order = np.argsort(-est[i, j], kind="stable")
                i, j = left[i[order]], right[j[order]]
                e, d, tf = _bags(words, part["text"].tolist())
                w = tf * frequencies.value.weights(e)
                cut = np.searchsorted(d, np.arange(len(part) + 1))
                total = np.bincount(d, w, len(part))
                by = np.argsort(e, kind="stable")
                se, sd, sw = e[by], d[by], w[by]

                def alike(x: int) -> np.ndarray:
                    """The similarity of row x to every row."""
                    own, weight = e[cut[x] : cut[x + 1]], w[cut[x] : cut[x + 1]]
                    first, last = np.searchsorted(se, own), np.searchsorted(se, own, side="right")
                    size = last - first
                    where = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                    both = np.bincount(sd[where], np.minimum(sw[where], np.repeat(weight, size)), len(part))
                    return both / np.maximum(total[x] + total - both, 1e-12)

                root = list(range(comp.max() + 1))

                def top(c: int) -> int:
                    while root[c] != c:
                        root[c] = root[root[c]]
                        c = root[c]
                    return c

                # A pair is looked up from its side with more such pairs, so few rows are compared with all others.
                times = np.bincount(np.concatenate([i, j]), minlength=len(part))
                found, keys, out = {}, part["key"].tolist(), []
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    a, b = top(comp[x]), top(comp[y])
                    if a != b:
                        x, y = (x, y) if (times[x], -x) >= (times[y], -y) else (y, x)
                        if x not in found:
                            if len(found) > 4096:
                                found.clear()
                            found[x] = alike(x)
                        if found[x][y] >= threshold - 1e-9:
                            root[max(a, b)] = min(a, b)
                            out.append((keys[x], keys[y]))
                if out:
                    yield pd.DataFrame(out, columns=["a", "b"])

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    """Groups of (bucket, lo, hi) whole and sorted in one partition each."""
    return rows.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "key")


def _place(n: Column) -> Column:
    return F.pmod(F.xxhash64("key", "bucket"), F.greatest(n, F.lit(1)).cast("long")).cast("int")


def _first_blocks(members: DataFrame) -> DataFrame:
    """Each block of a bucket with itself and with the next."""
    rows = members.withColumn("k", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("blk", _place(F.col("k")))
    partners = F.array_distinct(F.array("blk", F.pmod(F.col("blk") + 1, F.col("k")), F.pmod(F.col("blk") - 1, F.col("k"))))
    return rows.withColumn("with", F.explode(partners)).withColumn("lo", F.least("blk", "with")).withColumn("hi", F.greatest("blk", "with"))


def _further_blocks(members: DataFrame, comps: DataFrame) -> DataFrame:
    """The buckets that hold two classes. Texts of a bucket's largest class fill blocks 0 to m - 1 and the rest blocks m
    to m + k - 1; the former aren't compared with each other."""
    rows = members.drop("n").join(comps, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    by = rows.groupBy("bucket", "comp").agg(F.count("*").alias("c"))
    sizes = by.groupBy("bucket").agg(F.sum("c").alias("n"), F.max("c").alias("most"), F.max_by("comp", F.struct("c", "comp")).alias("major")).where("n > most")
    m = F.when(F.col("n") <= BLOCK, 0).otherwise(F.ceil(F.col("most") / BLOCK)).cast("int")
    k = F.when(F.col("n") <= BLOCK, 1).otherwise(F.ceil((F.col("n") - F.col("most")) / BLOCK)).cast("int")
    rows = rows.join(sizes.withColumn("m", m).withColumn("k", k), "bucket")
    rows = rows.withColumn("blk", F.when((F.col("m") > 0) & (F.col("comp") == F.col("major")), _place(F.col("m"))).otherwise(F.col("m") + _place(F.col("k"))))
    last = F.col("m") + F.col("k") - 1
    partners = F.when(F.col("blk") < F.col("m"), F.sequence(F.col("m"), last)).otherwise(F.sequence(F.lit(0), last))
    return rows.withColumn("with", F.explode(partners)).withColumn("lo", F.least("blk", "with")).withColumn("hi", F.greatest("blk", "with"))


def similar(pairs: DataFrame, texts: DataFrame, shared: Broadcast, threshold: float) -> DataFrame:
    """The pairs a, b whose texts have at least this weighted Jaccard similarity."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for pdf in batches:
            for k in range(0, len(pdf), CHUNK):
                part = pdf.iloc[k : k + CHUNK]
                own = list(dict.fromkeys([*part["text_a"], *part["text_b"]]))
                e, d, tf = _bags(words, own)
                w = tf * shared.value.weights(e)
                cut = np.searchsorted(d, np.arange(len(own) + 1))
                at = {t: i for i, t in enumerate(own)}
                keep = []
                for x, y in zip(part["text_a"], part["text_b"], strict=True):
                    i, j = at[x], at[y]
                    ei, ej, wi, wj = e[cut[i] : cut[i + 1]], e[cut[j] : cut[j + 1]], w[cut[i] : cut[i + 1]], w[cut[j] : cut[j + 1]]
                    _, p, q = np.intersect1d(ei, ej, assume_unique=True, return_indices=True)
                    both = np.minimum(wi[p], wj[q]).sum()
                    keep.append(both >= (threshold - 1e-9) * (wi.sum() + wj.sum() - both))
                yield part.loc[keep, ["a", "b"]]

    a, b = (texts.select(F.col("key").alias(c), F.col("text").alias(f"text_{c}")) for c in ("a", "b"))
    return pairs.join(a, "a").join(b, "b").mapInPandas(check, "a binary, b binary")


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of one partition's edges key, comp: each node with the smallest node it is connected to here, and whether that is
    news. Connected components stay the same, and no node has two rows."""
    root: dict[bytes, bytes] = {}
    given: dict[bytes, bytes] = {}
    changed: set[bytes] = set()

    def top(x: bytes) -> bytes:
        y = x
        while (z := root.setdefault(y, y)) != y:
            y = z
        while root[x] != y:
            root[x], x = y, root[x]
        return y

    for pdf in batches:
        for x, m, news in zip(pdf["key"], pdf["comp"], pdf["news"], strict=True):
            if given.setdefault(x, m) != m or news:
                changed.add(x)
            a, b = top(x), top(m)
            if a != b:
                root[max(a, b)] = min(a, b)
    rows = [(x, y, x in changed or given.get(x) != y) for x in root if (y := top(x)) != x]
    for k in range(0, len(rows), 100_000):
        yield pd.DataFrame(rows[k : k + 100_000], columns=["key", "comp", "news"])


_EDGES = "key binary, comp binary, news boolean"


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """key, comp: the smallest key of the component, for every key of the edges (key, comp) but the smallest ones.

    Each partition contracts its edges to stars around its smallest keys. Then in rounds every edge moves on to where its
    comp is linked to, which halves the ways left, and the edges of one key meet in a partition and are contracted, until
    all are stars. A key has at most one row for each partition, and none of its own in the end, so none is hot."""
    now = scratch.staged(edges.select("key", "comp", F.lit(False).alias("news")).mapInPandas(_contract, _EDGES))
    while True:
        up = now.select(F.col("key").alias("comp"), F.col("comp").alias("up"))
        moved = now.select("key", "comp").join(up, "comp", "left").select("key", F.coalesce("up", "comp").alias("comp"), F.col("up").isNotNull().alias("news"))
        now = scratch.staged(moved.repartition("key").mapInPandas(_contract, _EDGES))
        if not now.where("news").limit(1).count():
            return now.select("key", "comp")


def _texts(docs: DataFrame) -> DataFrame:
    """key, doc_id (the smallest), n (documents) and text: a row for each distinct text."""
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    return rows.groupBy(_key(F.col("text")).alias("key")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.first("text").alias("text"))


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def text_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """key, class_id, first: the class of each distinct text, and whether it stands for its class. Written when this returns."""
    with Scratch(docs.sparkSession) as scratch:
        texts = scratch.staged(_texts(docs))
        shared = scratch.broadcast(frequencies(texts))
        sketches = scratch.staged(sketched(texts, shared))
        bands = sketches.select("key", F.posexplode("bands").alias("band", "h")).select("key", "band", F.xxhash64("band", "h").alias("bucket"))
        sizes = scratch.staged(bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
        members = scratch.staged(bands.join(sizes, "bucket").join(sketches.select("key", "sig"), "key"))
        columns = ["bucket", "lo", "hi", "blk", "n", "key", "band", "sig"]
        first = scratch.staged(_dealt(_first_blocks(members).select(*columns)).mapInPandas(_nearest, "a binary, b binary, bucket long"))
        bodies = texts.select("key", "text")
        edge = lambda pairs: pairs.select(F.greatest("a", "b").alias("key"), F.least("a", "b").alias("comp"))
        comps = components(edge(similar(first.where("a is not null").select("a", "b").distinct(), bodies, shared, threshold)), scratch)
        still = members.join(first.where("bucket is not null").select("bucket").distinct(), "bucket")
        rows = _dealt(_further_blocks(still, comps).select(*columns, "comp"))
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        crossing = scratch.staged(rows.mapInPandas(_crossing, schema)).join(bodies, "key")
        more = scratch.staged(_dealt(crossing).mapInPandas(_linked(shared, threshold), "a binary, b binary"))
        if more.limit(1).count():
            comps = components(comps.unionByName(edge(more)), scratch)
        named = texts.select("key", "doc_id").join(comps, "key", "left").select("key", "doc_id", F.coalesce("comp", "key").alias("comp"))
        of = named.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "key")).alias("m"))
        return staged(named.join(of, "comp").select("key", "class_id", (F.col("key") == F.col("m.key")).alias("first")))


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id for each row of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = rows.where(F.col("text").isNotNull()).select("doc_id", _key(F.col("text")).alias("key"))
    found = keyed.join(text_classes(docs, threshold), "key").select("doc_id", "class_id")
    return found.union(rows.where(F.col("text").isNull()).select("doc_id", F.col("doc_id").alias("class_id")))


def distinct_documents(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs but one row of each class, with all their columns: one of its smallest doc_id (null ones last)
    whose text is the smallest by hash. Every row with a null text stays."""
    key, lone = unused(docs, "key"), unused(docs, "without")
    first = text_classes(docs, threshold).where("first").select(F.col("key").alias(key), F.col("class_id").alias(lone))
    rows = docs.where(F.col("text").isNotNull()).withColumn(key, _key(F.col("text").cast("string")))
    same = (rows[key] == first[key]) & rows["doc_id"].cast("long").eqNullSafe(first[lone])
    return rows.join(first, same, "left_semi").dropDuplicates([key]).drop(key).unionByName(docs.where(F.col("text").isNull()))
