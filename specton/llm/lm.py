"""Masked pseudo-likelihood of documents under a bidirectional window network.

Words are counted over all documents. The most frequent ones are the vocabulary, the rest one unknown word; words are
split into classes of about equal mass. The network sees WINDOW words on both sides of each position, not the word
itself, and predicts the word: a softmax over classes, and one over the words of the class, both from the hidden state.
Every document trains it, in one of ROUNDS rounds by a hash: documents are dealt to replicas by a hash too, each replica is trained
in numpy on its documents in order of another hash, and the replicas' mean, weighted by words, is the start of the next
round. A document's score is the sum over its words of log P(word | both sides), and that sum by word.

Counts and training read all documents; the vocabulary, its classes and the network have a fixed size. There is a replica for
every ``SHARE`` words, up to ``REPLICAS``: their number, documents and order depend on the corpus alone, so scores don't
depend on how the table is partitioned. Words beyond the VOCABULARY most frequent ones share one id as context, and as
targets the probability of the unknown word in equal parts.

Defined results: a null text, or one without words, has no words and score 0; repeated rows are counted and scored each;
an empty table gives no rows. Columns of the caller are kept, added ones of the same name replace them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specton.llm.common import Scratch, Words, small_batches, unused

VOCABULARY = 8192
CLASSES = 96
WINDOW = 2
HIDDEN = 24
ROUNDS = 2
#: Sums up to which exponentials, their sums and products keep full precision.
REACH = 60.0
BATCH = 4096
CHUNK = 300
#: First bits of a hash by which words are looked up, and products that a block of classes may have too many at least.
SLOT, FILL = 17, 4096
#: Words of a replica, and replicas at most: beyond, each has more words, and their weights stay under 20 GB a round.
SHARE, REPLICAS = 1 << 22, 4096


@dataclass
class Vocabulary:
    """Word hashes sorted for look-up, with id, class and log P(word | class) of each; id 0 is the unknown word, 1 the edge."""

    hashes: np.ndarray
    ids: np.ndarray
    classes: np.ndarray
    within: np.ndarray
    #: Words of the corpus.
    total: int = 0

    def __post_init__(self) -> None:
        #: Ids are in order of class: where each class begins.
        self.starts = np.searchsorted(self.classes, np.arange(CLASSES + 1))
        #: Where the hashes with each beginning of SLOT bits begin.
        self.slots = np.searchsorted(self.hashes >> np.uint64(64 - SLOT), np.arange((1 << SLOT) + 1, dtype=np.uint64)).astype(np.int32)
        sizes = np.diff(self.starts)
        #: A row a class: its words, filled up with VOCABULARY; and which of its class each word is.
        self.members = np.where(np.arange(max(sizes)) < sizes[:, None], self.starts[:-1, None] + np.arange(max(sizes)), VOCABULARY).astype(np.int32)
        self.nth = np.arange(len(self.classes)) - self.starts[self.classes]

    def blocks(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Classes of several words that are among the ids, some at once that are alike in words and in places. A row a class:
        its places (``len(ids)`` fills up), its words (``VOCABULARY`` fills up), and where in an array of class, word and place
        the word of each place is."""
        kinds = self.classes.take(ids).astype(np.uint16)  # of so few bits, numpy sorts by radix
        order, nth = np.append(np.argsort(kinds, kind="stable"), len(ids)), np.append(self.nth.take(ids), 0)
        found, sizes = np.bincount(kinds, minlength=CLASSES), np.diff(self.starts)
        cuts = np.cumsum(found) - found
        some = np.flatnonzero((found > 0) & (sizes > 1))
        some = some[np.argsort(sizes[some], kind="stable")]
        begins, wide, area = [], 0, 0
        for k, (n, size) in enumerate(zip(found[some].tolist(), sizes[some].tolist(), strict=True)):
            wide, area = max(wide, n), area + n * size
            # What fills up is at most half of what a block has, or little.
            if not begins or (k + 1 - begins[-1]) * wide * size > area + max(area // 2, FILL):
                begins.append(k)
                wide, area = n, n * size
        for a, b in pairwise([*begins, len(some)]):
            block, size = some[a:b], sizes[some[b - 1]]
            n = found[block][:, None]
            place = np.arange(n.max())
            # Beyond the end of the order is what fills up.
            places = order.take(np.where(place < n, cuts[block][:, None] + place, len(ids)))
            wanted = nth.take(places)
            wanted += np.arange(0, size * (b - a), size)[:, None]
            wanted *= len(place)
            wanted += place
            yield places, self.members[block, :size], wanted

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int32)
        slot = (hashes >> np.uint64(64 - SLOT)).astype(np.intp)
        at = self.slots[slot]
        # Few slots have more than one hash; only what isn't the first one is searched for.
        other = np.flatnonzero(self.slots[slot + 1] - at > 1)
        at[other] = np.searchsorted(self.hashes, hashes[other])
        at = np.minimum(at, len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.ids[at], 0).astype(np.int32)


def vocabulary(docs: DataFrame, size: int = VOCABULARY) -> Vocabulary:
    """Counts of all words of all documents; the top words and the totals of the rest come to the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for pdf in batches:
            for k in range(0, len(pdf), 2000):
                h, n = np.unique(words(pdf["text"].iloc[k : k + 2000].tolist())[0], return_counts=True)
                yield pd.DataFrame({"h": h.astype(np.int64), "n": n})

    with Scratch(docs.sparkSession) as scratch:
        counts = scratch.staged(small_batches(docs).select("text").where(F.col("text").isNotNull()).mapInPandas(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
        total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("kinds")).first()
        top = counts.orderBy(F.desc("n"), "h").limit(size - 2).toArrow().to_pandas()
    n = top["n"].to_numpy(float)
    rest, kinds = max(float(total["n"]) - n.sum(), 1.0), max(total["kinds"] - len(top), 1)
    mass = np.concatenate([[rest, 1.0], n])
    root = np.sqrt(mass[1:])
    classes = np.concatenate([[0], 1 + np.minimum((np.cumsum(root) / root.sum() * (CLASSES - 1)).astype(int), CLASSES - 2)]).astype(np.int32)
    per_class = np.bincount(classes, mass, CLASSES)
    within = np.log(mass / per_class[classes])
    within[0] = -np.log(kinds)
    h = top["h"].to_numpy(np.int64).astype(np.uint64)
    order = np.argsort(h)
    return Vocabulary(h[order], (2 + order).astype(np.int32), classes, within.astype(np.float32), int(total["n"]))


def _contexts(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each word the ids at each place around it; the edge beyond a document's ends."""
    place = np.arange(len(ids))
    begin, end = np.repeat(bounds[:-1], np.diff(bounds)), np.repeat(bounds[1:], np.diff(bounds))
    out = np.empty((len(ids), 2 * WINDOW), np.int32)
    for k, d in enumerate([*range(-WINDOW, 0), *range(1, WINDOW + 1)]):
        at = place + d
        inside = (at >= begin) & (at < end)
        out[:, k] = np.where(inside, ids[np.clip(at, 0, max(len(ids) - 1, 0))], 1)
    return out


def _far(weights: np.ndarray, bias: np.ndarray | float = 0.0) -> bool:
    """Whether a row's sum with hidden values, which lie between -1 and 1, may leave what exponentials of single precision take without
    their maximum taken off first."""
    return not (np.abs(weights) @ np.ones(weights.shape[1], np.float32) + np.abs(bias)).max() <= REACH


def _inputs(h: np.ndarray) -> np.ndarray:
    """Hidden values and a 1 for the bias; the last row is no place, all 0."""
    out = np.zeros((len(h) + 1, HIDDEN + 1), np.float32)
    out[:-1, :HIDDEN], out[:-1, HIDDEN] = h, 1
    return out


class Network:
    """A table of hidden inputs for each word at each place, tanh, a softmax over classes and one over a class's words."""

    def __init__(self, flat: np.ndarray | None = None) -> None:
        shapes = [(2 * WINDOW, VOCABULARY, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,), (VOCABULARY, HIDDEN + 1)]
        sizes = [int(np.prod(s)) for s in shapes]
        if flat is None:
            r = np.random.default_rng(5)
            flat = np.concatenate([r.normal(0, 0.1, sizes[0]), np.zeros(sizes[1]), r.normal(0, 0.1, sizes[2]), np.zeros(sum(sizes[3:]))]).astype(np.float32)
        #: The last table has a row a word: HIDDEN weights and a bias.
        self.flat = flat
        cuts = np.cumsum(sizes)[:-1]
        self.table, self.bias, self.out, self.out_bias, self.words = (p.reshape(s) for p, s in zip(np.split(flat, cuts), shapes, strict=True))
        #: The classes' weights and, next to them, biases as one table.
        self.output = flat[cuts[1] : cuts[3]].reshape(HIDDEN + 1, CLASSES)

    def hidden(self, context: np.ndarray) -> np.ndarray:
        h = self.table[0].take(context[:, 0], axis=0)
        for k in range(1, 2 * WINDOW):
            h += self.table[k].take(context[:, k], axis=0)
        h += self.bias
        return np.tanh(h, out=h)

    def word_rows(self, v: Vocabulary) -> np.ndarray:
        """A row a word: its weights, and then what it has without any context. The last row is no word: its exponential is 0."""
        words = np.zeros((VOCABULARY + 1, HIDDEN + 1), np.float32)
        words[:-1] = self.words
        words[: len(v.within), HIDDEN] += v.within
        words[-1, HIDDEN] = -1e30
        return words

    def log_probabilities(self, context: np.ndarray, ids: np.ndarray, v: Vocabulary) -> np.ndarray:
        inputs = _inputs(self.hidden(context))
        z = inputs[:-1] @ self.output
        if _far(self.out.T, self.out_bias):
            z -= z.max(1, keepdims=True)
        out = z[np.arange(len(z)), v.classes[ids]]
        np.exp(z, out=z)
        out -= np.log(z @ np.ones(CLASSES, np.float32))
        out[ids == 0] += v.within[0]
        words, inner = self.word_rows(v), np.zeros(len(inputs), np.float32)
        far = _far(words[:-1])
        for places, rows, wanted in v.blocks(ids):
            z = words.take(rows, axis=0) @ inputs.take(places, axis=0).transpose(0, 2, 1)
            if far:
                z -= z.max(1, keepdims=True)
            own = z.take(wanted)
            np.exp(z, out=z)
            inner[places] = own - np.log(np.ones(z.shape[1], np.float32) @ z)
        out += inner[:-1]
        return out

    def train(self, context: np.ndarray, ids: np.ndarray, v: Vocabulary, rate: float = 0.05) -> None:
        """One step on a batch, each weight (each row of the tables) slowed down by its squared gradients so far."""
        if not hasattr(self, "seen"):
            full = lambda shape: np.full(shape, 1e-6, np.float32)
            self.seen = [full((2 * WINDOW, VOCABULARY)), full(self.output.shape), full(self.words.shape)]
        n, rate = np.float32(len(context)), np.float32(rate)
        h = self.hidden(context)
        inputs = _inputs(h)
        p = inputs[:-1] @ self.output
        if _far(self.out.T, self.out_bias):
            p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        # Exponentials stay as they are: what is made of them is scaled, which is smaller.
        total = p @ np.ones(CLASSES, np.float32)
        p.reshape(-1)[np.arange(len(h)) * CLASSES + v.classes[ids]] -= total
        scale = 1 / (total * n)
        back = p @ self.out.T
        back *= scale[:, None]
        # Words of classes that the batch lacks have no gradient, so all words are updated at once.
        words, inner, grads = self.word_rows(v), [np.zeros((1, HIDDEN), np.float32)], [np.zeros((1, HIDDEN + 1), np.float32)]
        far = _far(words[:-1])
        # In which row of the blocks' gradients each place and each word is; the first is of none.
        place_at, word_at, places_before, words_before = np.zeros(len(inputs), np.intp), np.zeros(len(words), np.intp), 1, 1
        for places, rows, wanted in v.blocks(ids):
            own, x = words.take(rows, axis=0), inputs.take(places, axis=0)
            z = own @ x.transpose(0, 2, 1)
            if far:
                z -= z.max(1, keepdims=True)
            np.exp(z, out=z)
            z *= (1 / (n * (np.ones(z.shape[1], np.float32) @ z)))[:, None]
            z.reshape(-1)[wanted] -= 1 / n
            inner.append((z.transpose(0, 2, 1) @ own[:, :, :HIDDEN]).reshape(-1, HIDDEN))
            grads.append((z @ x).reshape(-1, HIDDEN + 1))
            place_at[places] = np.arange(places_before, places_before + places.size).reshape(places.shape)
            word_at[rows] = np.arange(words_before, words_before + rows.size).reshape(rows.shape)
            places_before, words_before = places_before + places.size, words_before + rows.size
        back += np.concatenate(inner).take(place_at[:-1], axis=0)
        grad = np.concatenate(grads).take(word_at[:-1], axis=0)
        for weights, grad, seen in [(self.output, np.vstack([(p.T @ (h * scale[:, None])).T, scale @ p]), self.seen[1]), (self.words, grad, self.seen[2])]:
            seen += grad * grad
            grad *= rate
            grad /= np.sqrt(seen)
            weights -= grad
        back *= 1 - h * h
        for k in range(2 * WINDOW):
            at = context[:, k].astype(np.uint16)  # of so few bits, numpy sorts by radix
            # Words that occur once come last: they need no sum.
            once = np.bincount(at, minlength=VOCABULARY) == 1
            order = np.argsort(at + VOCABULARY * once.take(at).astype(np.uint16), kind="stable")
            at, rows, several = at.take(order), back.take(order, axis=0), len(at) - int(once.sum())
            own, grad = at[several:], rows[several:]
            if several:
                first = np.flatnonzero(np.concatenate([[True], at[1:several] != at[: several - 1]]))
                # Two numbers as a complex one: half as many sums.
                sums = np.add.reduceat(rows[:several].view(np.complex64), first, axis=0).view(np.float32)
                own, grad = np.concatenate([at[first], own]), np.concatenate([sums, grad])
            seen = self.seen[0][k].take(own) + np.einsum("ij,ij->i", grad, grad) / np.float32(HIDDEN)
            self.seen[0][k, own] = seen
            grad *= (rate / np.sqrt(seen))[:, None]
            self.table[k, own] = self.table[k].take(own, axis=0) - grad


def fit(docs: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> Network:
    """Rounds of training of every replica on its share of the round and averaging, until every document has taken part.
    Blocks of the weights are averaged apart from each other."""
    with Scratch(docs.sparkSession) as scratch:
        return _rounds(docs.where(F.col("text").isNotNull()), vocab, rounds, scratch)


def _rounds(docs: DataFrame, vocab: Vocabulary, rounds: int, scratch: Scratch) -> Network:
    words, net, piece = scratch.broadcast(vocab), Network(), 1 << 14
    replicas = max(1, min(REPLICAS, -(-vocab.total // SHARE)))
    for number in range(rounds):
        start = scratch.broadcast(net.flat)
        dealt = docs.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(23)), F.lit(rounds)) == number).select("text", F.xxhash64("doc_id", "text", F.lit(29)).alias("h"))
        # Rows of one hash are the same document, so their order is no matter.
        part = small_batches(dealt.withColumn("part", F.pmod(F.xxhash64("h", F.lit(31)), F.lit(replicas)).cast("int")).repartitionById(replicas, "part").sortWithinPartitions("part", "h"))

        def train(batches: Iterator[pd.DataFrame], start=start, number=number) -> Iterator[pd.DataFrame]:
            own, v, hashed, n, now = Network(start.value.copy()), words.value, Words(), 0, None

            def made() -> Iterator[pd.DataFrame]:
                if n:
                    flat = own.flat.astype(np.float32)
                    cut = [flat[i : i + piece] for i in range(0, len(flat), piece)]
                    yield pd.DataFrame({"block": range(len(cut)), "n": n, "w": [c.tobytes() for c in cut], "part": np.int32(now)})

            for pdf in batches:
                for which, rows in pdf.groupby("part", sort=True):
                    if now is not None and which != now:
                        yield from made()
                        own, n = Network(start.value.copy()), 0
                    now = which
                    texts = rows["text"].tolist()
                    for k in range(0, len(texts), CHUNK):
                        h, bounds = hashed(texts[k : k + CHUNK])
                        ids = v.of(h)
                        context = _contexts(ids, bounds)
                        mixed = np.random.default_rng(number).permutation(len(ids))
                        for b in range(0, len(ids), BATCH):
                            at = mixed[b : b + BATCH]
                            own.train(context[at], ids[at], v)
                        n += len(ids)
            yield from made()

        def mean(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("part")
            w = pdf["n"].to_numpy(float)
            total = sum(x * np.frombuffer(b, np.float32).astype(float) for x, b in zip(w, pdf["w"], strict=True))
            return pd.DataFrame({"block": [pdf["block"].iloc[0]], "n": [int(w.sum())], "w": [(total / w.sum()).astype(np.float32).tobytes()]})

        schema = "block long, n long, w binary"
        # Means of means: no group holds more than some 16 replicas' blocks, however many there are.
        made, parts = scratch.staged(part.mapInPandas(train, f"{schema}, part int")), replicas
        while parts > 16:
            groups = -(-parts // 16)
            made = scratch.staged(made.withColumn("to", F.pmod("part", F.lit(groups))).groupBy("block", "to").applyInPandas(lambda key, pdf: mean(pdf).assign(part=int(key[1])), f"{schema}, part int"))
            parts = groups
        got = made.groupBy("block").applyInPandas(mean, schema).toArrow().sort_by("block")
        if len(got):
            net = Network(np.frombuffer(b"".join(got["w"].to_pylist()), np.float32).copy())
    return net


def score(docs: DataFrame, vocab: Vocabulary, net: Network, text: str = "text") -> DataFrame:
    """The input with n_words, log_likelihood (the sum over words) and mean_log_likelihood (by word, null without)."""
    sc = docs.sparkSession.sparkContext
    words, weights = sc.broadcast(vocab), sc.broadcast(net.flat)

    def run(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashed, v, own = Words(), words.value, Network(weights.value)
        for s in columns:
            n, total = np.zeros(len(s), np.int64), np.zeros(len(s))
            for k in range(0, len(s), CHUNK):
                h, bounds = hashed([t if isinstance(t, str) else None for t in s.iloc[k : k + CHUNK]])
                ids = v.of(h)
                context = _contexts(ids, bounds)
                each = np.concatenate([np.zeros(0), *[own.log_probabilities(context[b : b + 8192], ids[b : b + 8192], v) for b in range(0, len(ids), 8192)]])
                sums = np.concatenate([[0.0], np.cumsum(each, dtype=float)])
                size = len(bounds) - 1
                n[k : k + size], total[k : k + size] = np.diff(bounds), sums[bounds[1:]] - sums[bounds[:-1]]
            mean = pd.array(np.where(n > 0, total / np.maximum(n, 1), 0.0), dtype="Float64")
            mean[n == 0] = pd.NA
            yield pd.DataFrame({"n_words": n, "log_likelihood": total, "mean_log_likelihood": mean})

    likelihood = F.pandas_udf(run, "n_words long, log_likelihood double, mean_log_likelihood double")
    added = ("n_words", "log_likelihood", "mean_log_likelihood")
    columns = [c for c in docs.columns if c not in added]
    own = unused(docs, "likelihood")
    return small_batches(docs).select(*columns, likelihood(F.col(text).cast("string")).alias(own)).select(*columns, *[f"{own}.{c}" for c in added])
