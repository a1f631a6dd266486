"""SimHash near-duplicates by covering anchors: all links within the radius, and their connected components.

A fingerprint has a bit for each of 64 positions, set where over half of a text's shingle hashes have it. Anchors are the
words of a covering code: the binary Golay code, of which every 23-bit value has exactly one word within ``COVER`` bits. A
fingerprint is at home with the anchor nearest its first 23 bits and visits every anchor within ``COVER + RADIUS`` bits.
Two fingerprints within ``RADIUS`` bits of each other thus meet at the home of either one, so each anchor compares the
fingerprints at home there with all that visit, and no pair is lost.

Equal fingerprints are one row from the start. An anchor with more than ``PAIRS`` comparisons deals its rows to anchors once
more by the next 23 bits, and then by the last 18, where a visit may stray only by what earlier bits have left of the radius.
With ``DEEP`` fingerprints and more all anchors start with two windows. What is dense after the last window is compared
in chunks. An anchor gives only the links that connect something new there, not all its pairs.

Defined results: null and empty texts and those without words have fingerprint zero, which links like any other; a text of fewer
words than a shingle is one shingle; repeated rows each have their row; component_id is the smallest doc_id that
is reachable, null if all are null. Extra columns are not read, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specton.llm.common import Scratch, small_batches, staged
from specton.llm.neardup import components

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Covering radius, length and generator polynomial of the code; words of the code are multiples of the polynomial.
COVER, BITS, GENERATOR = 3, 23, 0xC75
#: Where the windows of a fingerprint begin; what is beyond bit 63 counts as zero.
WINDOWS = (0, 23, 46)
#: Comparisons of an anchor before it is dealt on, fingerprints from which all anchors start with two windows, rows of a chunk.
PAIRS, DEEP, CHUNK = 1 << 26, 1 << 24, 8192
#: Hashes whose bits are counted at once.
RUN = 1 << 15


def fingerprint(text: bytes | None, n: int = SHINGLE) -> int:
    """The 64 bits of a text: words are runs of anything but ASCII white space, A-Z in lower case."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined, sizes = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(sizes + 1) - 1
    n = min(n, len(words))
    first, last = (end - sizes)[: len(words) - n + 1].tolist(), end[n - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for k in range(0, len(first), RUN):
        h = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(first[k : k + RUN], last[k : k + RUN], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(first), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the 64 bits as a long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            fp = np.array([fingerprint(x.as_py()) for x in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return small_batches(rows).mapInArrow(run, "doc_id long, fp long")


@cache
def _remainders() -> tuple[np.ndarray, np.ndarray]:
    """Remainders by the generator of values that have only their lowest 12, or highest 11, bits."""
    halves = np.arange(1 << 12, dtype=np.int64), np.arange(1 << 11, dtype=np.int64) << 12
    for rest in halves:
        for bit in range(BITS - 1, 10, -1):
            rest ^= (rest >> bit & 1) * (GENERATOR << (bit - 11))
    return halves


def _rest(values: np.ndarray) -> np.ndarray:
    low, high = _remainders()
    v = values.astype(np.int64)
    return low[v & 0xFFF] ^ high[v >> 12]


@cache
def _patterns() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The error patterns of up to COVER + RADIUS bits by remainder and weight: where those of a remainder begin, the patterns,
    and their weights. A value without any pattern of its own remainder is a word of the code."""
    weight = np.bitwise_count(np.arange(1 << BITS, dtype=np.uint32))
    near = np.flatnonzero(weight <= COVER + RADIUS)
    rest = _rest(near)
    order = np.lexsort((near, weight[near], rest))
    near = near[order]
    return np.searchsorted(rest[order], np.arange((1 << 11) + 1)), near.astype(np.uint64), weight[near].astype(np.int64)


def _window(fp: np.ndarray, level: int) -> np.ndarray:
    return (fp >> np.uint64(WINDOWS[level])) & np.uint64((1 << BITS) - 1)


def _visits(bits: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For window values and what is left of the radius: the row, the anchor and the errors beyond COVER of every visit."""
    begin, patterns, weights = _patterns()
    r = _rest(bits)
    size = begin[r + 1] - begin[r]
    row = np.repeat(np.arange(len(bits)), size)
    at = np.repeat(begin[r] - np.cumsum(size) + size, size) + np.arange(len(row))
    over = np.maximum(weights[at] - COVER, 0)
    keep = over <= left[row]
    return row[keep], bits[row[keep]] ^ patterns[at[keep]], over[keep]


def _home(bits: np.ndarray) -> np.ndarray:
    """The only anchor within COVER: that of the lightest pattern."""
    begin, patterns, _ = _patterns()
    return bits ^ patterns[begin[_rest(bits)]]


_ROWS = "anchor binary, fp long, home boolean, spare int"


def dealt(rows: DataFrame, level: int) -> DataFrame:
    """Rows (anchor, fp, home, spare) dealt on by a window: spare is what is left of the radius there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), CHUNK):
                part = pdf.iloc[k : k + CHUNK]
                fp = part["fp"].to_numpy().view(np.uint64)
                bits = _window(fp, level)
                row, anchor, over = _visits(bits, part["spare"].to_numpy())
                own = _home(bits)
                before, word = part["anchor"].to_numpy(object), anchor.astype("<u4").tobytes()
                yield pd.DataFrame({
                    "anchor": [before[i] + word[4 * j : 4 * j + 3] for j, i in enumerate(row.tolist())], "fp": part["fp"].to_numpy()[row],
                    "home": part["home"].to_numpy(bool)[row] & (anchor == own[row]), "spare": (part["spare"].to_numpy()[row] - over).astype(np.int32),
                })

    return rows.mapInPandas(run, _ROWS)


def _links(home: np.ndarray, all_: np.ndarray) -> list[tuple[int, int]]:
    """Links within the radius between fingerprints at home and all others that connect something new."""
    values = np.unique(np.concatenate([home, all_]))
    label, out = np.arange(len(values)), []
    every = np.searchsorted(values, np.unique(all_))
    others = values[every]
    for x, i in zip(home, np.searchsorted(values, home).tolist(), strict=True):
        near = every[np.bitwise_count(others ^ x) <= RADIUS]
        labels, first = np.unique(label[near], return_index=True)
        for other, j in zip(labels.tolist(), near[first].tolist(), strict=True):
            if other != label[i]:
                out.append((int(values[i]), int(values[j])))
                label[label == other] = label[i]
    return out


def compared(rows: DataFrame) -> DataFrame:
    """a, b: the links found at each anchor. Rows of an anchor are compared where they lie, sorted, one anchor after the other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, anchor = [], None
        for pdf in [*batches, None]:
            if pdf is not None and not len(pdf):
                continue
            names = pdf["anchor"].to_numpy(object) if pdf is not None else np.array([None], object)
            cut = np.concatenate([[0], np.flatnonzero(names[1:] != names[:-1]) + 1, [len(names)]])
            for low, high in zip(cut[:-1], cut[1:], strict=True):
                if names[low] != anchor:
                    if held:
                        fp, home = (np.concatenate(x) for x in zip(*held, strict=True))
                        if found := _links(np.unique(fp[home]), fp):
                            yield pd.DataFrame(np.array(found, np.uint64).view(np.int64), columns=["a", "b"])
                    held, anchor = [], names[low]
                if pdf is not None:
                    held.append((pdf["fp"].to_numpy()[low:high].view(np.uint64), pdf["home"].to_numpy(bool)[low:high]))

    return rows.repartition("anchor").sortWithinPartitions("anchor").select("anchor", "fp", "home").mapInPandas(run, "a long, b long")


def _sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("anchor").agg(F.count("*").alias("n"), F.count_if("home").alias("own"))


def _chunks(rows: DataFrame, dense: DataFrame) -> DataFrame:
    """Anchors that no window is left for: every chunk of those at home with every chunk of all."""
    count = lambda c: F.greatest(F.ceil(F.col(c) / CHUNK), F.lit(1)).cast("int")
    deal = lambda c: F.pmod(F.xxhash64("fp"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = rows.join(dense.select("anchor", count("own").alias("h"), count("n").alias("v")), "anchor")
    name = lambda i, j: F.concat("anchor", F.encode(F.concat_ws("/", F.lit(""), i, j), "utf-8"))
    asks = own.where("home").withColumn("i", deal("h")).withColumn("j", every("v")).select(name("i", "j").alias("anchor"), "fp", "home")
    visits = own.withColumn("j", deal("v")).withColumn("i", every("h")).select(name("i", "j").alias("anchor"), "fp", F.lit(False).alias("home"))
    return asks.unionByName(visits)


def links(distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b: links that connect whatever is within RADIUS. distinct: fp, each once. Written when this returns."""
    start = distinct.select(F.lit(b"").alias("anchor"), "fp", F.lit(True).alias("home"), F.lit(RADIUS).alias("spare"))
    level, rows = 1, dealt(start, 0)
    if distinct.count() >= DEEP:
        level, rows = 2, dealt(rows, 1)
    found = None
    while True:
        rows = scratch.staged(rows)
        sizes = scratch.staged(_sizes(rows).where((F.col("own") > 0) & (F.col("n") > 1)))
        is_dense = F.col("own") * F.col("n") > PAIRS
        dense = sizes.where(is_dense)
        part = scratch.staged(compared(rows.join(sizes.where(~is_dense).select("anchor"), "anchor", "left_semi")))
        found = part if found is None else found.unionByName(part)
        if not dense.limit(1).count():
            return found
        if level == len(WINDOWS):
            return found.unionByName(scratch.staged(compared(_chunks(rows, dense))))
        rows = dealt(rows.join(dense.select("anchor"), "anchor", "left_semi"), level)
        level += 1


def _hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id for each row of docs (doc_id, text)."""
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.staged(fingerprints(docs))
        distinct = scratch.staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
        key = lambda c: F.unhex(_hex(F.col(c)))
        found = links(distinct.select("fp"), scratch).where("a <> b")
        edges = found.select(F.greatest(key("a"), key("b")).alias("key"), F.least(key("a"), key("b")).alias("comp"))
        named = distinct.withColumn("key", key("fp")).join(components(edges, scratch), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
        least = named.groupBy("comp").agg(F.min("first").alias("component_id"))
        classes = named.join(least, "comp").select("fp", "component_id")
        return staged(rows.join(classes, "fp").select("doc_id", _hex(F.col("fp")).alias("fingerprint"), "component_id"))
