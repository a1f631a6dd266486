"""Best-fit packing of documents into fixed-length training sequences, improved by a swap-based local search.

A document becomes the ids of its whole text and an end id. One longer than a sequence is cut into full pieces from
its end, so only the first piece may be shorter. Pieces are dealt by a hash, of their place in the table too, to shards of a bounded size; in each shard
best-fit decreasing gives the first bins, and a local search moves one piece, exchanges one for one or one for two
between underfull bins. Every exchange makes the fuller bin fuller, so the sum of squared fills rises until a bin is
empty, nothing improves, or the count meets the lower bound ceil(total / size).

Defined results: a null or empty text is the end id alone; repeated rows are packed once each; an empty table gives no
rows; ties of length go to the smaller doc_id, piece. Extra columns of the input are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specton.llm.common import small_batches, staged

SIZE = 1024
END = 2
#: Pieces of a shard, on average: the size of one packing task, whatever the table's size.
SHARD = 16_384
#: Emptiest bins that a round of the local search tries to empty before it ends: it bounds the time a shard takes. On sf0.1
#: the result is one sequence over the lower bound of the whole table.
TRIES = 64
#: Distinct chunks whose ids one Python worker keeps.
CACHE = 400_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"

#: A space before another white-space character: only then can cutting a text before its spaces change its ids.
_AWKWARD = re.compile(r" \s")


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level BPE files write for bytes: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts as little-endian bytes, by a byte-level BPE file of ``tokenizers``.

    Byte-level BPE takes a text apart before each space that a visible character follows, so the ids of those chunks
    are looked up in a cache. New ones are merged by ``tiktoken`` with the vocabulary of that same file, which gives the
    ids of ``tokenizers`` (tests hold them against each other) at a quarter of its time. Texts with a space before more
    white space are encoded whole. A special token's string in a text is that token, as ``tokenizers`` has it.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.bpe = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        self.width[list(ranks.values())] = [len(b) for b in ranks]
        self.known: dict[str, bytes] = {}
        self.special = {t: np.array([i], "<u4").tobytes() for t, i in special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def _learn(self, chunks: list[str]) -> None:
        """Encode chunks in one string; each begins with a space, so none runs into the next."""
        ids = np.array(self.bpe.encode_ordinary("".join(chunks)), "<u4")
        ends = np.cumsum(self.width[ids])
        cuts = np.searchsorted(ends, np.cumsum([len(c.encode()) for c in chunks])) + 1
        raw, at = ids.tobytes(), 0
        for c, cut in zip(chunks, (4 * cuts).tolist(), strict=True):
            self.known[c] = raw[at:cut]
            at = cut

    def _whole(self, text: str) -> bytes:
        return np.array(self.bpe.encode_ordinary(text), "<u4").tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHE:
            self.known = {}
        out = []
        for t in texts:
            t = t if t.isascii() else t.encode("utf-8", "replace").decode()
            if self.cut and any(x in t for x in self.special):
                out.append(b"".join(self.special[x] if x in self.special else self._plain(x) for x in self.cut.split(t)))
            else:
                out.append(self._plain(t))
        return out

    def _plain(self, t: str) -> bytes:
        if not t or _AWKWARD.search(t):
            return self._whole(t)
        get = self.known.get
        first, *rest = t.split(" ")
        rest = [" " + x for x in rest]
        ids = list(map(get, rest))
        if None in ids:
            self._learn(list({c for c, x in zip(rest, ids, strict=True) if x is None}))
            ids = list(map(get, rest))
        return self._whole(first) + b"".join(ids)


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END) -> DataFrame:
    """One row for each piece of each document: where it starts, its length and the CRC-32 of its ids."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, tail = Encoder(tokenizer), np.array([end], "<u4").tobytes()
        for pdf in batches:
            for k in range(0, len(pdf), 500):
                rows = []
                part = pdf.iloc[k : k + 500]
                for doc_id, ids in zip(part["doc_id"], encode([t if isinstance(t, str) else "" for t in part["text"]]), strict=True):
                    ids += tail
                    n = len(ids) // 4
                    start = 0
                    for piece, stop in enumerate(range(n % size or size, n + 1, size)):
                        rows.append((doc_id, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                        start = stop
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(cut, PIECES)


def best_fit(lengths: list[int], size: int = SIZE) -> list[list[int]]:
    """Best-fit decreasing: each item, longest first, into the bin with the least room that holds it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    open_rooms = 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fits = open_rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms ^= 1 << room
            bins[b].append(i)
        else:
            room, b = size, len(bins)
            bins.append([i])
        if room > n:
            if not by_room[room - n]:
                open_rooms |= 1 << (room - n)
            by_room[room - n].append(b)
    return bins


def local_search(bins: list[list[int]], lengths: list[int], size: int = SIZE) -> list[list[int]]:
    """Moves and exchanges between underfull bins that raise the sum of squared fills, until bins empty."""
    total = sum(lengths)
    least = -(-total // size)
    fill = [sum(lengths[i] for i in b) for b in bins]
    live = sorted((fill[b], b) for b in range(len(bins)))

    def change(b: int, now: int) -> None:
        del live[bisect_left(live, (fill[b], b))]
        fill[b] = now
        if now:
            insort(live, (now, b))

    def improve(a: int) -> bool:
        """Make one other bin fuller at the cost of bin a."""
        for f, b in reversed(live):
            room = size - f
            if not room or b == a or f < fill[a]:
                continue
            for i in sorted(bins[a], key=lambda i: -lengths[i]):
                n = lengths[i]
                give: tuple[int, ...] | None = None
                if n <= room:
                    give = ()
                else:
                    own = sorted(bins[b], key=lambda j: lengths[j])
                    sizes = [lengths[j] for j in own]
                    k = bisect_left(sizes, n - room)
                    if k < len(own) and sizes[k] < n:
                        give = (own[k],)
                    else:
                        for x in range(len(own)):
                            y = bisect_left(sizes, n - room - sizes[x], lo=x + 1)
                            if y < len(own) and sizes[x] + sizes[y] < n:
                                give = (own[x], own[y])
                                break
                if give is None:
                    continue
                gained = n - sum(lengths[j] for j in give)
                bins[b] = [j for j in bins[b] if j not in give] + [i]
                bins[a] = [j for j in bins[a] if j != i] + list(give)
                change(b, f + gained)
                change(a, fill[a] - gained)
                return True
        return False

    while len(live) > least:
        if not any(improve(b) for _, b in list(live[:TRIES])):
            break
    return [b for b in bins if b]


def pack(rows: DataFrame, size: int = SIZE, shard: int = SHARD) -> DataFrame:
    """A sequence and a place in it for every piece. Gapless from 0 in each sequence; the rows are kept as they are."""
    rows = staged(rows)
    shards = -(-max(rows.count(), 1) // shard)

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "length", "ids_crc32"], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].tolist()
        part = [i for i, n in enumerate(lengths) if n < size]
        bins = [[i] for i, n in enumerate(lengths) if n >= size]
        own = [lengths[i] for i in part]
        bins += [[part[i] for i in b] for b in local_search(best_fit(own, size), own, size)]
        sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        for s, b in enumerate(bins):
            at = 0
            for i in b:
                sequence[i], offset[i] = (int(key[0]) << 32) + s, at
                at += lengths[i]
        return pdf.drop(columns="shard").assign(sequence_id=sequence, offset=offset)

    return rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards))).groupBy("shard").applyInPandas(fit, PACKED)


def pack_documents(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END, shard: int = SHARD) -> DataFrame:
    """Documents to packed pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs, tokenizer, size, end), size, shard)
