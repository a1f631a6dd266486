"""Helpers shared by the operators: reading tables, cutting lineage, hashing words in batches."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Odd multiplier of the byte polynomial, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Texts are hashed in runs of about so many bytes, which bounds memory; a longer text is a run of its own.
RUN_BYTES = 1 << 20
#: Rows of an Arrow batch of texts.
TEXTS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir. Only a local session may do without: it has one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/specton-checkpoints"


def staged(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder as Parquet and read them again."""
    path = f"{folder or shared_dir(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Staged tables and broadcasts of one computation; all go when it is closed, so nothing lazy may read them then."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.shared = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}", []

    def staged(self, df: DataFrame) -> DataFrame:
        return staged(df, self.folder)

    def broadcast(self, value: object) -> Broadcast:
        self.shared.append(self.spark.sparkContext.broadcast(value))
        return self.shared[-1]

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        for b in self.shared:
            b.destroy()
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(df: DataFrame) -> DataFrame:
    """The same rows, which from now on come to Python in batches that fit whole texts: ten thousand long ones, in Spark's
    own buffers, in Arrow's and as strings, take hundreds of MB of each executor. Sets the session's batch size."""
    if int(df.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > TEXTS:
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXTS)
    return df


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores in front until the table has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def hash_text(text: str) -> int:
    """64-bit XXH3 of the UTF-8 bytes: stable across processes and machines."""
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class Words:
    """Word hashes of many texts at once, without a Python object a word.

    Words are maximal runs of ASCII letters, digits, underscores and characters beyond ASCII (but for the spaces
    U+00A0 and U+3000) in the lower-cased text. A word's hash is a polynomial of its UTF-8 bytes, read off prefix sums.
    """

    _is_word = np.zeros(256, bool)
    _is_word[[*range(48, 58), 95, *range(97, 123), *range(128, 256)]] = True

    def __init__(self, stem: int = 0) -> None:
        """stem: hash only so many first bytes of each word."""
        self.up, self.down, self.stem = np.ones(1, np.uint64), np.ones(1, np.uint64), stem

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all words, and for each text where its words begin (one entry more than texts)."""
        raw = [(t if t.isascii() else t.replace("\xa0", " ").replace("\u3000", " ")).lower().encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        hashes, counts, run, n = [], [], [], 0
        for r in [*raw, None]:
            if run and (r is None or n + len(r) > RUN_BYTES):
                h, c = self._run(run)
                hashes.append(h)
                counts.append(c)
                run, n = [], 0
            if r is not None:
                run.append(r)
                n += len(r)
        bounds = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)
        return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), bounds

    def _run(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b" ".join([*raw, b" "]), np.uint8)
        if len(data) > len(self.up):
            self.up, self.down = _powers(BASE, len(data)), _powers(BASE_INVERSE, len(data))
        word = self._is_word[data]
        edge = np.flatnonzero(np.diff(word, prepend=False))
        begin, end = edge[0::2], edge[1::2]
        if self.stem:
            end = np.minimum(end, begin + self.stem)
        with np.errstate(over="ignore"):
            total = np.cumsum(data * self.up[: len(data)], dtype=np.uint64)
            before = np.where(begin > 0, total[begin - 1], np.uint64(0))
            hashes = mix64((total[end - 1] - before) * self.down[begin])
        starts = np.cumsum([0, *(len(r) + 1 for r in raw)])
        return hashes, np.diff(np.searchsorted(begin, starts))


def shingles(hashes: np.ndarray, bounds: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words and the text each belongs to; a shorter text has one shingle of all its words."""
    sizes = np.diff(bounds)
    with np.errstate(over="ignore"):
        h = np.zeros(max(len(hashes) - n + 1, 0), np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(h)]
        h = mix64(h)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(bounds[1:], sizes) - np.arange(len(hashes))
    keep = (left >= n)[: len(h)]
    out, own = h[keep], doc[: len(h)][keep]
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    if len(short):
        extra = []
        for d in short:
            v = np.zeros(1, np.uint64)
            with np.errstate(over="ignore"):
                for x in hashes[bounds[d] : bounds[d + 1]]:
                    v = v * np.uint64(0x9E3779B97F4A7C15) + np.array([x], np.uint64)
            extra.append(mix64(v, int(sizes[d]))[0])
        out, own = np.concatenate([out, np.array(extra, np.uint64)]), np.concatenate([own, short])
        order = np.argsort(own, kind="stable")
        out, own = out[order], own[order]
    return out, own
