"""Importance resampling toward a target distribution of hashed features, in two Arrow passes.

The first pass turns each partition into one vector of bucket counts, which a tree of reducers adds up; the second gives each
document the mean gain of its features and a score with hashed Gumbel noise, so that the highest scores are a draw
without replacement in proportion to the documents' likelihood ratios. Whatever goes to the driver or out to all
tasks is one vector of ``BUCKETS`` numbers.

Scores are integers between bounds that follow from the gains and the noise, so there are at most about 100 000 different
ones whatever the input: counts by score tell the threshold and the ranks above each score, and ties are ranked within a
score. No task sees all rows.

Defined results: null and empty texts have no features and weight 0; a row with a null doc_id counts as text of the corpus,
but has no score and takes no part in the draw; repeated rows take part one by one, ties among them in any order; an
empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specton.llm.common import small_batches, staged

BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 2024, 20, 10
#: A-Z in lower case, and a space for all of ASCII but letters and digits.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: A longer text is cut at a space beyond so many bytes, which bounds the words held at once.
PIECE = 1 << 20


def buckets(text: bytes | None) -> Iterator[np.ndarray]:
    """The buckets of a text's words, in pieces."""
    folded, at = (text or b"").translate(_FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + PIECE)
        end = len(folded) if end < 0 else end
        words = folded[at:end].split()
        yield np.fromiter(map(crc32, words), np.int64, len(words)) % BUCKETS
        at = end


def counts(rows: DataFrame) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            own = [b for x in batch.column(0).cast(pa.binary()) for b in buckets(x.as_py())]
            if own:
                total += np.bincount(np.concatenate(own), minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["n"])

    vectors = small_batches(rows.select(F.col("text").cast("string").alias("text"))).mapInArrow(run, "n binary").rdd.map(lambda r: np.frombuffer(r.n, np.int64))
    return vectors.treeReduce(np.add) if vectors.getNumPartitions() else np.zeros(BUCKETS, np.int64)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares, floored."""
    s, t = (float(x.sum()) + BUCKETS for x in (corpus, target))
    return np.array([math.floor(1000 * math.log((b + 1.0) * s / ((a + 1.0) * t))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def _noise(doc_id: int) -> int:
    h = int(hashlib.sha256(f"{SEED}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_features, weight, score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [list(buckets(x.as_py())) for x in batch.column("text").cast(pa.binary())]
            n = np.array([sum(map(len, x)) for x in own], np.int64)
            every = np.concatenate([b for x in own for b in x] or [np.zeros(0, np.int64)])
            total = np.bincount(np.repeat(np.arange(len(n)), n), shared.value[every], len(n)).astype(np.int64)
            weight = total // np.maximum(n, 1)
            ids = batch.column("doc_id").to_pylist()
            score = [None if i is None else int(w) + _noise(i) for i, w in zip(ids, weight, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(weight), pa.array(score, pa.int64())], ["doc_id", "n_features", "weight", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return small_batches(rows).mapInArrow(run, "doc_id long, n_features long, weight long, score long")


def ranked(rows: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """The rows with their rank in the draw, null if not drawn. rows: doc_id, n_features, weight, score."""
    some = F.col("score").isNotNull() & (F.col("n_features") >= least)
    by = rows.where(some).groupBy("score").agg(F.count("*").alias("_n"))
    above = F.coalesce(F.sum("_n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    draws = F.floor(F.sum("_n").over(Window.partitionBy()) * percent / 100)
    # At most a row for each of about 100 000 scores.
    near = by.select("score", above.alias("_above"), draws.alias("_draws")).where("_above < _draws")
    placed = rows.join(F.broadcast(near), "score", "left")
    within = F.row_number().over(Window.partitionBy("score").orderBy("doc_id"))
    maybe = some & F.col("_above").isNotNull()
    rank = F.col("_above") + within
    drawn = placed.where(maybe).withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= F.col("_draws"), F.col("rank")))
    rest = placed.where(~maybe).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


def resample(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row of docs (doc_id, text), drawn toward target (text)."""
    return ranked(staged(scored(docs, gains(counts(docs), counts(target)))))


_CRC = f"""
crc_start AS (SELECT range::UBIGINT AS i, range::UBIGINT AS c FROM range(256)),
crc_table AS (SELECT list(list_reduce(range(0, 9), lambda c, k: CASE WHEN k = 0 THEN c WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i::BIGINT) ORDER BY i) AS t FROM crc_start),
"""

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

#: The same rows in DuckDB's SQL.
SQL = f"""
WITH {_CRC}
d AS (SELECT doc_id, unnest({_WORDS}) AS w FROM documents),
b AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
words AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM d UNION SELECT w FROM b)),
bucket AS (
  SELECT w, xor(list_reduce(list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT)), lambda c, x: xor(c // 256, t[CAST(xor(c % 256, x) AS INTEGER) + 1]), 4294967295), 4294967295) % {BUCKETS} AS k
  FROM words, crc_table
),
s AS (SELECT k, count(*) AS s FROM d JOIN bucket USING (w) GROUP BY k),
t AS (SELECT k, count(*) AS t FROM b JOIN bucket USING (w) GROUP BY k),
g AS (
  SELECT k, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM d) + {BUCKETS}.0::DOUBLE) / ((coalesce(s, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM b) + {BUCKETS}.0::DOUBLE)))) AS gain
  FROM s FULL JOIN t USING (k)
),
f AS (SELECT doc_id, count(*) AS n, sum(gain) AS total FROM d JOIN bucket USING (w) JOIN g USING (k) GROUP BY doc_id),
r AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE CAST(floor(total / n) AS BIGINT) END AS weight,
    CAST('0x' || sha256('{SEED}:' || CAST(doc_id AS VARCHAR))[1:8] AS BIGINT) AS h
  FROM documents LEFT JOIN f USING (doc_id)
),
p AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM r),
o AS (
  SELECT *, row_number() OVER (PARTITION BY score IS NOT NULL AND n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS k,
    score IS NOT NULL AND n_features >= {LEAST_WORDS} AS able FROM p
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score,
  CASE WHEN able AND k <= {PERCENT} * (SELECT count(*) FROM o WHERE able) // 100 THEN k END AS rank
FROM o
"""
