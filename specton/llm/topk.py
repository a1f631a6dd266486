"""Exact inner-product top-k by block-at-a-time pruning.

Vectors become integers, floor(scale * x). Rows are cut into blocks of consecutive ids; each block keeps a forward
index (its rows as one matrix) and for every dimension the largest and smallest value. A query's bound on a block is
the sum over dimensions of the larger of its value times either. Blocks are taken in order of that bound, query by
query, and scored through the forward index until the bound falls below the query's kth score. Block groups meet
query batches as Spark groups of a fixed size, and their short lists are merged by a window.

Defined results: null vectors and ones with null or non-finite components take no part; a shorter vector counts as
padded with zeros; rows with the query's own id are not its candidates; equal scores go to the smaller id; repeated
rows are candidates each; fewer candidates than k give fewer rows; an empty table gives none; vectors so long that a score
might not fit 64 bits are an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specton.llm.common import staged

SCALE = 64
BLOCK = 256
#: Rows of a block group and queries of a batch: what one task holds.
GROUP = 32_768
BATCH = 2_048

_BLOCKS = "g long, n int, ids binary, rows binary"


def quantised(vectors: DataFrame, vec_id: str, embedding: str, scale: int = SCALE) -> DataFrame:
    """vec_id long, v array<long>: floor(scale * x) of the usable vectors."""
    x = F.col(embedding).cast("array<double>")
    usable = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return vectors.where(F.coalesce(usable, F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v"))


def _matrix(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _blocks(groups: int):
    def build(batches):
        ids, rows = np.zeros(0, np.int64), []
        for pdf in batches:
            ids = np.concatenate([ids, pdf["vec_id"].to_numpy(np.int64)])
            rows += pdf["v"].tolist()
            while len(rows) >= BLOCK:
                yield _block(ids[:BLOCK], rows[:BLOCK], groups)
                ids, rows = ids[BLOCK:], rows[BLOCK:]
        if rows:
            yield _block(ids, rows, groups)

    return build


def _block(ids: np.ndarray, rows: list, groups: int) -> pd.DataFrame:
    m = _matrix(rows, max(map(len, rows)))
    return pd.DataFrame({"g": [int(ids[0]) * 0x9E3779B1 % (1 << 61) % groups], "n": [len(ids)], "ids": [ids.tobytes()], "rows": [m.tobytes()]})


def best(query_ids: np.ndarray, queries: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], k: int) -> pd.DataFrame:
    """The k best of the blocks' rows for each query: query_id, vec_id, score."""
    width = max([queries.shape[1], *(m.shape[1] for _, m in blocks)])
    wide = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])))
    queries, blocks = wide(queries), [(i, wide(m)) for i, m in blocks]
    largest = max(int(np.abs(queries).max(initial=0)), 1) * max([1, *(int(np.abs(m).max(initial=0)) for _, m in blocks)]) * max(width, 1)
    kind = np.float64 if largest < 1 << 53 else np.int64  # sums are exact in either
    q = queries.astype(kind)
    top = np.stack([m.max(0) for _, m in blocks]).astype(kind)
    low = np.stack([m.min(0) for _, m in blocks]).astype(kind)
    bound = np.maximum(q, 0) @ top.T + np.minimum(q, 0) @ low.T
    order = np.argsort(-bound, axis=1, kind="stable")
    mats = [m.astype(kind) for _, m in blocks]
    kth = np.full(len(q), -np.inf)
    held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))  # query row, score, id
    for step in range(len(blocks)):
        b = order[:, step]
        active = np.flatnonzero(bound[np.arange(len(q)), b] >= kth)
        if not len(active):
            break
        found = [held]
        for own in np.unique(b[active]):
            rows = active[b[active] == own]
            ids, score = blocks[own][0], q[rows] @ mats[own].T
            score_kth = kth[rows]
            same = query_ids[rows][:, None] == ids[None, :]
            if score.shape[1] > 2 * k:  # what the block alone rules out
                alone = np.where(same, -np.inf if kind is np.float64 else np.iinfo(np.int64).min, score)
                score_kth = np.maximum(score_kth, -np.partition(-alone, k - 1, axis=1)[:, k - 1])
            r, c = np.nonzero((score >= score_kth[:, None]) & ~same)
            found.append((rows[r], score[r, c].astype(np.int64), ids[c]))
        at, score, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.lexsort((ids, -score, at))
        at, score, ids = at[by], score[by], ids[by]
        start = np.flatnonzero(np.diff(at, prepend=-1))
        rank = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
        keep = rank < k
        held = at[keep], score[keep], ids[keep]
        full = rank == k - 1
        kth[at[full]] = score[full]
    return pd.DataFrame({"query_id": query_ids[held[0]], "vec_id": held[2], "score": held[1]})


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank from 1, vec_id, score of each query's k best rows. ``is_query`` is a condition on vec_id."""
    rows = staged(quantised(vectors, vec_id, embedding, scale))
    spark = rows.sparkSession
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    counts = rows.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q"), F.max(square).alias("square")).first()
    # No score, and no part of its sum, is more than the square of the longest vector.
    if (counts["square"] or 0.0) >= 1 << 62:
        raise ValueError("vectors are too long: scores would not fit 64 bits")
    groups, batches = -(-max(counts["n"], 1) // GROUP), -(-max(counts["q"], 1) // BATCH)
    parts = max(groups, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-max(counts["n"], 1) // (4 * BLOCK))))
    blocks = rows.repartitionByRange(parts, "vec_id").sortWithinPartitions("vec_id").mapInPandas(_blocks(groups), _BLOCKS).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
    queries = rows.where(is_query).withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(batches)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        held = [(np.frombuffer(i, np.int64), np.frombuffer(m, np.int64).reshape(n, -1)) for n, i, m in zip(left["n"], left["ids"], left["rows"], strict=True)]
        return best(right["vec_id"].to_numpy(np.int64), _matrix(right["v"].tolist(), max(map(len, right["v"]))), held, k)

    found = blocks.groupBy("g", "qb").cogroup(queries.groupBy("g", "qb")).applyInPandas(search, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
