"""Audit of filters that fail the same documents: what each removes in every order, and its Shapley value.

Duplicates are found by sorting: rows are dealt by ranges of text fingerprint and doc_id, sorted by fingerprint, full text
and doc_id, and each row is compared with its predecessor, text by text. As doc_id is part of the ranges, any number of copies of a
text spreads over as many tasks as it needs. Only the first rows of a text whose fingerprint lies at an end of a partition
may have a smaller doc_id elsewhere; these few meet in a small table of boundary texts.

All filters of a document make one mask. Masks are counted by part in additive counters, one for each of the 32 masks
together with its good and toxic documents, and all steps of all orders are sums of these: one product of matrices a part.

Defined results: a null text is an empty one, a null source the part ``''``; a null doc_id is never smaller or larger than
another; rows that share both doc_id and text don't fail each other; a doc_id with several labels is good, or toxic, if any
says so; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specton.llm.common import small_batches, staged

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(x) for x in itertools.permutations(FILTERS)]
DUPLICATE = 1 << FILTERS.index("E")
_CAPITALS = bytes(range(65, 91))
_ODD = re.compile(rb"[#$%&*|]")


def mask(text: bytes, points: int) -> int:
    """The filters that a text of so many code points fails by itself, a bit each."""
    words = text.split()
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    failed = len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 2 * points, _ODD.search(text) is not None
    return sum(1 << i for i, x in enumerate(failed) if x)


_MARKED = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("text", pa.binary()), ("n", pa.int64())])


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one sorted partition: doc_id, part, mask, n; and text for rows that may fail by a text of another partition."""
    now = before = least = own = None
    first, edge = True, {}

    def boundary(rows: dict) -> pa.RecordBatch:
        columns = zip(*((i, part, bits, text, n) for (text, i, part, bits), n in rows.items()), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _MARKED, strict=True)], schema=_MARKED)

    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        points = pa.compute.utf8_length(batch.column("text")).to_pylist()
        out: list[tuple] = []
        for fp, i, part, size, x in zip(batch.column("fp").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(), points, texts, strict=True):
            text = x.as_py()
            if fp != now:
                if edge and first and now is not None:
                    yield boundary(edge)
                else:
                    out += [(a, p, m, None, n) for (_, a, p, m), n in edge.items()]
                first, now, before, edge = now is None, fp, None, {}
            if text != before:
                before, least, own = text, None, mask(text, size)
            if least is not None and i > least:
                out.append((i, part, own | DUPLICATE, None, 1))
            elif i is None:
                out.append((i, part, own, None, 1))
            else:
                least = i
                edge[text, i, part, own] = edge.get((text, i, part, own), 0) + 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _MARKED, strict=True)], schema=_MARKED)
    if edge:
        yield boundary(edge)


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask, n: the failures of all rows of docs (doc_id, text, source). Written when this returns."""
    text, part = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "source"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), text.alias("text")).withColumn("fp", F.xxhash64("text"))
    rows = small_batches(rows).repartitionByRange("fp", "doc_id").sortWithinPartitions("fp", "text", "doc_id")
    found = staged(rows.mapInArrow(_marked, "doc_id long, part string, mask int, text binary, n long"))
    edge = found.where(F.col("text").isNotNull())
    least = edge.groupBy("text").agg(F.min("doc_id").alias("least"))
    late = edge.join(least, "text").withColumn("mask", F.when(F.col("doc_id") > F.col("least"), F.col("mask").bitwiseOR(DUPLICATE)).otherwise(F.col("mask")))
    return found.where(F.col("text").isNull()).drop("text").unionByName(late.select("doc_id", "part", "mask", "n"))


def counters(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: additive over any split of the rows (doc_id, part, mask, n)."""
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.coalesce(F.max((F.col("quality") == 1).cast("long")), F.lit(0)).alias("g"), F.coalesce(F.max((F.col("toxic") == 1).cast("long")), F.lit(0)).alias("t")).where("g + t > 0")
    none = F.lit(0).cast("long")
    all_ = rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), none.alias("good"), none.alias("toxic"))
    marked = rows.join(marks, "doc_id").groupBy("part", "mask").agg(none.alias("n"), F.sum(F.col("n") * F.col("g")).alias("good"), F.sum(F.col("n") * F.col("t")).alias("toxic"))
    return all_.unionByName(marked).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def _steps() -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """All orders and steps, and for each figure which masks it sums: MASKS columns of zeros and ones, a row a step."""
    steps = [(order, k) for order in ORDERS for k in range(len(FILTERS))]
    m = np.arange(MASKS)
    bit = np.array([1 << FILTERS.index(order[k]) for order, k in steps])[:, None]
    before = np.array([sum(1 << FILTERS.index(c) for c in order[:k]) for order, k in steps])[:, None]
    failed, earlier = (m & bit) > 0, (m & before) > 0
    own = {"kept": ~failed & ~earlier, "removed": failed & ~earlier, "redundant": failed & earlier, "unique_fails": m == bit}
    removed = own["removed"].astype(np.int64)
    by = {c: removed[[order[k] == c for order, k in steps]].sum(0) for c in FILTERS}
    return steps, {k: v.astype(np.int64) for k, v in own.items()} | {"shapley": np.stack([by[order[k]] for order, k in steps])}


FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def orders(counted: DataFrame) -> DataFrame:
    """part, filter_order, step and the figures of each step: a product of each part's counters with the fixed sums."""
    packed = counted.groupBy("part").agg(*(F.map_from_entries(F.collect_list(F.struct("mask", c))).alias(c) for c in ("n", "good", "toxic")))
    dense = lambda c: F.transform(F.sequence(F.lit(0), F.lit(MASKS - 1)), lambda i: F.coalesce(F.element_at(c, i), F.lit(0))).alias(c)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps, sums = _steps()
        names = {"filter_order": [o for o, _ in steps], "step": np.array([k + 1 for _, k in steps], np.int32)}
        for pdf in batches:
            for part, n, good, toxic in zip(pdf["part"], pdf["n"], pdf["good"], pdf["toxic"], strict=True):
                of = {"good_lost": ("removed", good), "toxic_lost": ("removed", toxic)}
                yield pd.DataFrame({"part": part} | names | {f: sums[of.get(f, (f, n))[0]] @ of.get(f, (f, n))[1] for f in FIGURES})

    return packed.select("part", *map(dense, ("n", "good", "toxic"))).mapInPandas(run, "part string, filter_order string, step int, " + ", ".join(f"{f} long" for f in FIGURES))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The figures of all orders for docs (doc_id, text, source) and labels (doc_id, quality, toxic)."""
    return orders(counters(masks(docs), labels))


#: The same rows in DuckDB's SQL.
SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), f AS (
  SELECT doc_id, part,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * list_unique(words) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
  FROM d
), l AS (
  SELECT doc_id, coalesce(max(CASE WHEN quality = 1 THEN 1 ELSE 0 END), 0) AS good, coalesce(max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END), 0) AS toxic FROM labels GROUP BY doc_id
), c AS (
  SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask
), x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b),
o AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits FROM x p, x q, x r, x s, x t
  WHERE p.b + q.b + r.b + s.b + t.b = 31 AND len(list_distinct([p.b, q.b, r.b, s.b, t.b])) = 5
), k AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::BIGINT AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), y AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & bit = 0 AND mask & before = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, k GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM y
"""
