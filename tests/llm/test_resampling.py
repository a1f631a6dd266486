"""Importance resampling against a direct computation, and defined results."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from specton.llm import resampling

DOCS = "doc_id long, text string"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [zlib.crc32(w.encode()) % 10000 for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]


def direct(docs, target):
    s, t = Counter(b for _, x in docs for b in words(x)), Counter(b for x in target for b in words(x))
    ss, tt = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ss + 10000) / ((s[b] + 1) * (tt + 10000)))) for b in range(10000)]
    rows = []
    for i, x in docs:
        own = words(x)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = None if i is None else int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(own), weight, None if h is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((-r[3], r[0]) for r in rows if r[3] is not None and r[1] >= 20)
    rank = {i: k + 1 for k, (_, i) in enumerate(able[: 10 * len(able) // 100])}
    return sorted(((*r, rank.get(r[0])) for r in rows), key=str)


@pytest.fixture(scope="module")
def docs():
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"Term{x}" for x in rng.zipf(1.4, rng.integers(0, 80)) % 3000)) for i in range(500)]
    return rows + [(1000, None), (1001, ""), (1002, "Größe_größe ÄÖ-ß 12a\x7fb"), (1003, "!?"), (None, "null id " * 20)]


def test_equals_direct_computation(spark, docs):
    target = ["Term1 term2 term7 other", None, "", "größe 12a"]
    df = spark.createDataFrame(docs, DOCS).repartition(7).withColumn("score", F.lit("x")).withColumn("weight", F.lit(1))
    got = resampling.resample(df, spark.createDataFrame([(x,) for x in target], "text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == direct(docs, target)


def test_long_texts_are_cut_between_words(monkeypatch):
    text = " ".join(f"w{i}" for i in range(5000)).encode()
    whole = np.concatenate(list(resampling.buckets(text)))
    monkeypatch.setattr(resampling, "PIECE", 100)
    assert len(list(resampling.buckets(text))) > 100
    assert (np.concatenate(list(resampling.buckets(text))) == whole).all()


def test_ties_and_repeated_rows(spark):
    rows = spark.createDataFrame([(i % 50, 30, 5, 7) for i in range(100)], "doc_id long, n_features long, weight long, score long")
    got = resampling.ranked(rows).where("rank is not null").orderBy("rank").collect()
    assert [(r.doc_id, r["rank"]) for r in got] == [(k // 2, k + 1) for k in range(10)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert resampling.resample(none, none).count() == 0
    some = resampling.resample(spark.createDataFrame([(1, "a b")], DOCS), none).collect()
    assert [tuple(r)[:3] for r in some] == [(1, 2, -693)]
