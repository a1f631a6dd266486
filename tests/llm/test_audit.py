"""The filter audit against a direct computation, duplicates over partition ends, and defined results."""

import itertools
import re

import pytest

from specton.llm import audit

DOCS, LABELS = "doc_id long, text string, source string", "doc_id long, quality int, toxic int"


def direct(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    failed = []
    for i, t, s in docs:
        t, s = t or "", s or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = {c for c, x in zip("ABCD", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), re.search("[#$%&*|]", t)), strict=True) if x}
        if any(i is not None and j is not None and j < i and (u or "") == t for j, u, _ in docs):
            own.add("E")
        failed.append((i, s, own))
    out = {}
    for part in {s for _, s, _ in failed}:
        rows, sums = [x for x in failed if x[1] == part], dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = rows
            for k, c in enumerate(order):
                gone, earlier = [x for x in left if c in x[2]], [x for x in rows if set(order[:k]) & x[2]]
                left = [x for x in left if c not in x[2]]
                sums[c] += len(gone)
                out[part, order, k + 1] = [len(left), len(gone), sum(c in x[2] for x in earlier), sum(x[2] == {c} for x in rows), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone), c]
    # sums were of one part at a time: add each filter's sum to its rows
    for part in {s for _, s, _ in failed}:
        total = dict.fromkeys("ABCDE", 0)
        for (p, _, _), v in out.items():
            if p == part:
                total[v[6]] += v[1]
        for (p, _, _), v in out.items():
            if p == part:
                v[6] = total[v[6]]
    return {k: tuple(v) for k, v in out.items()}


def result(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[f] for f in audit.FIGURES) for r in df.collect()}


@pytest.fixture(scope="module")
def docs():
    long = " ".join(f"word{i}" for i in range(250))
    rows = [(i, long if i % 3 else long + " $", "ab"[i % 2]) for i in range(60)]
    rows += [(100, "a " * 300, "a"), (101, "SHOUT " * 250, None), (102, None, "b"), (103, "", "b"), (104, "x\x0by\x1cz", "c"), (None, long, "a"), (None, long, "a"), (7, long, "b"), (7, long, "b"), (105, "É" * 10, "c")]
    return rows


def test_equals_direct_computation(spark, docs):
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (7, 1, 1), (103, None, 1), (None, 1, 1), (999, 1, 1)]
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS mask", "'x' AS part")
    assert result(audit.audit(df, spark.createDataFrame(labels, LABELS))) == direct(docs, labels)


@pytest.mark.parametrize("partitions", ["1", "40"])
def test_copies_over_many_partitions(spark, partitions):
    """One text has most rows, so its ranges lie in many partitions; only its smallest doc_id isn't a duplicate."""
    rows = [(i, "same text" if i % 4 else f"other {i % 7}", "s") for i in range(400)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = audit.masks(spark.createDataFrame(rows, DOCS).repartition(13)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    first = {}
    for i, t, _ in rows:
        first.setdefault(t, i)
    assert sum(r.n for r in got) == len(rows)
    assert {r.doc_id for r in got if not r["mask"] & audit.DUPLICATE} == set(first.values())


def test_different_texts_of_one_fingerprint(spark, monkeypatch):
    """Texts decide, not fingerprints."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(audit.F, "xxhash64", lambda *_: F.lit(1).cast("long"))
    rows = [(i, f"text {i % 5}", "s") for i in range(60)]
    got = audit.masks(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id for r in got if not r["mask"] & audit.DUPLICATE} == set(range(5))


def test_empty_table(spark):
    assert audit.audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0
