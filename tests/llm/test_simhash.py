"""SimHash links against all pairs, the covering code against its definition, and defined results."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from specton.llm import simhash
from specton.llm.common import Scratch

SCHEMA = "doc_id long, text string"


def brute(rows):
    """doc_id -> (fingerprint, component) by the definition."""

    def fp(text):
        words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().replace(b"\t", b" ").replace(b"\n", b" ").split(b" ") if w]
        if not words:
            return 0
        n = min(3, len(words))
        h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(len(words) - n + 1)]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    return [(i, fp(t)) for i, t in rows]


def components_of(rows):
    root = {f: f for _, f in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = sorted(root)
    for k, a in enumerate(fps):
        for b in fps[:k]:
            if (a ^ b).bit_count() <= 3 and top(a) != top(b):
                root[top(a)] = top(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[top(f)] = min(i, least.get(top(f), i))
    return {(i, f"{f:016x}", least.get(top(f))) for i, f in rows}


def test_every_value_has_one_anchor_within_the_covering_radius():
    values = np.random.default_rng(1).integers(0, 1 << 23, 500).astype(np.uint64)
    words = np.flatnonzero(simhash._rest(np.arange(1 << 23, dtype=np.uint64)) == 0).astype(np.uint64)
    assert len(words) == 1 << 12
    near = np.bitwise_count(values[:, None] ^ words[None, :])
    assert ((near <= simhash.COVER).sum(1) == 1).all()
    assert (simhash._home(values) == words[near.argmin(1)]).all()
    for left in range(simhash.RADIUS + 1):
        row, anchor, over = simhash._visits(values, np.full(len(values), left))
        got = {(int(r), int(a)): int(o) for r, a, o in zip(row, anchor, over, strict=True)}
        want = {(int(r), int(words[w])): max(0, int(near[r, w]) - simhash.COVER) for r, w in zip(*np.nonzero(near <= simhash.COVER + left), strict=True)}
        assert got == want


@pytest.fixture(scope="module")
def prints():
    """Fingerprints around a few centres, and scattered ones."""
    rng = np.random.default_rng(7)
    centres = rng.integers(0, 1 << 63, 12).astype(np.uint64)
    out = list(rng.integers(0, 1 << 63, 300).astype(np.uint64))
    for c in centres:
        for _ in range(40):
            x = c
            for b in rng.choice(64, rng.integers(0, 6), replace=False):
                x ^= np.uint64(1) << np.uint64(b)
            out.append(x)
    return sorted({int(x) for x in out})


@pytest.mark.parametrize(("pairs", "chunk", "deep"), [(1 << 26, 8192, 1 << 24), (200, 8192, 1 << 24), (1, 7, 1 << 24), (1 << 26, 8192, 10)])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, prints, pairs, chunk, deep):
    """Also when anchors are dealt on by all windows, and when what is left is compared in chunks."""
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash, "DEEP", deep)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    with Scratch(spark) as scratch:
        found = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), scratch).collect()]
    mask = (1 << 64) - 1
    assert all(((a ^ b) & mask).bit_count() <= 3 and a != b for a, b in found)
    root = {x: x for x in prints}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        root[top(a & mask)] = top(b & mask)
    want = components_of([(x, x) for x in prints])
    least = {}
    for x in prints:
        least[top(x)] = min(x, least.get(top(x), x))
    assert {(x, f"{x:016x}", least[top(x)]) for x in prints} == want


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 400, rng.integers(1, 300))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100 + i, t.upper() + " \t\n") for i, t in enumerate(texts[:20])]
    rows += [(200 + i, t + f" w{i}") for i, t in enumerate(texts)]
    rows += [(300, None), (301, ""), (302, " \n "), (None, texts[3]), (5, texts[5]), (400, "naïve Ärger Ärger"), (401, "naïve Ärger Ärger"), (402, "one two"), (None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("FP", F.lit(1)).withColumn("anchor", F.lit("x"))
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert {tuple(r) for r in got} == components_of(brute(rows))


def test_long_text_and_empty_table(spark):
    text = " ".join(f"v{i % 9973}" for i in range(200_000))
    assert simhash.fingerprint(text.encode()) == brute([(1, text)])[0][1]
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
