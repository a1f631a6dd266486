import random

import numpy as np
import pytest

from specton.llm import neardup
from specton.llm.common import Words, shingles


def brute(spark, rows):
    """doc_id -> class_id at weighted Jaccard similarity of 0.8, all pairs."""
    idf = neardup.frequencies(neardup._texts(spark.createDataFrame(rows, "doc_id long, text string")))
    texts = sorted({t for _, t in rows if t is not None})
    e, d, tf = neardup._bags(Words(), texts)
    w = tf * idf.weights(e)
    bags = [dict(zip(e[d == i].tolist(), w[d == i].tolist())) for i in range(len(texts))]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = bags[i], bags[j]
            both = sum(min(x, b[k]) for k, x in a.items() if k in b)
            total = sum(a.values()) + sum(b.values()) - both
            if total and both / total >= 0.8 - 1e-9:
                root[max(top(i), top(j))] = min(top(i), top(j))
    of = {}
    for k, t in rows:
        of.setdefault(("null", k) if t is None else top(texts.index(t)), []).append(k)
    return {k: min(own) for own in of.values() for k in own}


def corpus(seed=0):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    rows, n = [], 0
    for g in range(25):
        base = [word() for _ in range(r.choice([3, 6, 30, 120]))]
        for _ in range(r.choice([1, 2, 3, 12])):
            own = base[:]
            for _ in range(r.choice([0, 0, 1, 1, 3])):
                own[r.randrange(len(own))] = word()
            rows.append((n, " ".join(own)))
            n += 1
    heavy = ("spam eggs " * 200).strip()  # one shingle pair outweighs the rest
    rows += [(n, heavy + " a b c d"), (n + 1, heavy + " e f g h"), (n + 2, None), (n + 3, None), (n + 4, ""), (n + 5, ""), (n + 6, "!!"), (n + 7, "One two."), (n + 8, "one TWO")]
    rows.append(rows[0])
    return rows


def got(spark, rows):
    return {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, key string")).collect()}


def test_classes_match_all_pairs(spark):
    rows = corpus()
    assert got(spark, rows) == brute(spark, rows)


def test_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    r = random.Random(3)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for k in range(60):
        own = base[:]
        for _ in range(r.choice([0, 1, 2, 3])):
            own[r.randrange(100)] = f"x{r.randrange(999)}"
        rows.append((k, " ".join(own)))
    assert got(spark, rows) == brute(spark, rows)


def test_empty_table(spark):
    assert got(spark, []) == {}
    assert got(spark, [(1, None)]) == {1: 1}


def test_distinct_documents_keeps_columns(spark):
    text = " ".join(f"w{k}" for k in range(50))
    docs = spark.createDataFrame([(1, text, "en", "s", 5), (2, text, "en", "s", 5), (2, text, "en", "s", 5), (3, "other words than those of the first", None, None, None), (4, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    out = neardup.distinct_documents(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 3, 4]


def test_null_and_repeated_ids(spark):
    text = [f"w{k}" for k in range(60)]
    near = " ".join(["other", *text[1:]])
    text = " ".join(text)
    rows = [(None, near, "a"), (7, text, "b"), (7, "a text of its own with the id of another one", "c"), (9, None, "d"), (9, None, "e"), (None, "alone without any id at all here", "f"), (8, text, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    found = sorted(((r.doc_id, r.class_id) for r in neardup.classes(docs).collect()), key=str)
    assert found == sorted([(None, 7), (7, 7), (7, 7), (9, 9), (9, 9), (None, None), (8, 7)], key=str)
    assert sorted(r.key for r in neardup.distinct_documents(docs).collect()) == ["b", "c", "d", "e", "f"]


def test_components_of_chains_and_stars(spark):
    from specton.llm.common import Scratch

    r = random.Random(9)
    name = lambda n: n.to_bytes(4, "big")
    chain, star = r.sample(range(1000), 40), r.sample(range(1000, 2000), 50)
    edges = [*zip(chain, chain[1:]), *((star[0], x) for x in star[1:]), (3000, 3001)]
    r.shuffle(edges)
    df = spark.createDataFrame([(name(max(e)), name(min(e))) for e in edges], "key binary, comp binary").repartition(16)
    with Scratch(spark) as scratch:
        got = {bytes(x.key): bytes(x.comp) for x in neardup.components(df, scratch).collect()}
    want = {name(x): name(min(g)) for g in (chain, star, [3000, 3001]) for x in g if x != min(g)}
    assert got == want


@pytest.mark.parametrize("share", [0.5, 0.8, 0.95])
def test_sketch_estimates_weighted_jaccard(share):
    r = np.random.default_rng(5)
    est, true = [], []
    for _ in range(30):
        n = 200
        e = r.integers(1, 1 << 62, 2 * n).astype(np.uint64)
        k = int(n * 2 * share / (1 + share))
        a, b = e[:n], np.concatenate([e[:k], e[n : 2 * n - k]])
        wa = r.uniform(1, 6, n)
        wb = np.concatenate([wa[:k] * r.uniform(0.9, 1, k), r.uniform(1, 6, n - k)])
        s = neardup.sketch(np.concatenate([a, b]), np.repeat([0, 1], n), np.concatenate([wa, wb]), 2)
        both = np.minimum(wa[:k], wb[:k]).sum()
        est.append((s[0] == s[1]).mean())
        true.append(both / (wa.sum() + wb.sum() - both))
    assert abs(np.mean(est) - np.mean(true)) < 0.03


def test_words_and_shingles():
    texts = ["Hello, World_1 été! ", None, "", "a b c d e f", "x\xa0y", "İ ß"]
    h, bounds = Words()(texts)
    assert np.diff(bounds).tolist()[:5] == [3, 0, 0, 6, 2]
    again, _ = Words()(["hello world_1 ÉTÉ"])
    assert again.tolist() == h[:3].tolist()
    s, own = shingles(h, bounds)
    assert own.tolist() == [0, 3, 3, 4, 5]
