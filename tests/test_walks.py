"""Vectors spread over graph tables, sampled walks and seeded projections against direct computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from specton.functions import scalars
from specton.operators import diffusion, graph, projection

EDGES = "src long, dst long, p double"


def made_graph(n=30, seed=1, hub=0):
    """Node 0 leads to most nodes, the last one nowhere."""
    r = np.random.default_rng(seed)
    out = {}
    for i in range(n - 1):
        for j in r.choice(n, n - 5 if i == hub else 4, replace=False):
            out[i, int(j)] = r.random() + 0.1
    total = {i: sum(w for (s, _), w in out.items() if s == i) for i in range(n - 1)}
    return [(i, j, w / total[i]) for (i, j), w in out.items()]


def matrix(edges, n):
    p = np.zeros((n, n))
    for i, j, w in edges:
        p[i, j] += w
    for i in range(n):
        if not p[i].any():
            p[i, i] = 1
    return p


@pytest.mark.parametrize(("width", "chunk", "once"), [(64, 1024, 1 << 16), (3, 4, 7)])
def test_diffusion_equals_products(spark, monkeypatch, width, chunk, once):
    """Many vectors, a hub in several rows, a node without a way out, and rows changed for single vectors."""
    monkeypatch.setattr(diffusion, "WIDTH", width)
    monkeypatch.setattr(diffusion, "EDGES", chunk)
    monkeypatch.setattr(diffusion, "AT_ONCE", once)
    n, edges = 30, made_graph()
    starts = [(v, int(node), 1.0 + v) for v in range(11) for node in {v, (7 * v) % n}]
    own = [(3, 5, 29, 0.25), (3, 5, 2, 0.75), (3, 29, 1, 1.0), (8, 0, 4, 1.0), (10, 99, 0, 1.0)]
    state, places = diffusion.diffuse(spark.createDataFrame(edges, EDGES).repartition(4), spark.createDataFrame(starts, "id long, node long, value double"), 7, 0.3, spark.createDataFrame(own, "id long, src long, dst long, p double"))
    names = spark.createDataFrame([(i, f"n{i}") for i in range(n)], "node long, name string")
    got = np.zeros((11, n))
    for r in diffusion.read(state, places, names, "name").collect():
        got[r.id, int(r.name[1:])] = r.value
    for v in range(11):
        p = matrix(edges, n)
        for src in {s for i, s, _, _ in own if i == v and s < n}:
            p[src] = 0
            for _, _, j, w in [x for x in own if x[:2] == (v, src)]:
                p[src, j] = w
        first = np.zeros(n)
        for i, node, x in starts:
            if i == v:
                first[node] += x
        at = first
        for _ in range(7):
            at = 0.3 * first + 0.7 * at @ p
        assert np.allclose(got[v], at, atol=1e-12), v


@pytest.mark.parametrize(("slab", "wide"), [(1 << 17, 256), (1 << 17, 2), (5, 256)])
def test_gathered_equals_products(spark, monkeypatch, slab, wide):
    """Graphs of two parts, rows changed for single vectors, names of several nodes, in one task a block or over many."""
    monkeypatch.setattr(diffusion, "SLAB", slab)
    monkeypatch.setattr(diffusion, "WIDTH", min(wide, 64))
    monkeypatch.setattr(diffusion, "WIDEST", wide)
    one, two = made_graph(), [(i + 100, j + 100, w) for i, j, w in made_graph(12, 4)]
    edges = spark.createDataFrame([("a", *e) for e in one] + [("b", *e) for e in two], f"key string, {EDGES}").repartition(4)
    starts = spark.createDataFrame([("a", v, v, 1.0) for v in range(7)] + [("b", v, -1, 1.0) for v in range(7, 12)], "key string, id long, node long, value double")
    own = [(3, 5, 29, 0.25), (3, 5, 2, 0.75), (3, 29, 1, 1.0), *[x for v in range(7, 12) for x in ((v, -1, 100 + v, 1.0), (v, 105, -1, 0.5), (v, 105, 101, 0.5))]]
    names = spark.createDataFrame([(i, f"n{i % 3}") for i in [*range(30), *range(100, 112)]], "node long, name string")
    got = {(r.id, r.name): r.value for r in diffusion.gathered(edges, starts, names, "name", 7, 0.3, spark.createDataFrame(own, "id long, src long, dst long, p double"), "key").collect()}
    for v in range(12):
        at, n = ({i: i for i in range(30)}, 30) if v < 7 else ({**{100 + i: i for i in range(12)}, -1: 12}, 13)
        p = matrix([(at[i], at[j], w) for i, j, w in (one if v < 7 else two)], n)
        for src in {s for i, s, _, _ in own if i == v}:
            p[at[src]] = 0
            for _, _, j, w in [x for x in own if x[:2] == (v, src)]:
                p[at[src], at[j]] = w
        first = np.eye(n)[v if v < 7 else 12]
        x = first
        for _ in range(7):
            x = 0.3 * first + 0.7 * x @ p
        for k in range(3):
            assert abs(got.get((v, f"n{k}"), 0) - sum(x[i] for node, i in at.items() if node >= 0 and node % 3 == k)) < 1e-12


def test_reservoir(spark):
    edges = [(0, 1, 5.0), (1, 2, 1.0), (1, 0, 3.0), (2, 3, 2.0), (9, 0, 1.0), (0, 9, 1.0), (2, 2, -1.0), (3, 0, float("inf"))]
    rows = [(1, [0.2, -0.4, 1.0]), (2, [0.0, 0.0, 0.0]), (3, [-1.0, 5.0, 0.0])]
    got = {r.id: r.sketch for r in diffusion.reservoir(spark.createDataFrame(rows, "id long, vector array<double>"), spark.createDataFrame(edges, "src long, dst long, w double"), 4, bins=16).collect()}
    p = matrix([(0, 1, 1.0), (1, 2, 0.25), (1, 0, 0.75), (2, 3, 1.0)], 4)
    for i, v in rows:
        first = np.zeros(4)
        for k, x in enumerate(v):
            if x:
                first[((2 * k + (1 if x > 0 else 2)) * 2654435761 % 2**32) % 4] += abs(x)
        first /= first.sum() or 1
        at = first
        for _ in range(5):
            at = 0.18 * first + 0.82 * at @ p
        sketch = np.zeros(16)
        for node in range(4):
            sketch[((node + 11) * 2246822519 % 2**32) % 16] += at[node]
        assert np.allclose(got[i], sketch / (np.sqrt((sketch**2).sum()) or 1), atol=1e-12)


def test_reservoir_spreads_nodes_not_rows(spark, monkeypatch):
    """What is spread doesn't grow with the rows: no row takes part in a diffusion."""
    monkeypatch.setattr(diffusion, "diffuse", None)
    rows = spark.range(50).select("id", F.array(F.sin("id"), F.lit(None).cast("double"), F.cos("id")).alias("vector"))
    edges = spark.createDataFrame([(0, 1, 5.0), (1, 2, 1.0), (2, 0, 2.0)], "src long, dst long, w double")
    got = diffusion.reservoir(rows, edges, 4, bins=4).collect()
    assert len(got) == 50 and all(abs(sum(x * x for x in r.sketch) - 1) < 1e-9 for r in got)


def test_generator_as_columns(spark):
    rows = [(s, n) for s in (0, 1, 1337, 2**31, 2**32 - 1) for n in range(5)]
    got = {(r.s, r.n): r.u for r in spark.createDataFrame(rows, "s long, n long").select("s", "n", scalars.mulberry32_at(F.col("s"), F.col("n")).alias("u")).collect()}
    for s in {s for s, _ in rows}:
        draws = scalars.mulberry32(s)
        assert [got[s, n] for n in range(5)] == [next(draws) for _ in range(5)]


def direct_path(edges, start, seed, steps, restart):
    draws, node, out = scalars.mulberry32(seed), start, [(start, False)]
    for _ in range(steps):
        back = next(draws) < restart
        if back:
            node = start
        else:
            own = sorted((j, w) for i, j, w in edges if i == node) or [(node, 1.0)]
            u, total = next(draws), 0.0
            for j, w in own:
                total += w
                node = j
                if total > u:
                    break
        out.append((node, back))
    return out


@pytest.mark.parametrize("chunk", [256, 4])
def test_sampled_walks_are_those_of_the_seeds(spark, monkeypatch, chunk):
    monkeypatch.setattr(graph, "CHUNK", chunk)
    edges = made_graph()
    walkers = [(w, w % 30, 1000 + w) for w in range(60)]
    df = spark.createDataFrame(walkers, "walker long, start long, seed long")
    paths = graph.sample_walks(spark.createDataFrame(edges, EDGES).repartition(5), df.repartition(3), 8)
    got = {}
    for r in paths.collect():
        got.setdefault(r.walker, {})[r.step] = (r.node, r.restarted)
    for w, start, seed in walkers:
        assert [got[w][k] for k in range(9)] == direct_path(edges, start, seed, 8, 0.2)


def test_restart_endpoints(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], EDGES)
    walkers = spark.createDataFrame([(1, 0, 5)], "walker long, start long, seed long")
    path = lambda restart: [(r.node, r.restarted) for r in graph.sample_walks(edges, walkers, 3, restart).orderBy("step").collect()]
    assert path(0.0) == [(0, False), (1, False), (0, False), (1, False)]
    assert path(1.0) == [(0, False), (0, True), (0, True), (0, True)]


def test_frequencies_are_near_the_distribution(spark):
    edges = made_graph(12, 4)
    walkers = spark.range(10_000).select(F.col("id").alias("walker"), F.lit(3).cast("long").alias("start"), (F.col("id") * 7 + 1).alias("seed"))
    last = {r.node: r["count"] / 10_000 for r in graph.sample_walks(spark.createDataFrame(edges, EDGES), walkers, 6).where("step = 6").groupBy("node").count().collect()}
    p, at = matrix(edges, 12), np.eye(12)[3]
    for _ in range(6):
        at = 0.2 * np.eye(12)[3] + 0.8 * at @ p
    assert all(abs(last.get(k, 0) - at[k]) < 5 * np.sqrt(at[k] / 10_000) + 1e-3 for k in range(12))


def test_walk_options_merge_the_way_back(spark):
    edges = spark.createDataFrame([(7, 0, 1, 0.7), (7, 0, 2, 0.3), (7, 1, 2, 0.5), (7, 1, 0, 0.5)], "query long, src long, dst long, p double")
    got = graph.walk_options(edges, spark.createDataFrame([(7, 0)], "query long, node long"))
    rows = [(r.src, r.dst, round(r.p, 12), r["rank"]) for r in got.orderBy("src", "rank").collect()]
    assert rows == [(0, 1, 0.56, 1), (0, 2, 0.24, 2), (0, 0, 0.2, 3), (1, 0, 0.6, 1), (1, 2, 0.4, 2), (2, 2, 0.8, 1), (2, 0, 0.2, 2)]


def test_projections_follow_their_seed():
    p = projection.sparse_projection(40, 1000, 6, 9)
    assert all(len(set(row)) == 6 for row in p.tolist()) and (p == projection.sparse_projection(40, 1000, 6, 9)).all()
    draws, pool = scalars.mulberry32(9), list(range(40))
    for c in range(3):  # the pool goes on from cell to cell
        for j in range(6):
            r = j + int(next(draws) * (40 - j))
            pool[j], pool[r] = pool[r], pool[j]
        assert p[c].tolist() == pool[:6]
    tag = projection.winners(np.sin(np.arange(40.0))[p].sum(1)[None])
    assert tag.sum() == 50 and set(np.unique(tag)) == {0, 1}
    w = projection.dense_projection(5, 7)
    draws = scalars.mulberry32(1337 ^ 0x9E3779B9)
    u, v = next(draws), next(draws)
    assert w.shape == (7, 5) and np.allclose(w[0, :2], [np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v), np.sqrt(-2 * np.log(u)) * np.sin(2 * np.pi * v)], atol=1e-6)
    embed = projection.embedder("fly", 32)
    draws = scalars.mulberry32(5)
    a = np.array([next(draws) - 0.5 for _ in range(32)])
    near, far = a + np.array([(next(draws) - 0.5) * 0.05 for _ in range(32)]), np.array([next(draws) - 0.5 for _ in range(32)])
    cosine = lambda x, y: x @ y / np.sqrt((x @ x) * (y @ y))
    assert cosine(embed(a), embed(near)) > cosine(embed(a), embed(far)) + 0.3


@pytest.mark.parametrize("kind", ["sparse", "dense"])
def test_tags_are_made_by_slices(spark, monkeypatch, kind):
    """No more rows at once than a slice has, whatever a batch holds."""
    p = projection.sparse_projection(8, 40, 3) if kind == "sparse" else projection.dense_projection(8, 40)
    whole = projection.winners
    monkeypatch.setattr(projection, "AT_ONCE", 7)

    def few(a, share):
        assert len(a) <= 7
        return whole(a, share)

    monkeypatch.setattr(projection, "winners", few)
    v = np.random.default_rng(5).normal(size=(50, 8))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>").coalesce(1)
    got = {r.id: r.tag for r in projection.tags(rows, p).collect()}
    for i in range(50):
        a = v[i][p].sum(1) if kind == "sparse" else p @ v[i]
        assert got[i] == np.flatnonzero(whole(a[None])[0]).tolist()


def test_tiles_sum_what_the_edges_do():
    r = np.random.default_rng(4)
    i, j, w, mass = r.integers(0, 50, 1000), np.sort(r.integers(0, 40, 1000)), r.random(1000), r.random((50, 6))
    j[300:700] = 17
    j.sort()
    out, wanted = np.zeros((50, 6)), np.zeros((50, 6))
    np.add.at(wanted, j, mass[i] * w[:, None])
    for source, to, share in diffusion._tiles(i, j, w):
        assert len(np.unique(to)) == len(to) and share.size <= diffusion.TILE**2
        out[to] += share @ mass[source]
    assert np.allclose(out, wanted, rtol=1e-13)


def test_vectors_of_a_block_walk_by_slices(spark, monkeypatch):
    """One copy of the graph for all vectors, whatever number of them walks at once; and all steps of the queries."""
    monkeypatch.setattr(diffusion, "TASKS", 1)
    monkeypatch.setattr(diffusion, "WIDEST", 3)
    monkeypatch.setattr(diffusion, "CELLS", 1)
    n, edges = 30, made_graph()
    starts = spark.createDataFrame([(v, v, 1.0) for v in range(20)], "id long, node long, value double")
    names = spark.createDataFrame([(i, i) for i in range(n)], "node long, name long")
    out = diffusion.gathered(spark.createDataFrame(edges, EDGES).repartition(3), starts, names, "name", graph.STEPS, graph.RESTART)
    got = {(r.id, r.name): r.value for r in out.collect()}
    p = matrix(edges, n)
    at = np.eye(n)[:20]
    for _ in range(graph.STEPS):
        at = 0.2 * np.eye(n)[:20] + 0.8 * at @ p
    assert all(abs(got.get((v, i), 0.0) - at[v, i]) < 1e-14 for v in range(20) for i in range(n))
    assert out.select(F.spark_partition_id()).distinct().count() == 1


def test_graphs_of_more_nodes_walk_in_a_task(spark, monkeypatch):
    monkeypatch.setattr(diffusion, "diffuse", None)
    n = (1 << 17) + 10
    edges = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"), F.lit(1.0).alias("p"))
    starts = spark.createDataFrame([(5, n - 1, 1.0)], "id long, node long, value double")
    got = {r.name: r.value for r in diffusion.gathered(edges, starts, edges.select(F.col("src").alias("node"), F.col("src").alias("name")), "name", 2, 0.5).collect()}
    assert got == {n - 1: 0.5, 0: 0.25, 1: 0.25}


def test_small_changes_are_followed_in_single_precision(monkeypatch):
    r = np.random.default_rng(2)
    n, wide = 400, 5
    i, j = np.repeat(np.arange(n), 4), r.integers(0, n, 4 * n)
    j[:300] = 7
    w = r.random(4 * n)
    w /= np.bincount(i, w)[i]
    ways = diffusion._Ways(i, j, w, n)
    kinds = []
    step = diffusion._Ways.step
    monkeypatch.setattr(diffusion._Ways, "step", lambda self, mass, out: (kinds.append(mass.dtype), step(self, mass, out)))
    origin = (ways.number[np.arange(wide)] * wide + np.arange(wide), np.ones(wide))
    none = np.array([], int)
    got = sum(x.astype(float) for x in diffusion._stepped(ways, origin, (none, none, np.array([])), wide, 40, 0.2, True))
    p = np.zeros((n, n))
    np.add.at(p, (i, j), w)
    at = first = np.eye(n)[:wide]
    for _ in range(40):
        at = 0.2 * first + 0.8 * at @ p
    assert np.abs(got[ways.number].T - at).max() < 1e-11 and np.dtype(np.float32) in kinds and kinds[0] == float
