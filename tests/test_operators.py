import numpy as np
import pytest
from pyspark.sql import functions as F

from specton.functions import scalars, shape
from specton.operators import conformal, etl, evaluate, graph, model, projection, references, similarity
from specton.operators.references import ContractError


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_generator_and_folds():
    draws = scalars.mulberry32(1)
    first = [next(draws) for _ in range(3)]
    assert np.allclose(first, [0.6270739405881613, 0.002735721180215478, 0.5274470399599522])
    labels, groups = ["a"] * 10 + ["b"] * 5, [f"g{i}" for i in range(15)]
    fold = evaluate.stratified_folds(labels, groups, 5)
    assert sorted(fold) == sorted(groups) and all(sum(fold[g] == k for g in groups[:10]) == 2 and sum(fold[g] == k for g in groups[10:]) == 1 for k in range(5))
    assert fold == evaluate.stratified_folds(labels[::-1], groups[::-1], 5)
    held = evaluate.calibration_split(labels, groups)
    assert len(held) == 3 and evaluate.calibration_split(["a", "a"], ["x", "y"]) == set()


def test_standardizer_mean_of_prototypes(spark):
    rows = frame(spark, [("A", "l", [0.0, 1.0]), ("A", "l", [2.0, 1.0]), ("B", "l", [10.0, 1.0])], "group string, label string, vector array<double>")
    p = references.prototypes(rows, "group", "label", "vector")
    params = {r.dim: r for r in similarity.fit_standardizer(p).collect()}
    assert params[0].mean == 5.5 and params[1].weight == 0 and {r.group: r.views for r in p.collect()} == {"A": 2, "B": 1}
    z = similarity.standardize(p, similarity.fit_standardizer(p)).collect()
    assert all(r.vector[1] == 0 for r in z)


def test_exclusion_comes_before_the_cut(spark):
    rows = frame(spark, [(i, [float(i), 1.0], "g" if i < 4 else f"h{i}") for i in range(8)], "id long, vector array<double>, grp string")
    got = similarity.neighbours(rows, rows, 2, "euclidean", exclude="grp").where("query_id = 0").orderBy("rank").collect()
    assert [r.ref_id for r in got] == [4, 5]


def test_ties_go_to_the_smaller_label(spark):
    s = frame(spark, [(1, "b", 0.5), (1, "a", 0.5)], "query_id long, label string, score double")
    assert similarity.argmax(s).first().label == "a" and abs(similarity.entropy_bits(s).first().bits - 1) < 1e-12


def test_reliability_by_hand(spark):
    r = evaluate.reliability(frame(spark, [(0.8, 1), (0.4, 0)], "confidence double, hit int"))
    assert abs(evaluate.expected_calibration_error(r).first().ece - 0.3) < 1e-9 and r.count() == 10


def test_animals_with_an_open_view(spark):
    rows = frame(spark, [("x", "a", "a"), ("x", "a", None), ("y", "b", "b"), ("y", "b", "a")], "group string, truth string, predicted string")
    assert {r.group: r.predicted for r in evaluate.animals(rows).collect()} == {"x": None, "y": "a"}


def test_p_values_by_hand(spark):
    cal = frame(spark, [(f"g{i}", "a", i / 10) for i in range(9)], "group string, label string, score double")
    ask = frame(spark, [(1, "a", 0.0), (2, "a", 0.8), (3, "a", 5.0), (4, "a", 0.35)], "query_id long, label string, score double")
    p = conformal.p_values(ask, cal)
    assert {r.query_id: round(r.p, 6) for r in p.collect()} == {1: 1.0, 2: 0.2, 3: 0.1, 4: 0.6}
    sets = {r.query_id: r for r in conformal.prediction_sets(p).collect()}
    assert sets[3].unknown and list(sets[2].labels) == ["a"]


def test_summary_intersects_views(spark):
    rows = frame(spark, [("x", "a", ["a", "b"], True), ("x", "a", ["a"], True), ("y", "b", [], True)], "group string, truth string, labels array<string>, valid boolean")
    r = conformal.summarize(rows).first()
    assert (r.groups, r.coverage, r.empty_rate, r.mean_size) == (2, 0.5, 0.5, 0.5)


def test_walk_on_a_two_node_chain(spark):
    t = frame(spark, [(1, -1, 0, 1.0), (1, 0, -1, 1.0)], "query long, src long, dst long, p double")
    d = graph.walk_distributions(t, frame(spark, [(1, -1)], "query long, node long"), 40, 0.2)
    last = {r.node: r.p for r in d.where("step = 40").collect()}
    assert abs(last[-1] - 1 / (2 - 0.2)) < 1e-3 and abs(sum(last.values()) - 1) < 1e-9
    assert d.groupBy("step").agg(F.sum("p").alias("s")).where("abs(s - 1) > 1e-9").count() == 0
    s = graph.walk_summary(d, None).orderBy("step").collect()
    assert len(s) == 41 and s[0].start_mass == 1.0 and s[0].moved is None and abs(s[1].moved - 0.8) < 1e-9


def test_query_enters_the_graph(spark):
    base = frame(spark, [(1, 2, 0.9, 1), (1, 3, 0.5, 2), (2, 1, 0.9, 1), (2, 3, 0.8, 2), (3, 2, 0.8, 1)], "query_id long, ref_id long, similarity double, rank int")
    asked = frame(spark, [(7, 1, 0.7), (7, 2, 0.1), (7, 3, 0.2)], "query long, ref_id long, similarity double")
    e = graph.with_queries(base, asked, 2)
    got = {(r.src, r.dst) for r in e.collect()}
    assert got == {(1, 2), (1, -1), (3, 2), (3, -1), (-1, 1), (-1, 3)}
    assert e.groupBy("query", "src").agg(F.sum("p").alias("s")).where("abs(s - 1) > 1e-9").count() == 0


def test_graph_compaction(spark):
    e = frame(spark, [("a", "b", 5.0), ("b", "a", 7.0), ("a", "a", 9.0), ("", "b", 9.0), ("b", "c", 1.0), ("c", "d", 6.0)], "src string, dst string, w double")
    nodes, edges = graph.compact(e, 3, 10, 5.0)
    assert {r.id: r.idx for r in nodes.collect()} == {"a": 0, "b": 1} and edges.count() == 2


def test_run_lengths_begin_with_zeros(spark):
    rows = frame(spark, [("x", i, b) for i, b in enumerate([1, 1, 0, 1])] + [("y", 0, 0)], "k string, at int, bit int")
    got = [(r.k, r.run, r.bit, r.length) for r in etl.run_lengths(rows, "k", "at", "bit").orderBy("k", "run").collect()]
    assert got == [("x", 0, 0, 0), ("x", 1, 1, 2), ("x", 2, 0, 1), ("x", 3, 1, 1), ("y", 0, 0, 1)]


def test_names_and_landmarks(spark):
    f = frame(spark, [("lucorum-F-12-L.dw.png",), ("other.png",)], "f string")
    got = f.select(*[c.alias(n) for c, n in zip(etl.from_file_name(F.col("f")), "abc")]).collect()
    assert tuple(got[0]) == ("lucorum", "F", "lucorum-F-12") and tuple(got[1]) == (None, None, None)
    pts = [(0.0, 0.0), (10.0, 0.0)] + [(5.0, 1.0)] * 4 + [(5.0, 9.0)] + [(5.0, 1.0)] * 5 + [(5.0, -9.0)]
    rows = frame(spark, [('a"b', [{"x": x, "y": y} for x, y in pts])], "f string, p array<struct<x: double, y: double>>")
    turned = rows.select(etl.canonical_landmarks(F.col("p")).alias("p")).first().p
    assert turned[0].x < turned[1].x and turned[6].y < turned[12].y
    assert etl.landmark_lines(rows, "p", "f", 14).first().value.startswith('"a""b",0.00,0.00,10.00,0.00') and etl.landmark_lines(rows, "p", "f", 14).first().value.endswith(",,")


def test_contracts(spark):
    rows = frame(spark, [(1, "g", "a", [1.0]), (2, "g", "b", [2.0])], "id long, group string, label string, vector array<double>")
    with pytest.raises(ContractError, match="groups_with_two_labels"):
        model.check(rows)
    v = frame(spark, [("v", [1.0, float("nan")]), ("w", None)], "version string, shape array<double>")
    assert references.violations(v, ["shape"], {"shape": 3}).first().asDict() == {"missing_shape": 1, "length_shape": 1, "nonfinite_shape": 1, "extra_versions": 1}


def test_model_on_clusters(spark):
    r = np.random.default_rng(0)
    rows = [(i, f"g{i // 2}", "a" if i < 60 else "b", [float(x) for x in r.normal(0, 0.35, 6) + ([1, 1, 1, 0, 0, 0] if i < 60 else [-1, -1, -1, 0, 0, 0])]) for i in range(120)]
    df = frame(spark, rows, "id long, group string, label string, vector array<double>")
    s = evaluate.summary(model.cross_validate(df, 3)).first()
    assert s.evaluated == 120 and s.balanced_accuracy > 0.9
    m = model.fit(df.where("id % 10 < 8"))
    out = model.evaluate_external(m, df.where("id % 10 >= 8"), df.where("id % 10 < 8"))
    assert out[0].first().accuracy > 0.9
    with pytest.raises(ContractError):
        model.assert_external(m, df, df)


def test_nonconformity_is_over_all_references(spark, monkeypatch):
    monkeypatch.setattr(similarity, "WIDE", 64)
    r = np.random.default_rng(3)
    rows = [(i, "a" if i < 300 else "b" if i < 340 else "c", f"g{i // 2 if i < 300 else i // 3}", [float(x) for x in r.normal(0, 0.1, 4) + (0 if i < 300 else 5)]) for i in range(345)]
    refs = frame(spark, rows, "id long, label string, group string, vector array<double>")
    asks = frame(spark, [(1000 + i, "c" if i else "a", f"q{i}", [float(x) for x in r.normal(0, 0.1, 4)]) for i in range(5)], "id long, label string, group string, vector array<double>")
    for metric in ("euclidean", "cosine"):
        got = {(x.query_id, x.label): x.score for x in model._nonconformity(asks, refs, metric).collect()}
        want = {}
        for q in asks.collect():
            for label in "abc":
                best = {}
                for _, own, group, v in rows:
                    if own == label:
                        a, b = np.array(q.vector), np.array(v)
                        s = -np.sqrt(((a - b) ** 2).sum()) if metric == "euclidean" else a @ b / np.sqrt((a @ a) * (b @ b))
                        best[group] = max(best.get(group, -np.inf), s)
                want[q.id, label] = 1 - np.mean(sorted(best.values())[-3:])
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_shapes():
    r = np.random.default_rng(1)
    a = r.normal(size=(19, 2))
    c, s = np.cos(0.7), np.sin(0.7)
    assert shape.procrustes_distance(a, 3 * a @ np.array([[c, s], [-s, c]]) + 5) < 1e-9
    shapes = np.stack([(a if k % 2 else a * [1, 1.3]) + r.normal(0, 0.02, a.shape) for k in range(40)])
    labels = ["x" if k % 2 else "y" for k in range(40)]
    x = shape.gpa(shapes)[0].reshape(len(shapes), -1)
    m = shape.ShapeLda.fit(x, labels)
    assert np.mean([p == t for p, t in zip(m.predict(x), labels)]) == 1
    assert np.allclose(m.probabilities(x).sum(1), 1)
    with pytest.raises(ValueError):
        shape.Lda.fit(np.ones((4, 2)), ["a", "a", "b", "b"])
    scores = np.where(np.arange(50)[:, None] % 5 < 3, [[20.0, 0.0]], [[0.0, 20.0]])
    assert shape.fit_temperature(scores, np.zeros(50, int)) > 10
    pts = a.copy()
    pts[3] += 1
    assert shape.outliers(a, pts).tolist() == [3]
    mtx = np.array([[2, 0, 1], [0, 4, 2], [0, 0, 1.0]])
    assert np.allclose(shape.apply_affine(shape.inverse_affine(mtx), shape.apply_affine(mtx, a)), a)


def test_mean_shapes_are_of_all_rows(spark, tmp_path):
    from specton.plans import analysis

    r = np.random.default_rng(2)
    a, b = r.normal(size=(2, 38))
    rows = [(i, 1 if i < 600 else 2, [float(x) for x in r.normal(0, 0.05, 38) + (a if i < 500 else b)]) for i in range(620)]
    frame(spark, rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {x.id: x.distance for x in analysis.shape_distances(spark, str(tmp_path)).collect()}
    for label in (1, 2):
        own = {i: np.array(v, np.float32).astype(float).reshape(19, 2) for i, x, v in rows if x == label}
        turned = [shape.centre_and_scale(v) for v in own.values()]
        mean = turned[0]
        for _ in range(20):
            mean = shape.centre_and_scale(np.mean([shape.rotate_onto(v, mean) for v in turned], 0))
        assert all(abs(got[i] - shape.procrustes_distance(v, mean)) < 2e-6 for i, v in own.items())


def test_projections(spark):
    p = projection.sparse_projection(20, 100)
    assert all(len(set(row)) == 6 for row in p)
    with pytest.raises(ValueError):
        projection.sparse_projection(6)
    rows = frame(spark, [(1, [float(k) for k in range(20)]), (2, [0.0] * 20)], "id long, vector array<double>")
    got = {r.id: list(r.tag) for r in projection.tags(rows, p).collect()}
    assert len(got[1]) == 5 and got[2] == []


def test_bootstrap(spark):
    rows = frame(spark, [("a", "a")] * 30 + [("a", "b")] * 10 + [("b", "b")] * 20, "truth string, predicted string")
    r = evaluate.bootstrap(rows).first()
    assert 0.75 < r.low < 0.875 < r.high <= 1
    assert evaluate.bootstrap(rows.limit(31).union(frame(spark, [("b", "b")], "truth string, predicted string"))).first().low is None


def test_catalog_and_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 100


def test_walk_by_joins_equals_the_local_walk(spark):
    """Two queries with rows of their own in a graph that they share; node 5 has no way out."""
    base = [(1, 2, 0.5), (1, 3, 0.5), (2, 1, 1.0), (3, 5, 1.0), (4, 1, 1.0)]
    own = [(7, -1, 1, 0.25), (7, -1, 4, 0.75), (7, 2, -1, 1.0), (8, -1, 3, 1.0)]
    b = spark.createDataFrame(base, "src long, dst long, p double")
    o = spark.createDataFrame(own, "query long, src long, dst long, p double")
    starts = spark.createDataFrame([(7, -1), (8, -1)], "query long, node long")
    whole = [(q, s, d, p) for q in (7, 8) for s, d, p in base if not any(x[:2] == (q, s) for x in own)] + own
    want = graph.walk_distributions(spark.createDataFrame(whole, "query long, src long, dst long, p double"), starts, steps=9).where("step = 9")
    got = {(r.query, r.node): r.p for r in graph.walk(b, o, starts, steps=9).collect() if r.p > 0}
    want = {(r.query, r.node): r.p for r in want.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_landmark_blocks(spark):
    rows = [(1, [(1.0, 2.0), (3.0, 4.0)], [0.0, -2.0, 5.0, 2.0, 0.0, 1.0, 0.0, 0.0, 1.0], True), (2, [(1.0, 2.0), None], [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], True), (3, [(1.0, None)], None, None), (4, [], [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], True), (5, None, None, True), (6, [(1.0, 2.0)], [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], False)]
    df = spark.createDataFrame(rows, "id int, points array<struct<x double, y double>>, matrix array<double>, confirmed boolean")
    got = df.select("id", etl.landmark_block(F.col("points"), F.col("matrix"), F.col("confirmed")).alias("b"), etl.mapped(etl.mapped(F.col("points"), F.col("matrix")), etl.inverse(F.col("matrix"))).alias("back"), etl.from_upward(F.col("points"), F.lit(10)).alias("down"))
    out = {r.id: r for r in got.collect()}
    assert out[1].b == [1.0, 3.0, -3.0, 7.0] and [out[i].b for i in range(2, 7)] == [None] * 5
    assert [(p.x, p.y) for p in out[1].back] == [(1.0, 2.0), (3.0, 4.0)] and out[2].back[1] is None and out[5].back is None
    assert [(p.x, p.y) for p in out[1].down] == [(1.0, 7.0), (3.0, 5.0)] and out[2].down[1] is None and out[3].down == [None]
    with pytest.raises(Exception, match="no inverse"):
        spark.sql("SELECT array(1.0D, 2.0D, 0.0D, 2.0D, 4.0D, 0.0D, 0.0D, 0.0D, 1.0D) AS m").select(etl.inverse(F.col("m"))).collect()


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_blocks_and_slices_keep_the_best(spark, monkeypatch, metric):
    """Small blocks and slices, many ties, a vector that isn't a number; lists are as short as they are asked to be."""
    monkeypatch.setattr(similarity, "WIDE", 7)
    monkeypatch.setattr(similarity, "BLOCK", 9)
    monkeypatch.setattr(similarity, "SLICE", 20)
    r = np.random.default_rng(3)
    v = r.integers(-1, 2, (40, 3)).astype(float) + 0.25
    rows = [(i, f"g{i // 2}", "ab"[i // 2 % 2], v[i].tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, group string, label string, vector array<double>")
    s = similarity._similarities(v, v, metric)
    wide = (v @ v.T / np.sqrt((v * v).sum(1)[:, None] * (v * v).sum(1)) if metric == "cosine" else -np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))).astype(np.float32)
    assert np.allclose(s, wide, atol=1e-6)
    near = {}
    for x in similarity.neighbours(df, df, 4, metric, exclude="group").orderBy("rank").collect():
        near.setdefault(x.query_id, []).append(x.ref_id)
    for i in range(40):
        assert near[i] == sorted((j for j in range(40) if j // 2 != i // 2), key=lambda j: (-wide[i, j], j))[:4]
    lists = similarity.group_similarities(df, df, 1, metric, overall=3)
    own = similarity.group_similarities(df, df, 2, metric, own_label=True)
    assert own.join(df.select(F.col("id").alias("query_id"), F.col("label").alias("l")), "query_id").where("l <> label").count() == 0
    found, labelled = {}, {}
    for x in lists.collect():
        found.setdefault(x.query_id, []).append((-x.similarity, x.group))
    for x in own.collect():
        labelled.setdefault(x.query_id, []).append((-x.similarity, x.group))
    for i in range(40):
        best = {}
        for j in range(40):
            if j != i:
                best[f"g{j // 2}"] = max(best.get(f"g{j // 2}", -np.inf), wide[i, j])
        order = sorted(best, key=lambda g: (-best[g], g))
        same = [g for g in order if int(g[1:]) % 2 == i // 2 % 2]
        assert [g for _, g in sorted(found[i])][:3] == order[:3] and [g for _, g in sorted(labelled[i])][:2] == same[:2]
    nan = df.withColumn("vector", F.when(F.col("id") == 3, F.array(*[F.lit(float("nan"))] * 3)).otherwise(F.col("vector")))
    assert similarity.neighbours(nan, nan, 2, metric).count() == 80


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("run", [1, 8, 64])
def test_screened_pairs_are_those_of_double_precision(monkeypatch, metric, run):
    """The best of each part and of all, and pairs over a bar: with ties, far from the origin, copies, and groups of several rows."""
    monkeypatch.setattr(similarity, "RUN", run)
    monkeypatch.setattr(similarity, "PRODUCT", 64)
    r = np.random.default_rng(run)
    for kind in range(4):
        n, h, d = 500, 9, 6
        x, q = r.normal(size=(n, d)), r.normal(size=(h, d))
        if kind == 1:
            x, q = np.round(x), np.round(q)
        elif kind == 2:
            x, q = x + 1e3, q + 1e3
        elif kind == 3:
            x[:] = x[r.integers(0, 40, n)]
            q[:5] = x[:5]
        label = np.sort(r.integers(0, 4, n))
        bounds = np.append(np.flatnonzero(np.diff(label, prepend=-1)), n)
        group = np.cumsum((r.random(n) < 0.7) | (np.diff(label, prepend=-1) > 0)) - 1
        order = r.permutation(group.max() + 1)
        dropped = (r.integers(0, h, 20), r.integers(0, n, 20))
        screen = similarity.Screen(x, metric, bounds)
        every = similarity._exact(similarity._unit(q) if metric == "cosine" else q, screen.r, np.repeat(np.arange(h), n), np.tile(np.arange(n), h), metric).reshape(h, n)
        bar = r.choice(every.ravel(), n).astype(np.float32)
        bar[::50] = -np.inf
        by = np.argsort(bar)
        rows, at, value = similarity.Screen(x[by], metric, np.array([0, n])).above(q, bar[by])
        assert {(a, int(by[b])) for a, b in zip(rows.tolist(), at, strict=True)} == {(a, b) for a, b in zip(*(k.tolist() for k in np.nonzero(every > bar)), strict=True)}
        every[dropped] = -np.inf
        first = np.flatnonzero(np.diff(group, prepend=-1))
        best = np.maximum.reduceat(every, first, axis=1)
        wanted = set()
        for k, part in [*((3, label[first] == x) for x in range(4)), (5, label[first] >= 0)]:
            for i in range(h):
                at = np.flatnonzero(part & (best[i] > -np.inf))
                wanted |= {(i, int(g), float(best[i, g])) for g in at[np.lexsort((order[at], -best[i, at]))][:k]}
        rows, at, value = screen.best(q, dropped, order[group], 3, 5, group)
        got = [(int(i), int(group[a]), float(v)) for i, a, v in zip(rows, at, value, strict=True)]
        assert len(got) == len(wanted) and set(got) == wanted


def test_screen_leaves_numbers_it_cant_hold():
    x = np.array([[1e30, 1.0], [0.0, np.nan], [2.0, 1.0]])
    assert similarity.Screen(x, "euclidean", np.array([0, 3])).best(x[2:], (np.array([], int),) * 2, np.arange(3), 1) is None
    assert similarity.Screen(x[2:], "cosine", np.array([0, 1])).best(x[1:2], (np.array([], int),) * 2, np.arange(1), 1) is None
