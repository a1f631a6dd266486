"""Sums of outer products, discriminants, leaving out, folds and evaluation of all methods against direct computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from specton.functions import shape
from specton.operators import conformal, discriminant, folds, model, morphometrics, scatter, similarity

ROWS = "id long, group string, label string, vector array<double>"


def made(n=30, dims=6, views=1, labels="abc", seed=0, apart=1.5):
    """n groups of each label, with views; labels differ in the first dimensions."""
    r = np.random.default_rng(seed)
    centre = {x: r.normal(0, apart, dims) for x in labels}
    mix = r.normal(size=(dims, dims))
    out = []
    for x in labels:
        for g in range(n):
            own = centre[x] + r.normal(size=dims) @ mix * 0.7
            out += [(len(out) + v, f"{x}{g}", x, (own + r.normal(0, 0.05, dims)).tolist()) for v in range(views)]
    return [(i, *row[1:]) for i, row in enumerate(out)]


def arrays(rows):
    return np.array([r[3] for r in rows]), [r[2] for r in rows]


def test_scatter_is_the_sum_of_outer_products(spark):
    rows = made()
    x, y = arrays(rows)
    df = spark.createDataFrame([*rows, (900, "z", None, [1.0] * 6), (901, "z", "a", None)], ROWS).repartition(7).withColumn("key", (F.col("id") % 2).cast("string"))
    s = scatter.scatter(df)[None]
    assert s.labels == ["a", "b", "c"] and s.n == len(rows)
    assert np.allclose(s.total / (s.n - 1), np.cov(x.T), atol=1e-10)
    means = {k: x[[v == k for v in y]].mean(0) for k in "abc"}
    assert np.allclose(s.means, [means[k] for k in "abc"], atol=1e-12)
    z = x - [means[k] for k in y]
    assert np.allclose(s.within, z.T @ z, atol=1e-9)
    keyed = scatter.scatter(df, "key")
    assert np.allclose(keyed["1"].total, np.cov(x[1::2].T) * (len(x[1::2]) - 1), atol=1e-9)
    less = s.without("b", x[[i for i, r in enumerate(rows) if r[1] == "b4"]])
    again = scatter.scatter(spark.createDataFrame([r for r in rows if r[1] != "b4"], ROWS))[None]
    assert np.allclose(less.within, again.within, atol=1e-9) and np.allclose(less.mean, again.mean)
    assert scatter.scatter(df.limit(0)) == {}


def test_principal_components(spark):
    rows = made()
    x, _ = arrays(rows)
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    pca = scatter.scatter(df)[None].pca(3)
    got = {r.id: r.pc for r in scatter.project(df, pca).collect()}
    u, w, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    want = u[:, :3] * w[:3]
    own = np.array([got[i] for i in range(len(rows))])
    assert np.allclose(np.abs(own), np.abs(want), atol=1e-9)
    assert np.allclose(pca.explained, (w**2 / (w**2).sum())[:3], atol=1e-9)
    points = [(i, "g", "a", [float(i), 2.0 * i + (i % 2) * 0.1, 0.5]) for i in range(20)]
    flat = np.array([r.pc for r in scatter.plane(spark.createDataFrame(points, ROWS)).collect()])
    spread = np.ptp(flat, axis=0)
    assert spread[0] > 40 * spread[1]
    assert [r.pc for r in scatter.plane(spark.createDataFrame(points[:1], ROWS)).collect()] == [[0.0, 0.0]]


@pytest.mark.parametrize("shrinkage", ["auto", 0.05])
def test_discriminants_equal_a_fit_in_one_process(spark, shrinkage):
    rows = made(dims=8)
    x, y = arrays(rows)
    df = spark.createDataFrame(rows, ROWS).repartition(6).withColumn("key", F.lit("k"))
    ref = shape.ShapeLda.fit(x, y, shrinkage=shrinkage)
    got = discriminant.fit(df, "key", shrinkage=shrinkage)["k"]
    assert abs(got.lda.share - ref.lda.share) < 1e-9
    assert np.allclose(got.scores(x), ref.scores(x), atol=1e-7)
    p = {(r.id, r.label): r.p for r in discriminant.probabilities(df, {"k": got}, "key").collect()}
    assert np.allclose([[p[i, k] for k in "abc"] for i in range(len(x))], ref.probabilities(x), atol=1e-9)
    best = {r.id: r.predicted for r in discriminant.predicted(discriminant.probabilities(df, {"k": got}, "key")).collect()}
    assert [best[i] for i in range(len(x))] == ref.predict(x)


def test_shrinkage_grows_when_rows_are_few():
    r = np.random.default_rng(4)

    def share(n, d):
        f = r.random((n, 1)) - 0.5
        z = f * (1 + np.arange(d) / d) + 0.05 * (r.random((n, d)) - 0.5)
        return shape.ledoit_wolf(z - z.mean(0))

    plenty, scarce = share(2000, 5), share(6, 40)
    assert 0 <= plenty < 0.05 and 3 * plenty < scarce <= 1


@pytest.mark.parametrize(("views", "block"), [(1, (16384, 256)), (2, (17, 4))])
def test_left_out_scores_equal_refits(spark, monkeypatch, views, block):
    """Also with several views a group, and with many small blocks; a label's only group has no scores."""
    monkeypatch.setattr(discriminant, "ROWS", block[0])
    monkeypatch.setattr(discriminant, "GROUPS", block[1])
    rows = made(10, dims=7, views=views)
    x, y = arrays(rows)
    group = [r[1] for r in rows]
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    got = {r.id: r.scores for r in discriminant.left_out_scores(df).collect()}
    for i in range(len(rows)):
        keep = [j for j in range(len(rows)) if group[j] != group[i]]
        ref = shape.ShapeLda.fit(x[keep], [y[j] for j in keep])
        assert np.allclose(got[i], ref.scores(x[i : i + 1])[0], atol=1e-6), i
    lone = discriminant.left_out_scores(df.where("label <> 'c' OR group = 'c0'"))
    assert {r.group for r in lone.where("scores IS NULL").join(df.select("id", "group"), "id").collect()} == {"c0"}


def test_left_out_scores_by_moments_and_by_pairs(spark, monkeypatch):
    """Moments give what pairs of blocks give, and then no row meets another."""
    df = spark.createDataFrame(made(8, dims=6, views=2), ROWS).repartition(3)
    read = lambda: {r.id: r.scores for r in discriminant.left_out_scores(df).collect()}
    with monkeypatch.context() as m:
        m.setattr(discriminant, "_with_quartics", None)
        a = read()
    monkeypatch.setattr(discriminant, "MOMENTS", 0)
    b = read()
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], rtol=1e-9) for k in a)


def test_temperature(spark):
    r = np.random.default_rng(2)
    scores, truth = r.normal(0, 6, (200, 3)), r.integers(0, 3, 200)
    df = spark.createDataFrame([("abc"[t], s.tolist()) for s, t in zip(scores, truth, strict=True)], "label string, scores array<double>").repartition(5)
    got = discriminant.fit_temperature(df, list("abc"))
    assert abs(np.log(got.value / shape.fit_temperature(scores, truth))) < 1e-5 and got.scored == 200
    assert discriminant.fit_temperature(df.limit(3), list("abc")).value is None
    wrong = [("AB"[i % 2], [20.0, 0.0] if (i % 5 < 3) == (i % 2 == 0) else [0.0, 20.0]) for i in range(50)]
    assert discriminant.fit_temperature(spark.createDataFrame(wrong, "label string, scores array<double>"), ["A", "B"]).value > 10


def test_calibrated_confidence_is_near_accuracy(spark):
    r = np.random.default_rng(12)
    sample = lambda t: r.normal(size=12) + np.where(np.arange(12) == 0, 0.6 if t else -0.6, 0)
    rows = [(i, f"s{i}", "AB"[i % 2], sample(i % 2).tolist()) for i in range(24)]
    m, t = discriminant.calibrated(spark.createDataFrame(rows, ROWS))
    truth = np.arange(400) % 2
    p = m.probabilities(np.stack([sample(k) for k in truth]))
    assert t.value > 0 and t.scored == 24
    assert abs(p.max(1).mean() - (p.argmax(1) == truth).mean()) < 0.15


def test_procrustes_means(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(5, 7, 2))
    rows = []
    for g in range(5):
        for k in range(1 if g == 0 else 4):
            a = r.uniform(0, 6)
            turn = np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])
            rows.append((len(rows), f"g{g}", ((base[g] + r.normal(0, 0.02, (7, 2))) @ turn.T * r.uniform(1, 3) + r.normal(size=2)).ravel().tolist()))
    df = spark.createDataFrame(rows, "id long, group string, v array<double>").repartition(4)
    got = {r.group: np.reshape(r.m, (7, 2)) for r in morphometrics.group_means(df).collect()}
    few = morphometrics.means(df, "group")
    for g in range(5):
        _, mean = shape.gpa(np.array([np.reshape(v, (7, 2)) for _, x, v in rows if x == f"g{g}"]))
        assert np.allclose(got[f"g{g}"], mean, atol=1e-8) and np.allclose(few[f"g{g}"], mean, atol=1e-8)


def test_folds_and_roles(spark):
    groups = [(f"{x}{g}", x) for x, n in (("a", 23), ("b", 12), ("c", 2), ("d", 1)) for g in range(n)]
    df = spark.createDataFrame(groups, "group string, label string")
    fold = {r.group: r.fold for r in folds.stratified(df).collect()}
    assert fold == {r.group: r.fold for r in folds.stratified(df.repartition(9)).collect()}
    sizes = [list(fold.values()).count(k) for k in range(5)]
    assert len(fold) == 38 and max(sizes) - min(sizes) <= 1
    assert all(max(n) - min(n) <= 1 for x in "ab" for n in [[sum(f == k for g, f in fold.items() if g[0] == x) for k in range(5)]])
    held = folds.stratified(df).select(F.col("fold").cast("string").alias("key"), "group")
    role = {(r.key, r.group): r.role for r in folds.roles(df, held).collect()}
    assert len(role) == 5 * 38
    for k in range(5):
        for x in "abcd":
            own = [v for (key, g), v in role.items() if key == str(k) and g[0] == x]
            rest = len(own) - own.count("test")
            assert own.count("calibration") == max(0, min(rest - 2, max(1, rest // 5)))
    with pytest.raises(ValueError):
        folds.with_calibration(df, ["label"], 0)


def walked(z, names, y, q):
    """The label of the walk from q in the 7-nearest graph of z with q as a node."""
    n = len(z)
    unit = lambda v: v / np.sqrt((v * v).sum(-1, keepdims=True))
    s, to = (unit(z) @ unit(z).T).astype(np.float32), (unit(z) @ unit(q)).astype(np.float32)
    p = np.zeros((n + 1, n + 1))
    weight = lambda x: max(0.0, float(x)) ** 3 + 1e-12
    for i in range(n):
        near = sorted((j for j in range(n) if j != i), key=lambda j: (-s[i, j], names[j]))[:7]
        row = {j: s[i, j] for j in near}
        if to[i] > s[i, near[-1]]:
            del row[near[-1]]
            row[n] = to[i]
        for j, x in row.items():
            p[i, j] = weight(x)
    for j in sorted(range(n), key=lambda j: (-to[j], names[j]))[:7]:
        p[n, j] = weight(to[j])
    p /= p.sum(1, keepdims=True)
    at = np.eye(n + 1)[n]
    for _ in range(40):
        at = 0.2 * np.eye(n + 1)[n] + 0.8 * at @ p
    score = {x: sum(at[j] for j in range(n) if y[j] == x) / y.count(x) for x in sorted(set(y))}
    return max(score, key=score.get)


def test_all_methods_by_the_same_folds(spark):
    """Every fold's predictions equal those of a pipeline that sees the other folds alone."""
    rows = made(15, dims=5, views=2, seed=3)
    df = spark.createDataFrame(rows, ROWS)
    held = model.fold_held(df, 3)
    got = model.evaluate_held(df, held)
    found = {(r.method, r.query_id): r.predicted for r in got.predictions.collect()}
    assert len(found) == 4 * len(rows)
    role = {(r.key, r.group): r.role for r in folds.roles(df.select("group", "label").distinct(), held).collect()}
    for key in "012":
        proto = {}
        for _, g, x, v in rows:
            if role[key, g] == "training":
                proto.setdefault((g, x), []).append(v)
        names, y, p = [g for g, _ in proto], [x for _, x in proto], np.array([np.mean(v, 0) for v in proto.values()])
        mean, sd = p.mean(0), p.std(0, ddof=1)
        z = (p - mean) / sd / np.sqrt(5)
        lda = shape.ShapeLda.fit(p, y)
        for i, g, _, v in rows:
            if role[key, g] == "test":
                assert found["lda", i] == lda.predict(np.array([v]))[0]
                q = (np.array(v) - mean) / sd / np.sqrt(5)
                for method, s in (("distance", -np.sqrt(((z - q) ** 2).sum(1))), ("knn", z @ q / np.sqrt((z * z).sum(1) * (q @ q)))):
                    top = sorted(range(len(z)), key=lambda j: (-np.float32(s[j]), names[j]))[:5]
                    votes = {}
                    for j in top:
                        votes[y[j]] = votes.get(y[j], 0) + (1 / (1 - s[j]) if method == "distance" else max(1e-6, s[j])) / y.count(y[j])
                    assert found[method, i] == max(sorted(votes), key=votes.get), (method, i)
                assert found["walk", i] == walked(z, names, y, q), i
    s = {(r.method, r.unit): r for r in model.method_summary(got.predictions).collect()}
    assert {m for m, _ in s} == set(model.METHODS)
    assert all(r.evaluated == (90 if unit == "view" else 45) for (_, unit), r in s.items())
    assert got.sets.count() == len(rows) and got.sets.where("valid").count() == 0  # three calibration groups a label are too few


def test_series_transfer(spark):
    rows = spark.createDataFrame(made(12), ROWS).withColumn("series", F.when(F.col("id") % 3 == 0, "x").when(F.col("id") % 3 == 1, "y").otherwise("z"))
    got = model.evaluate_held(rows, model.series_held(rows), ("distance",))
    assert {r.key: r["count"] for r in got.predictions.groupBy("key").count().collect()} == {"x": 12, "y": 12, "z": 12}
    with pytest.raises(model.ContractError, match="groups_in_two_series"):
        model.series_held(rows.unionByName(rows.withColumn("series", F.lit("w"))))
    with pytest.raises(model.ContractError, match="missing_series"):
        model.series_held(rows.withColumn("series", F.lit("w")))
    with pytest.raises(model.ContractError, match="without_series"):
        model.series_held(rows.withColumn("series", F.lit(None).cast("string")))


def test_jackknife_leaves_the_whole_group_out(spark, monkeypatch):
    monkeypatch.setattr(similarity, "WIDE", 16)
    monkeypatch.setattr(similarity, "ASKED", 8)
    rows = made(6, dims=4, views=2, seed=5)
    df = spark.createDataFrame(rows, ROWS)
    got = {r.group: (r.label, r.score) for r in conformal.jackknife(df).collect()}
    x, y = arrays(rows)
    x = x / np.sqrt((x * x).sum(1))[:, None]
    want = {}
    for i, g, label, _ in rows:
        best = {}
        for j, h, other, _ in rows:
            if h != g and other == label:
                best[h] = max(best.get(h, -2), x[i] @ x[j])
        score = 1 - np.mean(sorted(best.values())[-3:])
        want[g] = (label, max(want.get(g, (label, -1))[1], score))
    assert got.keys() == want.keys() and all(got[g][0] == want[g][0] and abs(got[g][1] - want[g][1]) < 1e-6 for g in want)
