"""Frozen models: written and read they score alike, every rule of the contract raises by name, and tests see no row twice."""

import math
import threading
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from specton.operators import frozen, model
from specton.operators.lineage import at_once
from specton.operators.references import ContractError

ROWS = "id long, group string, label string, vector array<double>"
LANDMARKS = model.Layout((("landmarks", 14), ("shape", 3)))
RAY = model.Layout((("shape", 4),))


def wings(n=14, seed=0, first=0):
    """n groups of each of two labels, two views each, of 7 landmarks under any position, turn and size, and three numbers."""
    r = np.random.default_rng(seed)
    base = np.random.default_rng(99).normal(size=(7, 2))
    out = []
    for label, wide in (("a", 1.0), ("b", 1.25)):
        for g in range(n):
            own = base * [1, wide] + r.normal(0, 0.04, (7, 2))
            for _ in range(2):
                t = r.uniform(0, 6)
                p = (own + r.normal(0, 0.01, (7, 2))) @ np.array([[math.cos(t), math.sin(t)], [-math.sin(t), math.cos(t)]]) * r.uniform(1, 4) + r.normal(0, 5, 2)
                out.append((first + len(out), f"{label}{first + g}", label, [*p.ravel().tolist(), *(r.normal(0, 1, 3) + (label == "a")).tolist()]))
    return out


def ray(label, value):
    return [value, 0.0, 0.0, 0.0]


def rays():
    return [(i, f"animal-{i}", "A" if i < 45 else "B", ray("", -2 - i / 100 if i < 45 else 2 + i / 100)) for i in range(90)]


@pytest.fixture(scope="module")
def landmarks(spark):
    return frozen.freeze(spark.createDataFrame(wings(), ROWS), LANDMARKS, scheme="points-7", preprocessing_version="n-1")


@pytest.fixture(scope="module")
def angular(spark):
    return frozen.freeze(spark.createDataFrame(rays(), ROWS), RAY)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_written_and_read_it_scores_alike(spark, landmarks, tmp_path):
    path = f"{tmp_path}/model"
    frozen.save(landmarks, path)
    again = frozen.load(spark.newSession(), path)
    asked = spark.createDataFrame(wings(6, 1, 1000), ROWS)
    a, b = (rows_of(frozen.classify(m, asked)) for m in (landmarks, again))
    assert a == b and len(a) == 24
    assert np.mean([r[2] == r[3] for r in a]) > 0.6
    p, q = (rows_of(frozen.probabilities(m, asked)) for m in (landmarks, again))
    assert p == q
    total = {}
    for i, _, x in p:
        total[i] = total.get(i, 0) + x
    assert all(abs(t - 1) < 1e-9 for t in total.values())
    row = again.row
    assert row.primary == "lda" and row.primary_policy == "landmarks-first-distance-fallback" and row.n_rows == 56
    assert {r.method for r in again.evaluation.collect()} == {"distance", "knn", "walk", "lda"}
    assert again.readiness.where("status = 'ready'").count() == 2
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        frozen.save(landmarks, path)


def test_turned_scaled_and_shifted_landmarks_score_alike(spark, landmarks):
    rows = wings(3, 2, 2000)
    c, s = math.cos(0.4) * 2.5, math.sin(0.4) * 2.5
    moved = [(i, g, x, [*(np.reshape(v[:14], (7, 2)) @ np.array([[c, s], [-s, c]]) + [300, -80]).ravel().tolist(), *v[14:]]) for i, g, x, v in rows]
    a, b = ({(r.id, r.label): r.p for r in frozen.probabilities(landmarks, spark.createDataFrame(x, ROWS)).collect()} for x in (rows, moved))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-6 for k in a)


def test_repeated_views_change_nothing(spark, angular):
    rows = rays()
    more = frozen.freeze(spark.createDataFrame(rows + [(1000 + k, *rows[50][1:]) for k in range(12)], ROWS), RAY)
    assert rows_of(more.references) == rows_of(angular.references) and rows_of(more.calibration) == rows_of(angular.calibration)
    assert rows_of(more.evaluation) == rows_of(angular.evaluation)
    assert more.row.fingerprint == angular.row.fingerprint and more.row.n_references == 72
    assert more.references.where("views > 1").count() == 0


def test_parameters_come_from_training_groups_alone(spark, angular):
    training = {r.group for r in angular.references.collect()}
    own = [v[0] for _, g, _, v in rays() if g in training]
    assert abs(angular.row["mean"][0] - np.mean(own)) < 1e-6
    assert not training & {r.group for r in angular.calibration.collect()} and len(training) == 72


def test_far_rows_are_unknown(spark, angular):
    asked = spark.createDataFrame([(1, "in", "B", ray("", 2.655)), (2, "out", None, ray("", 2000.0))], ROWS)
    got = {r.query_id: r for r in frozen.classify(angular, asked).collect()}
    assert "B" in got[1].labels and got[1].valid and not got[1].unknown
    assert got[2].labels == [] and got[2].unknown


def broken(doc):
    """Documents that break one rule each, by the rule's name."""
    c = lambda **x: doc.withColumn("classifier", F.col("classifier").withField(*next(iter((k, F.lit(v)) for k, v in x.items()))))
    short = lambda n: doc.withColumn(n, F.slice(n, 1, 2))
    bad = lambda n: doc.withColumn(n, F.transform(n, lambda x, i: F.when(i == 0, F.lit(float("nan"))).otherwise(x).cast("float")))
    with_ = lambda n, v: doc.withColumn(n, F.lit(v))
    return {
        "version": with_("version", "specton-model-1"), "policy": with_("policy", "x"), "protocol": with_("protocol", "jackknife"), "metric": with_("metric", "cosine"), "primary": with_("primary", "forest"),
        "primary_without_lda": with_("primary", "lda").withColumn("lda", F.lit(None).cast(doc.schema["lda"].dataType)), "alpha": c(alpha=1.5), "epsilon": c(epsilon=0.0), "power": c(power=float("inf")), "balanced": c(balanced=None),
        "k": c(k=0), "steps": c(steps=-1), "votes": c(votes=0), "nearest": c(nearest=0), "blocks": doc.withColumn("blocks", F.slice("blocks", 1, 0)),
        "length_mean": short("mean"), "length_sd": short("sd"), "length_weight": short("weight"), "finite_mean": bad("mean"), "finite_sd": bad("sd"), "finite_weight": bad("weight"),
        "deviations": doc.withColumn("sd", F.transform("sd", lambda x: (-x).cast("float"))), "landmark_mean": short("landmark_mean"),
        "lda_shape": doc.withColumn("lda", F.col("lda").withField("offsets", F.slice("lda.offsets", 1, 1))), "reference_lengths": doc.withColumn("blocks", F.slice("blocks", 1, 1)).withColumn("mean", F.slice("mean", 1, 14)),
        "reference_count": doc.withColumn("n_references", F.col("n_references") + 1), "calibration_count": doc.withColumn("n_calibration", F.col("n_calibration") + 1), "fingerprint": with_("fingerprint", "0"),
    }


def test_every_rule_raises_by_its_name(spark, landmarks):
    frozen.contract(landmarks)
    names = list(broken(landmarks.document))
    assert len(names) > 25
    for name in names:
        doc = spark.createDataFrame(broken(landmarks.document)[name].collect(), landmarks.document.schema)
        if name == "reference_lengths":
            doc = doc.withColumn("sd", F.slice("sd", 1, 14)).withColumn("weight", F.slice("weight", 1, 14))
        with pytest.raises(ContractError, match=rf"\b{name}\b"):
            frozen.contract(replace(landmarks, document=doc))


def test_rules_of_the_tables(spark, landmarks):
    refs, cal = landmarks.references, landmarks.calibration
    group = refs.first().group
    cases = {
        "reference_groups": replace(landmarks, references=refs.withColumn("group", F.lit("one"))), "reference_labels": replace(landmarks, references=refs.withColumn("label", F.lit(None).cast("string"))),
        "reference_values": replace(landmarks, references=refs.withColumn("vector", F.transform("vector", lambda x: F.lit(float("nan")).cast("float")))), "missing_labels": replace(landmarks, references=refs.withColumn("label", F.lit("a"))),
        "calibration_groups": replace(landmarks, calibration=cal.withColumn("group", F.lit("one"))), "calibration_scores": replace(landmarks, calibration=cal.withColumn("score", F.lit(float("inf")))),
        "unknown_calibration_labels": replace(landmarks, calibration=cal.withColumn("label", F.lit("z"))), "calibration_groups_among_references": replace(landmarks, calibration=cal.withColumn("group", F.lit(group))),
        "fingerprint": replace(landmarks, calibration=cal.withColumn("score", F.col("score") + 0.1)),
    }
    for name, case in cases.items():
        with pytest.raises(ContractError, match=rf"\b{name}\b"):
            frozen.contract(case)


def test_queries_have_to_fit(spark, landmarks):
    df = spark.createDataFrame(wings(1, 5, 3000), ROWS)
    for name, asked in {
        "feature_version": df.withColumn("feature_version", F.lit("2")), "preprocessing_version": df.withColumn("preprocessing_version", F.lit(None).cast("string")), "landmark_scheme": df.withColumn("landmark_scheme", F.lit("other")),
        "vector_length": df.withColumn("vector", F.slice("vector", 1, 3)), "without_vector": df.withColumn("vector", F.lit(None).cast("array<double>")), "vector_values": df.withColumn("vector", F.transform("vector", lambda x, i: F.when(i == 2, float("nan")).otherwise(x))),
    }.items():
        with pytest.raises(ContractError, match=name):
            frozen.classify(landmarks, asked)
    assert frozen.classify(landmarks, df.withColumn("feature_version", F.lit("1")).withColumn("preprocessing_version", F.lit("n-1"))).count() == 4


def test_training_needs_labels_groups_and_variation(spark):
    df = spark.createDataFrame(rays(), ROWS)
    with pytest.raises(ContractError, match="missing_labels"):
        frozen.freeze(df.where("label = 'A'"), RAY)
    with pytest.raises(ContractError, match="without_group_or_label"):
        frozen.freeze(df.withColumn("group", F.when(F.col("id") > 0, F.col("group"))), RAY)
    with pytest.raises(ContractError, match="sources_of_two_groups"):
        frozen.freeze(df.withColumn("source_hash", F.when(F.col("id") < 2, "same")), RAY)
    with pytest.raises(ContractError, match="vector_length"):
        frozen.freeze(df, model.Layout((("shape", 5),)))
    with pytest.raises((ContractError, ValueError)):
        frozen.freeze(df.withColumn("vector", F.array(*[F.lit(1.0)] * 4)), RAY)


def test_external_evaluation(spark, angular):
    new = [(901, "new-A", "A", ray("", -2.205)), (902, "new-B", "B", ray("", 2.655)), (903, "novel", "C", ray("", 2000.0))]
    df = spark.createDataFrame(new, ROWS)
    got = frozen.evaluate_external(angular, df)
    own = {(r.method, r.unit): r for r in got.methods.collect()}
    assert own["distance", "group"].evaluated == 2 and own["distance", "group"].accuracy == 1
    assert got.sets.first().groups == 2
    novel = got.novel.first()
    assert (novel.label, novel.rate) == ("C", 1)
    row = rays()[0]
    for name, case in {
        "shared_group": [(999, row[1], "A", ray("", 5.5))], "shared_id": [(row[0], "x", "A", ray("", 5.5))], "shared_view": [(999, "x", "A", row[3])], "without_label": [(999, "x", " ", ray("", 5.5))], "no_rows": [],
    }.items():
        with pytest.raises(ContractError, match=name):
            frozen.evaluate_external(angular, spark.createDataFrame(case, ROWS))
    with pytest.raises(ContractError, match="sources_of_two_groups"):
        frozen.evaluate_external(angular, df.withColumn("source_hash", F.lit("same")))


def test_external_probabilities_are_told_by_group(spark, landmarks):
    got = frozen.evaluate_external(landmarks, spark.createDataFrame(wings(5, 8, 5000), ROWS))
    assert {r.method for r in got.methods.collect()} == {"distance", "knn", "walk", "lda"}
    assert got.reliability.agg(F.sum("n")).first()[0] == 10
    stats = got.calibration.first()
    assert 0 <= stats.brier <= 2 and abs(stats.top_probability - stats.hit) < 0.5


def test_freezing_takes_few_jobs_side_by_side(spark):
    sc = spark.sparkContext
    sc.setJobGroup("freeze", "")
    try:
        frozen.freeze(spark.createDataFrame(rays(), ROWS), RAY)
        jobs = sc.statusTracker().getJobIdsForGroup("freeze")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(jobs) < 250  # 272 when every step waited for the one before


def test_steps_at_once_run_together_and_the_first_error_comes_first(spark):
    barrier, seen = threading.Barrier(3, timeout=60), []

    def step(n, fails=False):
        barrier.wait()
        seen.append(spark.sparkContext.getLocalProperty("spark.test.own"))
        if fails:
            raise ValueError(str(n))
        return spark.range(n).count()

    spark.sparkContext.setLocalProperty("spark.test.own", "x")
    try:
        assert at_once(lambda: step(3), lambda: step(5), lambda: step(7)) == [3, 5, 7]
        with pytest.raises(ValueError, match="5"):
            at_once(lambda: step(3), lambda: step(5, True), lambda: step(7, True))
    finally:
        spark.sparkContext.setLocalProperty("spark.test.own", None)
    assert seen == ["x"] * 6
