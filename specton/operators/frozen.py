"""Frozen models: a versioned folder of Parquet tables that scores alike wherever it is read, and the contract it has to meet.

The document is one row: versions, layout, settings, packed single-precision parameters. Prototypes, calibration scores and the
provenance of all rows are tables beside it, of any size. A model is used only through these tables, also right after it
has been fitted, so what was written and read again gives the same rows. Every rule of the contract is a count that has to be
zero; a broken one raises with its name.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from specton.functions.shape import Lda, Pca, ShapeLda
from specton.functions.vectors import doubles
from specton.operators import conformal, discriminant, evaluate, folds, model, references
from specton.operators.lineage import at_once, cut
from specton.operators.references import ContractError, assert_none

#: Fixed values of the contract.
VERSION, POLICY, PROTOCOL, METRIC = "specton-model-2", "mean-distinct-views-per-group-1", "split-specimen-max", "euclidean"
CLASSIFIER = {"k": 7, "alpha": 0.2, "steps": 40, "power": 3.0, "votes": model.VOTES, "nearest": conformal.NEAREST, "epsilon": conformal.EPSILON, "balanced": True}

SCHEMA = """
version string, id string, name string, feature_version string, preprocessing_version string, landmark_scheme string,
blocks array<struct<block: string, dim: int>>, policy string, protocol string, metric string, primary string, primary_policy string,
classifier struct<k: int, alpha: double, steps: int, power: double, votes: int, nearest: int, epsilon: double, balanced: boolean>,
mean array<float>, sd array<float>, weight array<float>, landmark_mean array<float>,
lda struct<labels: array<string>, mean: array<float>, basis: array<array<float>>, explained: array<double>, weights: array<array<float>>, offsets: array<double>, temperature: double, share: double>,
n_references long, n_calibration long, n_rows long, fingerprint string
"""
TABLES = ("references", "calibration", "provenance", "evaluation", "readiness")


@dataclass
class Frozen:
    document: DataFrame  # one row of SCHEMA
    references: DataFrame  # id, group, label, views, vector
    calibration: DataFrame  # group, label, score
    provenance: DataFrame  # id, group, series, source_hash, view, role
    evaluation: DataFrame  # method, unit, evaluated, accuracy, balanced_accuracy
    readiness: DataFrame  # label, groups, rows, ...

    @property
    def row(self) -> Row:
        return self.document.first()


def _floats(x: np.ndarray | None) -> list[float] | None:
    return None if x is None else np.asarray(x, np.float32).ravel().tolist()


def _column(rows: DataFrame, name: str) -> Column:
    return (F.col(name) if name in rows.columns else F.lit(None)).cast("string").alias(name)


def distinct_views(rows: DataFrame) -> DataFrame:
    """The rows with view, a hash of their vector, and of each group's equal views only the one with the smallest id."""
    keyed = rows.withColumn("view", F.sha2(F.to_json(F.struct("vector")), 256))
    first = keyed.groupBy("group", "view").agg(F.min("id").alias("id"))
    return keyed.join(first, ["group", "view", "id"], "left_semi")


def _fingerprint(refs: DataFrame, calibration: DataFrame) -> str:
    """One value of everything that scores, whatever the order of rows."""
    own = refs.select(F.to_json(F.struct("id", "group", "label", "views", "vector")).alias("x")).unionByName(calibration.select(F.to_json(F.struct("group", "label", "score")).alias("x")))
    return references.fingerprint(own, "x").first().fingerprint


def freeze(rows: DataFrame, layout: model.Layout, name: str = "model", id: str | None = None, feature_version: str = "1", preprocessing_version: str | None = None, scheme: str | None = None, primary: str | None = None, folds_: int = folds.FOLDS) -> Frozen:
    """Fit, calibrate and evaluate on rows (id, group, label, vector; series, sex and source_hash if there are any). Without a chosen
    method landmarks are scored by discriminants and anything else by distance."""
    spark = rows.sparkSession
    rows = cut(rows.withColumn("vector", doubles("vector")).withColumn("group", F.col("group").cast("string")).withColumn("label", F.col("label").cast("string")))
    at_once(lambda: model.check(rows), lambda: _check_vectors(rows, layout))
    own = cut(distinct_views(rows))
    views = own.select("id", "group", "label", "vector")
    with_lda = layout.landmarks > 0
    calibrates, proto = at_once(
        lambda: cut(folds.with_calibration(views.select("group", "label").distinct(), ["label"]).where("held").select("group")),
        lambda: cut(model.group_prototypes(views, layout)),
    )
    chosen = primary or ("lda" if with_lda else "distance")

    def evaluated() -> DataFrame:
        found = model.evaluate_held(views, model.fold_held(views, folds_), model.METHODS if with_lda else ("distance", "knn", "walk"), layout, proto=proto)
        out = cut(model.method_summary(found.predictions))
        if not out.where((F.col("method") == chosen) & (F.col("evaluated") > 0)).limit(1).count():
            raise ContractError(f"no fold can be evaluated by {chosen}: more groups of each label are needed")
        return out

    ready = references.readiness(rows.select("label", "group", _column(rows, "series"), F.lit(1 if with_lda else None).alias("landmarks"), _column(rows, "sex")), "label", "group", "series", "landmarks", "sex")
    role = F.when(F.col("_c").isNotNull(), "calibration").otherwise("training")
    provenance = own.join(calibrates.withColumn("_c", F.lit(True)), "group", "left").select("id", "group", _column(own, "series"), _column(own, "source_hash"), "view", role.alias("role"))
    evaluation, (values, refs, calibration), provenance, ready = at_once(evaluated, lambda: _fitted(views, proto, calibrates, layout), lambda: cut(provenance), lambda: cut(ready))
    row = Row(
        version=VERSION, id=id or uuid.uuid4().hex, name=name, feature_version=feature_version, preprocessing_version=preprocessing_version, landmark_scheme=scheme,
        blocks=[Row(block=b, dim=n) for b, n in layout.blocks], policy=POLICY, protocol=PROTOCOL, metric=METRIC, primary=chosen,
        primary_policy="chosen" if primary else "landmarks-first-distance-fallback", classifier=Row(**CLASSIFIER), **values,
        n_references=refs.count(), n_calibration=calibration.count(), n_rows=own.count(), fingerprint=_fingerprint(refs, calibration),
    )
    return Frozen(spark.createDataFrame([row], SCHEMA), refs, calibration, provenance, evaluation, ready)


def _fitted(views: DataFrame, proto: DataFrame, calibrates: DataFrame, layout: model.Layout) -> tuple[dict, DataFrame, DataFrame]:
    """The packed parameters as the document names them, the references and the calibration scores."""
    training = cut(proto.join(calibrates, "group", "left_anti").withColumn("key", F.lit(model.ONLY)))
    spaces = model.fit_spaces(training, layout, lda=False)
    if not spaces.params:
        raise ContractError("no dimension varies")
    mean, sd, weight = (np.asarray(x, np.float32).astype(float) for x in spaces.params[model.ONLY])
    shape = spaces.shapes.get(model.ONLY)
    shape = None if shape is None else np.asarray(shape, np.float32).astype(float)
    spaces = replace(spaces, params={model.ONLY: (mean, np.where(weight == 0, 0.0, sd), weight)}, shapes={} if shape is None else {model.ONLY: shape})
    aligned = cut(spaces.aligned(model._typed(training, "views")))
    lda = None
    if layout.landmarks:
        m, t = discriminant.calibrated(aligned.select("id", "group", "label", F.slice("vector", 1, layout.landmarks).alias("vector")))
        lda = Row(labels=m.lda.labels, mean=_floats(m.pca.mean), basis=[_floats(b) for b in m.pca.basis.T], explained=m.pca.explained.tolist(), weights=[_floats(w) for w in m.lda.weights], offsets=m.lda.offsets.tolist(), temperature=t.value, share=m.lda.share)
    refs = cut(spaces.standardized(aligned).select("id", "group", "label", "views", F.col("vector").cast("array<float>").alias("vector")))
    spaces = replace(spaces, references=refs.withColumn("key", F.lit(model.ONLY)))
    calibration = cut(model.calibration_scores(spaces, views.join(calibrates, "group").withColumn("key", F.lit(model.ONLY))).select("group", "label", "score"))
    return {"mean": _floats(mean), "sd": _floats(np.where(weight == 0, 0.0, sd)), "weight": _floats(weight), "landmark_mean": _floats(shape), "lda": lda}, refs, calibration


def save(frozen: Frozen, path: str) -> None:
    """Write the tables to a new folder, the document last: without it a folder is no model."""
    at_once(*(partial(getattr(frozen, name).write.parquet, f"{path}/{name}") for name in TABLES))
    frozen.document.coalesce(1).write.parquet(f"{path}/document")


def load(spark: SparkSession, path: str) -> Frozen:
    """Read a model and hold it against the contract."""
    frozen = Frozen(spark.read.parquet(f"{path}/document"), *(spark.read.parquet(f"{path}/{name}") for name in TABLES))
    contract(frozen)
    return frozen


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def _all_finite(c: str) -> Column:
    return F.coalesce(F.forall(F.col(c), _finite), F.lit(False))


def contract(frozen: Frozen) -> None:
    """Raise ContractError naming every rule the model breaks. The version comes first: other versions have other rules."""
    doc = frozen.document
    holds = lambda c: F.count_if(~F.coalesce(c, F.lit(False)))
    assert_none(doc.agg(holds(F.col("version") == VERSION).alias("version"), (F.count("*") != 1).cast("int").alias("documents")))
    dims = F.aggregate("blocks", F.lit(0), lambda a, b: a + b["dim"])
    c = lambda name: F.col(f"classifier.{name}")
    marks = F.get(F.filter("blocks", lambda b: b["block"] == "landmarks"), 0)["dim"]
    rank = F.size("lda.basis")
    rules = {
        "policy": F.col("policy") == POLICY, "protocol": F.col("protocol") == PROTOCOL, "metric": F.col("metric") == METRIC,
        "primary": F.col("primary").isin(*model.METHODS), "primary_without_lda": (F.col("primary") != "lda") | F.col("lda").isNotNull(),
        "alpha": (c("alpha") >= 0) & (c("alpha") <= 1), "epsilon": (c("epsilon") > 0) & (c("epsilon") < 1), "power": _finite(c("power")) & (c("power") > 0), "balanced": c("balanced").isNotNull(),
        **{n: c(n) > 0 for n in ("k", "steps", "votes", "nearest")},
        "blocks": (F.size("blocks") > 0) & F.forall("blocks", lambda b: (b["dim"] > 0) & b["block"].isNotNull()),
        **{f"length_{n}": F.size(n) == dims for n in ("mean", "sd", "weight")}, **{f"finite_{n}": _all_finite(n) for n in ("mean", "sd", "weight")},
        "deviations": F.forall(F.arrays_zip("sd", "weight"), lambda x: (x["sd"] > 0) | ((x["sd"] == 0) & (x["weight"] == 0))),
        "landmark_mean": marks.isNull() | ((F.size("landmark_mean") == marks) & _all_finite("landmark_mean")),
        "lda_shape": F.col("lda").isNull() | ((F.size("lda.weights") == F.size("lda.labels")) & (F.size("lda.offsets") == F.size("lda.labels")) & F.forall("lda.weights", lambda w: F.size(w) == rank) & F.forall("lda.basis", lambda b: F.size(b) == F.size("lda.mean"))),
    }
    assert_none(doc.agg(*(holds(rule).alias(name) for name, rule in rules.items())))
    row, refs, cal = frozen.row, frozen.references, frozen.calibration
    n = sum(b.dim for b in row.blocks)
    finite = F.forall("vector", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")) & x.isNotNull())
    both = refs.select("group").join(cal.select("group"), "group", "left_semi").agg(F.count("*").alias("calibration_groups_among_references"))
    labels = refs.select("label").distinct()
    unknown = cal.join(labels, "label", "left_anti").agg(F.count("*").alias("unknown_calibration_labels"))
    a = refs.agg((F.count("*") - F.count_distinct("group")).alias("reference_groups"), F.count_if(F.col("label").isNull()).alias("reference_labels"), F.count_if(F.size("vector") != n).alias("reference_lengths"), holds(finite).alias("reference_values"), (F.count("*") != row.n_references).cast("int").alias("reference_count"), F.greatest(2 - F.count_distinct("label"), F.lit(0)).alias("missing_labels"))
    b = cal.agg((F.count("*") - F.count_distinct("group")).alias("calibration_groups"), holds(_finite(F.col("score"))).alias("calibration_scores"), (F.count("*") != row.n_calibration).cast("int").alias("calibration_count"))
    # One row each.
    assert_none(a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(both)).crossJoin(F.broadcast(unknown)))
    if _fingerprint(refs, cal) != row.fingerprint:
        raise ContractError("fingerprint: 1")


def layout_of(row: Row) -> model.Layout:
    return model.Layout(tuple((b.block, b.dim) for b in row.blocks))


def runtime(frozen: Frozen) -> model.Model:
    """The model that the tables describe."""
    row = frozen.row
    params = tuple(np.array(x, float) for x in (row.mean, row.sd, row.weight))
    shapes = {} if row.landmark_mean is None else {model.ONLY: np.array(row.landmark_mean, float).reshape(-1, 2)}
    ldas = {}
    if row.lda is not None:
        x = row.lda
        ldas = {model.ONLY: ShapeLda(Pca(np.array(x.mean), np.array(x.basis).T, np.array(x.explained)), Lda(list(x.labels), np.array(x.weights), np.array(x.offsets), x.temperature or 1.0, x.share))}
    refs = frozen.references.withColumn("key", F.lit(model.ONLY))
    sizes = refs.groupBy("key", "label").agg(F.count("*").alias("size"))
    spaces = model.Spaces(layout_of(row), shapes, {model.ONLY: params}, ldas, refs, sizes)
    return model.Model(spaces, frozen.calibration.withColumn("key", F.lit(model.ONLY)), row.classifier.votes, row.primary)


def _check_vectors(rows: DataFrame, layout: model.Layout) -> None:
    whole = F.forall("vector", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")) & x.isNotNull())
    assert_none(rows.agg(F.count_if(F.col("vector").isNull()).alias("without_vector"), F.count_if(F.size("vector") != layout.dims).alias("vector_length"), F.count_if(~F.coalesce(whole, F.lit(True))).alias("vector_values")))


def _queries(frozen: Frozen, rows: DataFrame) -> DataFrame:
    """The rows, if they are what the model reads: versions and scheme are compared where the rows name them."""
    row = frozen.row
    wanted = {"feature_version": row.feature_version, "preprocessing_version": row.preprocessing_version, "landmark_scheme": row.landmark_scheme}
    named = [F.count_if(~F.col(c).eqNullSafe(F.lit(v))).alias(c) for c, v in wanted.items() if c in rows.columns]
    if named:
        assert_none(rows.agg(*named))
    rows = rows.withColumn("vector", doubles("vector"))
    _check_vectors(rows, layout_of(row))
    return rows


def classify(frozen: Frozen, rows: DataFrame, method: str | None = None) -> DataFrame:
    """query_id, group, truth, predicted, score, labels, valid, unknown. rows: id, group, label (may be null), vector."""
    return model.classify(runtime(frozen), _queries(frozen, rows), method)


def probabilities(frozen: Frozen, rows: DataFrame) -> DataFrame:
    """id, label, p by the discriminants; none for a model without."""
    own = runtime(frozen)
    n = own.spaces.layout.landmarks
    aligned = own.spaces.aligned(model._typed(_queries(frozen, rows).withColumn("key", F.lit(model.ONLY)))).withColumn("vector", F.slice("vector", 1, n or 1))
    return discriminant.probabilities(aligned, own.spaces.discriminants, "key").drop("key")


def check_external(frozen: Frozen, rows: DataFrame) -> None:
    """A test row that shares its group, id, vector or source with any row behind the model is an error, and so are a source under
    two groups and rows without a label."""
    keyed = rows.withColumn("view", F.sha2(F.to_json(F.struct(doubles("vector").alias("vector"))), 256)).withColumn("group", F.col("group").cast("string"))
    broken = [keyed.agg(F.count_if(F.trim(F.coalesce(F.col("label").cast("string"), F.lit(""))) == "").alias("without_label"), (F.count("*") == 0).cast("int").alias("no_rows"))]
    for c in ("group", "id", "view", *(["source_hash"] if "source_hash" in rows.columns else [])):
        broken.append(keyed.where(F.col(c).isNotNull()).join(frozen.provenance.select(c), c, "left_semi").agg(F.count("*").alias(f"shared_{c}")))
    if "source_hash" in rows.columns:
        broken.append(references.reused_sources(keyed.where("source_hash IS NOT NULL"), "source_hash", "group").agg(F.count("*").alias("sources_of_two_groups")))
    at_once(*(partial(assert_none, b) for b in broken))


@dataclass
class Report:
    methods: DataFrame  # method, unit, evaluated, accuracy, balanced_accuracy of known labels
    sets: DataFrame  # groups, coverage, empty_rate, mean_size of known labels
    novel: DataFrame  # label, groups, valid, rejected, rate of labels the model doesn't know
    calibration: DataFrame | None  # top_probability, hit, brier
    reliability: DataFrame | None  # bin, n, confidence, accuracy, of groups


def evaluate_external(frozen: Frozen, rows: DataFrame) -> Report:
    """Score rows that had no part in the model, without fitting anything. rows: id, group, label, vector, source_hash if any."""
    check_external(frozen, rows)
    own = runtime(frozen)
    rows = cut(distinct_views(_queries(frozen, rows).withColumn("group", F.col("group").cast("string"))))
    methods = model.METHODS if own.spaces.discriminants else ("distance", "knn", "walk")
    found = model.score(own.spaces, rows.withColumn("key", F.lit(model.ONLY)), methods, own.k)
    known = own.spaces.sizes.select(F.col("label").alias("truth"))
    of = rows.select(F.col("id").alias("query_id"), "group", F.col("label").alias("truth"))
    seen = of.join(known, "truth", "left_semi")
    predictions = model.best(found.methods).drop("score").join(seen, "query_id")
    sets = cut(model.sets_of(found.near, own.calibration).join(of, "query_id"))
    novel = evaluate.novel_rejection(sets.join(known, "truth", "left_anti").withColumnRenamed("truth", "label"))
    stats = bins = None
    if own.spaces.discriminants:
        p = cut(found.methods.where("method = 'lda'").join(seen, "query_id"))
        top = F.min(F.struct((-F.col("score")).alias("s"), F.col("label").alias("l")))
        brier = F.sum(F.pow(F.col("score") - (F.col("label") == F.col("truth")).cast("double"), F.lit(2.0)))
        by = p.groupBy("query_id", "group", "truth").agg(top.alias("b"), brier.alias("brier"))
        stats = evaluate.calibration_stats(by.select("group", "truth", F.col("b.l").alias("top_label"), (-F.col("b.s")).alias("top_p"), "brier"))
        views = p.groupBy("group").agg(F.count_distinct("query_id").alias("v"))
        animal = p.join(views, "group").groupBy("group", "truth", "label").agg((F.sum("score") / F.max("v")).alias("score")).groupBy("group", "truth").agg(top.alias("b"))
        bins = evaluate.reliability(animal.select((-F.col("b.s")).alias("confidence"), (F.col("b.l") == F.col("truth")).cast("int").alias("hit")))
    valid = sets.join(known, "truth", "left_semi").select("group", "truth", "labels", "valid")
    tables = (model.method_summary(predictions), conformal.summarize(valid), novel, stats, bins)
    return Report(*at_once(*(partial(lambda t: None if t is None else cut(t), t) for t in tables)))
