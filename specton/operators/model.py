"""Models of labelled groups: fit on prototypes of training groups, calibrated on held-out groups, scored by four methods.

The same pipeline fits one model or one for each held-out part of an evaluation: groups have roles under keys (a fold, a
series, or the only key of a final model), and every step runs for all keys at once: sums of outer products give each key's
standardizer and its discriminants, and one pass over pairs of blocks gives all nearest groups and all nonconformity
scores. Small tables of a row a key and dimension are on the driver; rows, groups and folds never are.

Vectors may begin with a block of landmarks (x, y, x, y, ...). These are aligned first: views to their group's mean, prototypes
and queries to the mean of the training prototypes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specton.functions.shape import ShapeLda
from specton.functions.vectors import doubles
from specton.operators import conformal, diffusion, discriminant, evaluate, folds, graph, morphometrics, similarity
from specton.operators.lineage import at_once, cut
from specton.operators.references import ContractError, assert_none, label_conflicts, prototypes, reused_sources
from specton.operators.scatter import scatter

#: Nearest groups that vote.
VOTES = 5
METHODS = ("distance", "knn", "walk", "lda")
#: Neighbours of a node of the similarity graph.
NEAREST = 7
#: Smallest deviation that counts as variation.
VARIES = 1e-9


@dataclass(frozen=True)
class Layout:
    """The blocks of a vector, in order. A first block named landmarks is aligned."""

    blocks: tuple[tuple[str, int], ...]

    @property
    def dims(self) -> int:
        return sum(n for _, n in self.blocks)

    @property
    def landmarks(self) -> int:
        """Numbers of the landmark block; 0 without one."""
        name, n = self.blocks[0]
        return n if name == "landmarks" else 0


def check(rows: DataFrame) -> DataFrame:
    """The training contract: ids, labels and groups, one label a group, no source under two groups."""
    own = rows.agg(F.count_if(F.col("id").isNull()).alias("without_id"), F.count_if(F.col("group").isNull() | F.col("label").isNull()).alias("without_group_or_label"), (F.count("id") - F.count_distinct("id")).alias("repeated_ids"), F.greatest(2 - F.count_distinct("label"), F.lit(0)).alias("missing_labels"))
    broken = [own, label_conflicts(rows, "group", "label").agg(F.count("*").alias("groups_with_two_labels"))]
    if "source_hash" in rows.columns:
        broken.append(reused_sources(rows.where("source_hash IS NOT NULL"), "source_hash", "group").agg(F.count("*").alias("sources_of_two_groups")))
    at_once(*(partial(assert_none, b) for b in broken))
    return rows


def _numbered(groups: DataFrame) -> DataFrame:
    return groups.withColumn("id", F.xxhash64("group").bitwiseAND(F.lit((1 << 62) - 1)))


def group_prototypes(rows: DataFrame, layout: Layout | None = None) -> DataFrame:
    """id, group, label, views, vector: the mean of each group's views, its landmarks being their Procrustes mean."""
    proto = prototypes(rows, "group", "label", "vector")
    if layout and layout.landmarks:
        n = layout.landmarks
        own = morphometrics.group_means(rows.select("id", "group", F.slice("vector", 1, n).alias("v")))
        proto = proto.join(own, "group").withColumn("vector", F.concat("m", F.slice("vector", n + 1, max(1, layout.dims - n)))).drop("m")
    return _numbered(proto)


@dataclass
class Spaces:
    """What is learned under each key: the mean shape (with landmarks), means, deviations and weights of dimensions, discriminants;
    and the training prototypes, standardized, with the sizes of labels."""

    layout: Layout | None
    shapes: dict[str, np.ndarray]
    params: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]
    discriminants: dict[str, ShapeLda]
    references: DataFrame  # key, id, group, label, views, vector
    sizes: DataFrame  # key, label, size

    def aligned(self, rows: DataFrame) -> DataFrame:
        """The rows (key, id, vector, ...) with their landmarks turned onto their key's mean shape."""
        n = self.layout.landmarks if self.layout else 0
        if not n:
            return rows
        shapes = self.shapes

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                pdf = pdf[pdf["key"].isin(list(shapes))].reset_index(drop=True)
                if len(pdf):
                    v = np.stack(pdf["vector"])
                    m = np.stack([shapes[k] for k in pdf["key"]])
                    own = morphometrics.turned(morphometrics.points(v[:, :n]), m).reshape(len(v), -1)
                    yield pdf.assign(vector=list(np.concatenate([own, v[:, n:]], 1)))

        return rows.mapInPandas(run, rows.schema)

    def standardized(self, rows: DataFrame) -> DataFrame:
        """Aligned rows with their vector in the space of their key: ((x - mean) / sd) * weight."""
        params = self.params

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                parts = []
                for k, at in pdf.groupby("key").indices.items():
                    if k in params:
                        mean, sd, weight = params[k]
                        own = pdf.iloc[at]
                        z = np.where(weight == 0, 0.0, (np.stack(own["vector"]) - mean) / np.where(weight == 0, 1.0, sd) * weight)
                        parts.append(own.assign(vector=list(z)))
                if parts:
                    yield pd.concat(parts)

        return rows.mapInPandas(run, rows.schema)


def _typed(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(F.col("key").cast("string").alias("key"), F.col("id").cast("long").alias("id"), F.col("group").cast("string").alias("group"), F.col("label").cast("string").alias("label"), *more, doubles("vector").alias("vector"))


def fit_spaces(training: DataFrame, layout: Layout | None = None, lda: bool = True) -> Spaces:
    """Everything learned from the training prototypes (key, id, group, label, views, vector) of each key. Keys with one label, or
    where nothing varies, have no space."""
    training = cut(_typed(training, "views"))
    shapes = {}
    if layout and layout.landmarks:
        shapes = morphometrics.means(training.select("id", "key", F.slice("vector", 1, layout.landmarks).alias("v")), "key")
    spaces = Spaces(layout, shapes, {}, {}, training, training)
    prepared = cut(spaces.aligned(training)) if shapes else training
    for k, s in scatter(prepared, "key").items():
        sd = np.sqrt(np.maximum(np.diag(s.total), 0) / max(1, s.n - 1)) if s.n > 1 else np.zeros(len(s.origin))
        weight = np.where(sd > VARIES, 1.0, 0.0)
        if layout:
            weight = weight / np.sqrt(np.repeat([n for _, n in layout.blocks], [n for _, n in layout.blocks]).astype(float))
        else:
            weight = weight / np.sqrt(len(sd))
        if len(s.labels) > 1 and weight.any():
            spaces.params[k] = (s.mean, np.where(sd > VARIES, sd, 0.0), weight)
    if lda:
        n = layout.landmarks if layout else 0
        spaces.discriminants = discriminant.fit(prepared.withColumn("vector", F.slice("vector", 1, n)) if n else prepared, "key")
    spaces.references = cut(spaces.standardized(prepared))
    spaces.sizes = spaces.references.groupBy("key", "label").agg(F.count("*").alias("size"))
    return spaces


@dataclass
class Scores:
    """Scores of rows under their keys: method, key, query_id, label, score; and the nearest groups by distance."""

    methods: DataFrame
    near: DataFrame


def score(spaces: Spaces, rows: DataFrame, methods: tuple[str, ...] = METHODS, k: int = VOTES) -> Scores:
    """Every method's label scores of rows (key, id, group, label, vector)."""
    aligned = cut(spaces.aligned(_typed(rows)))
    z = cut(spaces.standardized(aligned))
    # Distances and the walk read nothing of each other.
    distances = lambda: cut(similarity.group_similarities(z, spaces.references, conformal.NEAREST, "euclidean", "key", overall=k))

    def cosines() -> tuple[DataFrame | None, DataFrame | None]:
        if not {"knn", "walk"} & set(methods):
            return None, None
        nearest = lambda: cut(similarity.group_similarities(z, spaces.references, 0, "cosine", "key", overall=max(k, NEAREST)))
        if "walk" not in methods:
            return nearest(), None
        cosine, graph_ = at_once(nearest, lambda: _reference_graph(spaces, z))
        return cosine, walk_scores(spaces, z, cosine, graph_)

    near, (cosine, walked) = at_once(distances, cosines)
    by = ["key", "query_id"]
    tag = lambda name, own: own.select(F.lit(name).alias("method"), "key", "query_id", "label", "score")
    parts = []
    if "distance" in methods:
        parts.append(tag("distance", similarity.votes(near, spaces.sizes, k, similarity.distance_weight(), by)))
    if walked is not None:
        parts.append(tag("walk", walked))
    if "knn" in methods:
        parts.append(tag("knn", similarity.votes(cosine, spaces.sizes, k, similarity.cosine_weight(), by)))
    if "lda" in methods and spaces.discriminants:
        n = spaces.layout.landmarks if spaces.layout else 0
        own = aligned.withColumn("vector", F.slice("vector", 1, n)) if n else aligned
        p = discriminant.probabilities(own, spaces.discriminants, "key").where("p > 0")
        parts.append(tag("lda", p.select("key", F.col("id").alias("query_id"), "label", F.col("p").alias("score"))))
    if not parts:
        raise ValueError(f"none of these methods scores here: {methods}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return Scores(out, near)


def _nearest(near: DataFrame, k: int) -> DataFrame:
    """near with rank, of each query the k most similar groups of all labels, ties to the smaller group."""
    w = Window.partitionBy("key", "query_id").orderBy(F.desc("similarity"), "group")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _node(c: str) -> Column:
    """A group is a node of its own under each key."""
    return F.xxhash64("key", c).bitwiseAND(F.lit((1 << 62) - 1))


def _reference_graph(spaces: Spaces, z: DataFrame, k: int = NEAREST) -> tuple[DataFrame, DataFrame]:
    """The k nearest of each prototype under its key, and the prototypes that each row of z changes: it is nearer than their kth."""
    refs = spaces.references
    base = cut(_nearest(similarity.group_similarities(refs, refs, 0, "cosine", "key", overall=k), k).join(refs.select("key", F.col("id").alias("query_id"), F.col("group").alias("of")), ["key", "query_id"]))
    edges = base.select("key", _node("of").alias("query_id"), _node("group").alias("ref_id"), "similarity", "rank")
    bars = base.groupBy("key", F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.min("similarity")).alias("bar"))
    return edges, cut(similarity.pairs_above(z, refs.join(bars, ["key", "id"], "left"), "cosine", "key"))


def walk_scores(spaces: Spaces, z: DataFrame, cosine: DataFrame, graph_: tuple[DataFrame, DataFrame] | None = None, k: int = NEAREST) -> DataFrame:
    """key, query_id, label, score: each label's mass over its size after a walk with restart from every query, which is a node of its own in
    the similarity graph of its key's prototypes. z: key, id, vector; cosine: the k most similar groups of each query."""
    refs = spaces.references
    edges, closer = graph_ or _reference_graph(spaces, z, k)
    names = refs.select("key", F.col("id").alias("ref_id"), "group")
    own = _nearest(cosine, k).select("key", "query_id", "group", "similarity")
    asked = closer.join(names, ["key", "ref_id"]).select("key", "query_id", "group", "similarity").unionByName(own).groupBy("key", "query_id", "group").agg(F.max("similarity").alias("similarity"))
    # A row is asked under one key, so its id names the walk.
    rows = graph.with_queries(edges, cut(asked.select(F.col("query_id").alias("query"), _node("group").alias("ref_id"), "similarity")), k)
    starts = own.select("key", F.col("query_id").alias("id")).distinct().select("key", "id", F.lit(-1).cast("long").alias("node"), F.lit(1.0).alias("value"))
    ways = graph.neighbour_transitions(edges, k).join(refs.select("key", _node("group").alias("src")), "src")
    mass = diffusion.gathered(ways, starts, refs.select(_node("group").alias("node"), "label"), "label", graph.STEPS, graph.RESTART, rows.select(F.col("query").alias("id"), "src", "dst", "p"), "key", single=True)
    keys = z.select("key", F.col("id").alias("query_id"))
    by = mass.withColumnRenamed("id", "query_id").join(keys, "query_id").join(spaces.sizes, ["key", "label"]).withColumn("s", F.col("value") / F.col("size"))
    return by.withColumn("score", F.col("s") / F.sum("s").over(Window.partitionBy("key", "query_id"))).where("score > 0").select("key", "query_id", "label", "score")


def best(scores: DataFrame) -> DataFrame:
    """method, key, query_id, predicted, score: the highest score, ties to the smallest label."""
    top = F.min(F.struct((-F.col("score")).alias("s"), F.col("label").alias("l")))
    return scores.groupBy("method", "key", "query_id").agg(top.alias("b")).select("method", "key", "query_id", F.col("b.l").alias("predicted"), (-F.col("b.s")).alias("score"))


def calibration_scores(spaces: Spaces, rows: DataFrame) -> DataFrame:
    """key, group, label, score: the nonconformity of each calibration group to its own label, the largest of its views'. rows: key, id,
    group, label, vector."""
    z = spaces.standardized(spaces.aligned(_typed(rows)))
    own = z.select("key", F.col("id").alias("query_id"), "group", F.col("label").alias("truth"))
    similar = similarity.group_similarities(z, spaces.references, conformal.NEAREST, "euclidean", "key", own_label=True)
    scores = conformal.nonconformity(similar, key=["key"]).join(own, ["key", "query_id"]).where("label = truth")
    return conformal.by_specimen(scores.select("key", "group", "label", "score"), ["key"])


def sets_of(near: DataFrame, calibration: DataFrame) -> DataFrame:
    """query_id, labels, uncalibrated, valid, unknown by each query's nearest groups under its key. A query has one key."""
    p = conformal.p_values(conformal.nonconformity(near, key=["key"]), calibration.select("key", "label", "score"), ["key"])
    return conformal.prediction_sets(p)


# One model.


@dataclass
class Model:
    spaces: Spaces
    calibration: DataFrame  # key, group, label, score
    k: int = VOTES
    primary: str = "distance"


ONLY = "model"


def _only(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", F.lit(ONLY))


def fit(rows: DataFrame, k: int = VOTES, share: float = folds.SHARE, layout: Layout | None = None, lda: bool = False) -> Model:
    """rows: id, group, label, vector. A share of each label's groups is held out for calibration."""
    rows = cut(check(rows).withColumn("group", F.col("group").cast("string")))
    groups = rows.select("group", "label").distinct()
    held = cut(folds.with_calibration(groups, ["label"], share).where("held").select("group"))
    training = group_prototypes(rows.join(held, "group", "left_anti"), layout)
    spaces = fit_spaces(_only(training), layout, lda)
    if not spaces.params:
        raise ContractError("no dimension varies")
    return Model(spaces, cut(calibration_scores(spaces, _only(rows.join(held, "group", "left_semi")))), k, "lda" if spaces.discriminants else "distance")


def _nonconformity(rows: DataFrame, refs: DataFrame, metric: str) -> DataFrame:
    """query_id, label, score, group, truth: each row's nonconformity to every label, over all references."""
    scores = conformal.nonconformity(similarity.group_similarities(rows, refs, conformal.NEAREST, metric))
    return scores.join(rows.select(F.col("id").alias("query_id"), "group", F.col("label").alias("truth")), "query_id")


def classify(model: Model, rows: DataFrame, method: str | None = None) -> DataFrame:
    """query_id, group, truth, predicted, score, labels (the prediction set), valid, unknown. rows: id, group, label, vector."""
    method = method or model.primary
    found = score(model.spaces, _only(rows), (method,), model.k)
    own = rows.select(F.col("id").alias("query_id"), "group", F.col("label").alias("truth"))
    top = best(found.methods).select("query_id", "predicted", "score")
    sets = sets_of(found.near, model.calibration).select("query_id", "labels", "valid", "unknown")
    return own.join(top, "query_id", "left").join(sets, "query_id", "left")


# Evaluation of all methods by the same held-out groups.


@dataclass
class Evaluation:
    predictions: DataFrame  # method, key, query_id, group, truth, predicted
    scores: DataFrame  # method, key, query_id, label, score
    sets: DataFrame  # query_id, group, truth, labels, uncalibrated, valid, unknown


def evaluate_held(rows: DataFrame, held: DataFrame, methods: tuple[str, ...] = METHODS, layout: Layout | None = None, share: float = folds.SHARE, proto: DataFrame | None = None) -> Evaluation:
    """Predictions of every row by the pipeline of the groups that aren't held out with it. rows: id, group, label, vector; held:
    key, group. All keys are fitted and scored together. Keys whose other groups have one label score nothing; a label
    without training groups under a key isn't evaluated there. proto: the rows' ``group_prototypes``, if there are any."""
    rows = cut(rows.withColumn("group", F.col("group").cast("string")).withColumn("label", F.col("label").cast("string")))
    held = cut(held.select(F.col("key").cast("string").alias("key"), F.col("group").cast("string").alias("group")))
    role = cut(folds.roles(rows.select("group", "label").distinct(), held, share))
    proto = group_prototypes(rows, layout) if proto is None else proto
    of = lambda name: role.where(F.col("role") == name).select("key", "group")
    spaces = fit_spaces(proto.join(of("training"), "group"), layout, "lda" in methods)
    asked = cut(rows.join(of("test"), "group").join(spaces.sizes.select("key", "label"), ["key", "label"], "left_semi"))
    found, calibration = at_once(lambda: score(spaces, asked, methods), lambda: cut(calibration_scores(spaces, rows.join(of("calibration"), "group"))))
    own = asked.select("key", F.col("id").alias("query_id"), "group", F.col("label").alias("truth"))
    scores = cut(found.methods)
    return Evaluation(best(scores).drop("score").join(own, ["key", "query_id"]), scores, sets_of(found.near, calibration).join(own.drop("key"), "query_id"))


def fold_held(rows: DataFrame, k: int = folds.FOLDS, seed: int = folds.FOLD_SEED) -> DataFrame:
    """key, group: stratified folds of the rows' groups."""
    return folds.stratified(rows.select("group", "label").distinct(), k, seed).select(F.col("fold").cast("string").alias("key"), "group")


def series_held(rows: DataFrame) -> DataFrame:
    """key, group: every series held out in turn. Raises unless all rows have one, there are two at least, and no group is in two."""
    two = rows.groupBy("group").agg(F.count_distinct("series").alias("n")).agg(F.count_if(F.col("n") > 1).alias("groups_in_two_series"))
    few = rows.agg(F.count_if(F.col("series").isNull()).alias("without_series"), F.greatest(2 - F.count_distinct("series"), F.lit(0)).alias("missing_series"))
    assert_none(few.crossJoin(F.broadcast(two)))
    return rows.select(F.col("series").cast("string").alias("key"), "group").distinct()


def method_summary(predictions: DataFrame) -> DataFrame:
    """method, unit (view or group), evaluated, accuracy, balanced_accuracy. A group's views vote; ties go to the smallest label."""
    views = predictions.select("method", "truth", "predicted")
    n = predictions.groupBy("method", "group", "truth", "predicted").agg(F.count("*").alias("n"))
    vote = F.min(F.when(F.col("predicted").isNotNull(), F.struct((-F.col("n")).alias("n"), F.col("predicted").alias("p"))))
    groups = n.groupBy("method", "group", "truth").agg(vote.alias("b"), F.max(F.col("predicted").isNull()).alias("open")).select("method", "truth", F.when(~F.col("open"), F.col("b.p")).alias("predicted"))
    both = views.withColumn("unit", F.lit("view")).unionByName(groups.withColumn("unit", F.lit("group"))).where("predicted IS NOT NULL")
    by = both.groupBy("method", "unit", "truth").agg(F.count("*").alias("n"), F.count_if(F.col("truth") == F.col("predicted")).alias("hits"))
    return by.groupBy("method", "unit").agg(F.sum("n").alias("evaluated"), (F.sum("hits") / F.sum("n")).alias("accuracy"), F.avg(F.col("hits") / F.col("n")).alias("balanced_accuracy"))


def cross_validate(rows: DataFrame, k: int = folds.FOLDS, seed: int = folds.FOLD_SEED, method: str = "distance", layout: Layout | None = None) -> DataFrame:
    """query_id, group, truth, predicted, labels, valid, unknown of each row by a model of the other folds' groups."""
    out = evaluate_held(check(rows), fold_held(rows, k, seed), (method,), layout)
    return out.predictions.select("query_id", "group", "truth", "predicted").join(out.sets.drop("group", "truth"), "query_id", "left")


# Tests on rows that a model hasn't seen.


def assert_external(model: Model | None, rows: DataFrame, training: DataFrame) -> None:
    """A test set that shares groups, ids or sources with the training rows is an error."""
    for c in [c for c in ("group", "id", "source_hash") if c in rows.columns and c in training.columns]:
        assert_none(rows.where(F.col(c).isNotNull()).join(training.select(c), c, "left_semi").agg(F.count("*").alias(f"shared_{c}")))


def external_report(scored: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Summary of known labels by row, of animals, and the rejection of labels that aren't known. known: label."""
    labels = known.select(F.col("label").alias("truth")).distinct()
    seen, novel = scored.join(labels, "truth", "left_semi"), scored.join(labels, "truth", "left_anti")
    return evaluate.summary(seen), evaluate.summary(evaluate.animals(seen)), evaluate.novel_rejection(novel.withColumnRenamed("truth", "label"))


def evaluate_external(model: Model, rows: DataFrame, training: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    assert_external(model, rows, training)
    return external_report(classify(model, rows), training)


