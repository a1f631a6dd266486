"""Queries of models over the embeddings table: sums of outer products, folds, methods by the same folds, jackknife, frozen models.

Two rows in a row of ids are views of one group, if of one label.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specton.operators import conformal, discriminant, folds, frozen, model, scatter
from specton.operators.lineage import cut, deleted, shared_folder
from specton.plans.vectors import _COS, _G, _grouped, _rows

#: Landmarks of the shape queries: the first 38 components as 19 points.
LANDMARKS = 38


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(_rows(spark, sf_dir)).where(F.col("vector").isNotNull() & F.col("label").isNotNull())


def scatter_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scatter.covariance(_vectors(spark, sf_dir))
    return out.select("i", "j", F.round("total", 8).alias("total"), F.round("within", 8).alias("within"))


SCATTER_SQL = f"""WITH {_G}, x AS (SELECT id, label, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM g),
m AS (SELECT dim, avg(x) AS m FROM x GROUP BY dim), w AS (SELECT label, dim, avg(x) AS m FROM x GROUP BY label, dim),
c AS (SELECT id, dim, x - m.m AS a, x - w.m AS b FROM x JOIN m USING (dim) JOIN w USING (label, dim))
SELECT p.dim::INTEGER AS i, q.dim::INTEGER AS j, round(sum(p.a * q.a) / ((SELECT count(*) FROM g) - 1), 8) AS total,
  round(sum(p.b * q.b) / ((SELECT count(*) FROM g) - (SELECT count(DISTINCT label) FROM g)), 8) AS within
FROM c p JOIN c q USING (id) GROUP BY p.dim, q.dim"""


def principal_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scatter.plane(_vectors(spark, sf_dir))
    return out.select("id", F.round(F.get("pc", F.lit(0)), 6).alias("x"), F.round(F.get("pc", F.lit(1)), 6).alias("y"))


def _power_sql(c: int, before: str) -> str:
    off = f"(SELECT list_transform(range(len(v)), lambda k: v[k + 1] - list_inner_product(v, w) * w[k + 1]) FROM {before})" if before else "v"
    return f"""SELECT 0 AS step, list_transform(range(d::BIGINT), lambda k: sin(k * 12.9898 + {c} * 78.233)) AS w FROM size
  UNION ALL SELECT step + 1, list_transform(u, lambda y: y / sqrt(list_inner_product(u, u))) FROM (
    SELECT step, {off} AS u FROM (SELECT step, list_transform(c, lambda r: list_inner_product(r, w)) AS v FROM p{c}, cov WHERE step < 60))"""


PLANE_SQL = f"""WITH RECURSIVE {_G}, x AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM g),
m AS (SELECT dim, avg(x) AS m FROM x GROUP BY dim), z AS (SELECT id, dim, x - m AS z FROM x JOIN m USING (dim)),
size AS (SELECT count(*) AS d FROM m),
cells AS (SELECT p.dim AS i, q.dim AS j, sum(p.z * q.z) AS c FROM z p JOIN z q USING (id) GROUP BY ALL),
lines AS (SELECT i, list(c ORDER BY j) AS c FROM cells GROUP BY i), cov AS (SELECT list(c ORDER BY i) AS c FROM lines),
p0 AS ({_power_sql(0, "")}), first AS (SELECT w FROM p0 WHERE step = 60),
p1 AS ({_power_sql(1, "first")}), second AS (SELECT w FROM p1 WHERE step = 60),
r AS (SELECT id, list(z ORDER BY dim) AS z FROM z GROUP BY id)
SELECT id, round(list_inner_product(z, (SELECT w FROM first)), 6) AS x, round(list_inner_product(z, (SELECT w FROM second)), 6) AS y FROM r"""


def left_out_discriminants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's label by the discriminants of all other groups, and what they make of it at the temperature fitted on these scores."""
    rows = _vectors(spark, sf_dir)
    scores = cut(discriminant.left_out_scores(rows))
    labels = sorted(r.label for r in rows.select("label").distinct().collect())
    t = discriminant.fit_temperature(scores.select("label", "scores"), labels).value or 1.0
    names = F.array(*map(F.lit, labels))
    top = F.array_max("scores")
    total = F.aggregate("scores", F.lit(0.0), lambda a, s: a + F.exp((s - F.col("_m")) / t))
    known = scores.where("scores IS NOT NULL").withColumn("_m", top)
    return known.select("id", "label", F.get(names, F.array_position("scores", F.col("_m")).cast("int") - 1).alias("predicted"), F.round(1 / total, 6).alias("top"))


def fold_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    return folds.roles(rows.select("group", "label").distinct(), model.fold_held(rows)).select("key", "group", "label", "role")


_FOLDS = f"""{_G}, gr AS (SELECT DISTINCT grp, label FROM g),
po AS (SELECT grp, label, row_number() OVER (PARTITION BY label ORDER BY md5('1:' || grp), grp) - 1 AS pos, count(*) OVER (PARTITION BY label) AS n FROM gr),
ofs AS (SELECT label, coalesce(sum(n) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM (SELECT DISTINCT label, n FROM po)),
fo AS (SELECT grp, po.label, CAST((pos + o) % 5 AS VARCHAR) AS key FROM po JOIN ofs USING (label))"""


def _roles_sql(held: str) -> str:
    """ro(key, grp, label, role) from a table of held groups (key, grp, label)."""
    return f"""re AS (SELECT k.key, gr.grp, gr.label FROM gr, (SELECT DISTINCT key FROM {held}) k ANTI JOIN {held} h ON h.key = k.key AND h.grp = gr.grp),
rp AS (SELECT *, row_number() OVER (PARTITION BY key, label ORDER BY md5('17:' || grp), grp) - 1 AS pos, count(*) OVER (PARTITION BY key, label) AS n FROM re),
ro AS (SELECT key, grp, label, CASE WHEN pos < greatest(0, least(n - 2, greatest(1, CAST(floor(n * 0.2) AS BIGINT)))) THEN 'calibration' ELSE 'training' END AS role FROM rp
  UNION ALL SELECT key, grp, label, 'test' FROM {held})"""


#: Prototypes, standardizers and similarities under each key, from ro. A cast to single precision may stand around what a frozen model packs.
def _pipeline_sql(packed: bool = False) -> str:
    f = (lambda x: f"CAST(CAST({x} AS FLOAT) AS DOUBLE)") if packed else (lambda x: x)
    return f"""px AS (SELECT grp, label, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM g),
pm AS (SELECT grp, label, dim, avg(x) AS x FROM px GROUP BY ALL),
tr AS (SELECT ro.key, pm.* FROM ro JOIN pm USING (grp) WHERE role = 'training'),
sd AS (SELECT key, dim, {f("avg(x)")} AS mean, {f("CASE WHEN stddev_samp(x) > 1e-9 THEN stddev_samp(x) ELSE 0 END")} AS sd, {f("CASE WHEN stddev_samp(x) > 1e-9 THEN 1 / sqrt(64.0::DOUBLE) ELSE 0 END")} AS weight FROM tr GROUP BY ALL),
rz AS (SELECT key, grp, label, list({f("CASE WHEN weight = 0 THEN 0 ELSE (x - mean) / sd * weight END")} ORDER BY dim) AS v FROM tr JOIN sd USING (key, dim) GROUP BY ALL),
qx AS (SELECT id, grp, label, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM g),
qz AS (SELECT ro.key, ro.role, qx.id, qx.grp, qx.label, list(CASE WHEN weight = 0 THEN 0 ELSE (x - mean) / sd * weight END ORDER BY dim) AS v
  FROM qx JOIN ro USING (grp) JOIN sd USING (key, dim) WHERE role <> 'training' GROUP BY ALL),
si AS (SELECT a.key, a.role, a.id, a.grp AS own, a.label AS truth, b.grp, b.label, CAST(-list_distance(a.v, b.v) AS FLOAT) AS distance, {_COS} AS cosine FROM qz a JOIN rz b ON a.key = b.key),
sz AS (SELECT key, label, count(*) AS size FROM rz GROUP BY ALL),
no AS (SELECT key, role, id, own, truth, label, 1 - avg(CAST(distance AS DOUBLE)) AS score FROM (SELECT *, row_number() OVER (PARTITION BY key, id, label ORDER BY distance DESC, grp) AS r FROM si) WHERE r <= 3 GROUP BY ALL),
ca AS (SELECT key, own, min(label) AS label, max(score) AS score FROM no WHERE role = 'calibration' AND label = truth GROUP BY key, own),
pv AS (SELECT no.key, no.id, no.label, count(ca.own) AS n, (count(CASE WHEN ca.score >= no.score - 1e-12 THEN 1 END) + 1) / CAST(count(ca.own) + 1 AS DOUBLE) AS p
  FROM no LEFT JOIN ca ON ca.key = no.key AND ca.label = no.label WHERE role = 'test' GROUP BY no.key, no.id, no.label, no.score)"""


def _votes_sql(name: str, measure: str, weight: str) -> str:
    return f"""{name}_n AS (SELECT *, row_number() OVER (PARTITION BY key, id ORDER BY {measure} DESC, grp) AS r FROM si WHERE role = 'test'),
{name}_s AS (SELECT key, id, own, truth, label, sum({weight}) / max(size) AS s FROM {name}_n JOIN sz USING (key, label) WHERE r <= 5 GROUP BY ALL),
{name} AS (SELECT key, id, own, truth, label AS predicted, s / total AS score FROM (SELECT *, row_number() OVER (PARTITION BY key, id ORDER BY s DESC, label) AS r, sum(s) OVER (PARTITION BY key, id) AS total FROM {name}_s) WHERE r = 1)"""


_DISTANCE, _KNN = _votes_sql("di", "distance", "1 / (1 - CAST(distance AS DOUBLE))"), _votes_sql("kn", "cosine", "greatest(1e-6, CAST(cosine AS DOUBLE))")
_FOLDED = f"{_FOLDS}, {_roles_sql('fo')}, {_pipeline_sql()}, {_DISTANCE}, {_KNN}"


def fold_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance and cosine votes by the same five folds."""
    rows = _vectors(spark, sf_dir)
    out = model.evaluate_held(rows, model.fold_held(rows), ("distance", "knn")).predictions
    return out.select("method", "key", "query_id", "group", "truth", "predicted")


FOLD_PREDICTIONS_SQL = f"""WITH {_FOLDED}
SELECT 'distance' AS method, key, id AS query_id, own AS "group", truth, predicted FROM di UNION ALL SELECT 'knn', key, id, own, truth, predicted FROM kn"""


def fold_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    out = model.evaluate_held(rows, model.fold_held(rows), ("distance",)).sets
    return out.select("query_id", "group", "truth", F.array_join("labels", ",").alias("labels"), "valid", "unknown")


FOLD_SETS_SQL = f"""WITH {_FOLDS}, {_roles_sql('fo')}, {_pipeline_sql()}
SELECT id AS query_id, grp AS "group", g.label AS truth, coalesce(string_agg(pv.label, ',' ORDER BY pv.label) FILTER (p > 0.1), '') AS labels, min(n) >= 9 AS valid, min(n) >= 9 AND max(p) <= 0.1 AS unknown
FROM pv JOIN g USING (id) GROUP BY id, grp, g.label"""


def method_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All methods by the same folds, by view and by group; discriminants on the aligned landmarks."""
    rows = _vectors(spark, sf_dir)
    layout = model.Layout((("landmarks", LANDMARKS), ("shape", 64 - LANDMARKS)))
    out = model.method_summary(model.evaluate_held(rows, model.fold_held(rows), layout=layout).predictions)
    return out.select("method", "unit", "evaluated", F.round("accuracy", 6).alias("accuracy"), F.round("balanced_accuracy", 6).alias("balanced_accuracy"))


def series_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance votes with every third of the groups held out as a series, by view and by group."""
    rows = _vectors(spark, sf_dir).withColumn("series", F.concat(F.lit("s"), (F.floor(F.col("id") / 2) % 3).cast("string")))
    out = model.method_summary(model.evaluate_held(rows, model.series_held(rows), ("distance",)).predictions)
    return out.select("method", "unit", "evaluated", F.round("accuracy", 6).alias("accuracy"), F.round("balanced_accuracy", 6).alias("balanced_accuracy"))


SERIES_SQL = f"""WITH {_G}, gr AS (SELECT DISTINCT grp, label FROM g), se AS (SELECT DISTINCT 's' || CAST((id // 2) % 3 AS VARCHAR) AS key, grp, label FROM g), {_roles_sql('se')}, {_pipeline_sql()}, {_DISTANCE},
v AS (SELECT truth, predicted FROM di), c AS (SELECT own, truth, predicted, count(*) AS n FROM di GROUP BY ALL),
a AS (SELECT truth, predicted FROM (SELECT *, row_number() OVER (PARTITION BY own, truth ORDER BY n DESC, predicted) AS r FROM c) WHERE r = 1),
u AS (SELECT 'view' AS unit, * FROM v UNION ALL SELECT 'group', * FROM a), t AS (SELECT unit, truth, count(*) AS n, sum(CASE WHEN truth = predicted THEN 1 ELSE 0 END) AS hits FROM u GROUP BY ALL)
SELECT 'distance' AS method, unit, CAST(sum(n) AS BIGINT) AS evaluated, round(sum(hits) / sum(n), 6) AS accuracy, round(avg(hits / CAST(n AS DOUBLE)), 6) AS balanced_accuracy FROM t GROUP BY unit"""


def jackknife_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = conformal.jackknife(_vectors(spark, sf_dir))
    return out.select("group", "label", F.round("score", 5).alias("score"))


JACKKNIFE_SQL = f"""WITH {_G}, s AS (SELECT a.id, a.grp AS own, a.label, b.grp, max({_COS}) AS s FROM g a JOIN g b ON a.label = b.label AND a.grp <> b.grp GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, grp) AS r FROM s), n AS (SELECT id, own, label, 1 - avg(CAST(s AS DOUBLE)) AS score FROM r WHERE r <= 3 GROUP BY ALL)
SELECT own AS "group", label, round(max(score), 5) AS score FROM n GROUP BY own, label"""


def _test_groups(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    held = F.floor(F.col("id") / 2) % 5 == 0
    return rows.where(~held), rows.where(held)


def model_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, asked = _test_groups(_vectors(spark, sf_dir))
    out = model.classify(model.fit(known), asked)
    return out.select("query_id", "truth", "predicted", F.round("score", 6).alias("score"), F.array_join("labels", ",").alias("labels"))


def _model_sql(packed: bool) -> str:
    held = "tg AS (SELECT DISTINCT 'model' AS key, grp, label FROM g WHERE (id // 2) % 5 = 0)"
    return f"""WITH {_G}, gr AS (SELECT DISTINCT grp, label FROM g), {held}, {_roles_sql('tg')}, {_pipeline_sql(packed)}, {_DISTANCE},
st AS (SELECT id, coalesce(string_agg(label, ',' ORDER BY label) FILTER (p > 0.1), '') AS labels FROM pv GROUP BY id)
SELECT id AS query_id, truth, predicted, round(score, {5 if packed else 6}) AS score, labels FROM di JOIN st USING (id)"""


def frozen_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same model frozen, written, read again under its contract, and only then used."""
    known, asked = _test_groups(_vectors(spark, sf_dir))
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    with deleted(spark, path):
        frozen.save(frozen.freeze(known, model.Layout((("shape", 64),))), path)
        out = cut(frozen.classify(frozen.load(spark, path), asked))
    return out.select("query_id", "truth", "predicted", F.round("score", 5).alias("score"), F.array_join("labels", ",").alias("labels"))


def frozen_landmark_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frozen model with aligned landmarks and calibrated discriminants, tested on groups it hasn't seen; all its methods."""
    known, asked = _test_groups(_vectors(spark, sf_dir))
    own = frozen.freeze(known, model.Layout((("landmarks", LANDMARKS), ("shape", 64 - LANDMARKS))), scheme="points-19")
    out = frozen.evaluate_external(own, asked).methods
    return out.select("method", "unit", "evaluated", F.round("accuracy", 6).alias("accuracy"), F.round("balanced_accuracy", 6).alias("balanced_accuracy"))


QUERIES = {
    "scatter_matrix": (scatter_matrix, SCATTER_SQL),
    "principal_plane": (principal_plane, PLANE_SQL),
    "left_out_discriminants": (left_out_discriminants, None),
    "fold_roles": (fold_roles, f'WITH {_FOLDS}, {_roles_sql("fo")} SELECT key, grp AS "group", label, role FROM ro'),
    "fold_predictions": (fold_predictions, FOLD_PREDICTIONS_SQL),
    "fold_sets": (fold_sets, FOLD_SETS_SQL),
    "method_summary": (method_summary, None),
    "series_transfer": (series_transfer, SERIES_SQL),
    "jackknife_scores": (jackknife_scores, JACKKNIFE_SQL),
    "model_predictions": (model_predictions, _model_sql(False)),
    "frozen_predictions": (frozen_predictions, _model_sql(True)),
    "frozen_landmark_report": (frozen_landmark_report, None),
}
