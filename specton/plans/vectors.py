"""Queries over the embeddings table: standardizing, neighbours, label scores, conformal sets, evaluation, walks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specton.functions import vectors as V
from specton.operators import conformal, diffusion, evaluate, graph, similarity


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").cast("string").alias("label"))


def _grouped(rows: DataFrame) -> DataFrame:
    """Two rows in a row of ids are views of one animal, if of one label."""
    return rows.withColumn("group", F.concat_ws("-", "label", F.floor(F.col("id") / 2).cast("long")))


def _labels(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").alias("ref_id"), "label")


_E = "e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, CAST(label AS VARCHAR) AS label FROM embeddings)"
_G = f"{_E}, g AS (SELECT *, label || '-' || CAST(id // 2 AS VARCHAR) AS grp FROM e)"
_COS = "CAST(list_inner_product(a.v, b.v) / CASE WHEN list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v) = 0 THEN 1 ELSE sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)) END AS FLOAT)"
_HOLD = f"""{_E}, x AS (
  SELECT unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM e WHERE id % 5 <> 0
), p AS (
  SELECT dim, avg(x) AS mean, coalesce(stddev_samp(x), 0) AS sd, CASE WHEN stddev_samp(x) > 1e-9 THEN 1 / sqrt(CAST((SELECT max(dim) + 1 FROM x) AS DOUBLE)) ELSE 0 END AS weight FROM x GROUP BY dim
), z AS (
  SELECT id, label, list(CASE WHEN weight = 0 THEN 0 ELSE (x - mean) / sd * weight END ORDER BY dim) AS v
  FROM (SELECT id, label, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM e) JOIN p USING (dim) GROUP BY id, label
), d AS (
  SELECT a.id AS query_id, b.id AS ref_id, CAST(-list_distance(a.v, b.v) AS FLOAT) AS similarity, b.label AS label FROM z a JOIN z b ON a.id % 5 = 0 AND b.id % 5 <> 0
), n AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, ref_id) AS rank FROM d
), sz AS (SELECT label, count(*) AS size FROM z WHERE id % 5 <> 0 GROUP BY label),
s AS (
  SELECT query_id, label, sum(1 / (1 - CAST(similarity AS DOUBLE))) / max(size) AS s FROM n JOIN sz USING (label) WHERE rank <= 5 GROUP BY query_id, label
), sc AS (SELECT query_id, label, s / sum(s) OVER (PARTITION BY query_id) AS score FROM s)"""


def _held(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = _rows(spark, sf_dir)
    known = rows.where("id % 5 <> 0")
    z = similarity.standardize(rows, similarity.fit_standardizer(known))
    return z.where("id % 5 = 0"), z.where("id % 5 <> 0"), rows


def _distance_scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    asked, known, rows = _held(spark, sf_dir)
    near = similarity.neighbours(asked, known, 5, "euclidean")
    return similarity.label_scores(near, _labels(known), similarity.distance_weight()), rows


def classify_by_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, rows = _distance_scores(spark, sf_dir)
    best = similarity.argmax(scores)
    return best.join(rows.select(F.col("id").alias("query_id"), F.col("label").alias("truth")), "query_id").select(F.col("query_id").alias("vec_id"), "truth", F.col("label").alias("pred"), F.round("score", 6).alias("score"))


CLASSIFY_SQL = f"""WITH {_HOLD}, b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS k FROM sc)
SELECT query_id AS vec_id, e.label AS truth, b.label AS pred, round(score, 6) AS score FROM b JOIN e ON e.id = query_id WHERE k = 1"""


def standardizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = similarity.fit_standardizer(_rows(spark, sf_dir).where("id % 5 <> 0"))
    return p.select("dim", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "weight")])


def score_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.entropy_bits(_distance_scores(spark, sf_dir)[0]).select("query_id", F.round("bits", 6).alias("bits"))


def l2_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vector")
    return _rows(spark, sf_dir).select("id", F.round(V.norm(v), 6).alias("norm"), F.round(V.norm(V.l2_normalize(v)), 6).alias("unit"))


def compact_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.compact(F.col("vector"))
    return _rows(spark, sf_dir).select("id", F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), 9).alias("total"))


def cosine_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return similarity.neighbours(rows, rows, 7).select("query_id", "ref_id", F.round(F.col("similarity").cast("double"), 5).alias("similarity"), "rank")


def euclidean_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return similarity.neighbours(rows, rows, 5, "euclidean").select("query_id", "ref_id", F.round(F.col("similarity").cast("double"), 5).alias("similarity"), "rank")


def _pairs_sql(expression: str, k: int) -> str:
    return f"""WITH {_E}, p AS (SELECT a.id AS query_id, b.id AS ref_id, {expression} AS similarity FROM e a JOIN e b ON a.id <> b.id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, ref_id) AS INTEGER) AS rank FROM p)
SELECT query_id, ref_id, round(CAST(similarity AS DOUBLE), 5) AS similarity, rank FROM r WHERE rank <= {k}"""


def cosine_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    near = similarity.neighbours(rows.where("id % 5 = 0"), rows.where("id % 5 <> 0"), 5)
    return similarity.label_scores(near, _labels(rows.where("id % 5 <> 0")), similarity.cosine_weight()).select("query_id", "label", F.round("score", 6).alias("score"))


COSINE_SCORES_SQL = f"""WITH {_E}, p AS (SELECT a.id AS query_id, b.id AS ref_id, b.label, {_COS} AS similarity FROM e a JOIN e b ON a.id % 5 = 0 AND b.id % 5 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, ref_id) AS rank FROM p),
sz AS (SELECT label, count(*) AS size FROM e WHERE id % 5 <> 0 GROUP BY label),
s AS (SELECT query_id, label, sum(greatest(1e-6, CAST(similarity AS DOUBLE))) / max(size) AS s FROM r JOIN sz USING (label) WHERE rank <= 5 GROUP BY ALL)
SELECT query_id, label, round(s / sum(s) OVER (PARTITION BY query_id), 6) AS score FROM s"""


def _left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group, truth, predicted by the nearest rows of other animals."""
    rows = _grouped(_rows(spark, sf_dir))
    near = similarity.neighbours(rows, rows, 5, exclude="group")
    best = similarity.argmax(similarity.label_scores(near, _labels(rows), similarity.cosine_weight()))
    return rows.select(F.col("id").alias("query_id"), "group", F.col("label").alias("truth")).join(best.select("query_id", F.col("label").alias("predicted")), "query_id", "left")


_LOO = f"""{_G}, p AS (SELECT a.id AS query_id, b.id AS ref_id, b.label, {_COS} AS similarity FROM g a JOIN g b ON a.grp <> b.grp),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, ref_id) AS rank FROM p),
sz AS (SELECT label, count(*) AS size FROM g GROUP BY label),
s AS (SELECT query_id, label, sum(greatest(1e-6, CAST(similarity AS DOUBLE))) / max(size) AS s FROM r JOIN sz USING (label) WHERE rank <= 5 GROUP BY ALL),
sc AS (SELECT query_id, label, s / sum(s) OVER (PARTITION BY query_id) AS score FROM s),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS k FROM sc),
loo AS (SELECT g.id AS query_id, g.grp, g.label AS truth, b.label AS predicted, b.score FROM g LEFT JOIN b ON b.query_id = g.id AND b.k = 1)"""


def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _left_out(spark, sf_dir).select("query_id", "group", "truth", "predicted")


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(_left_out(spark, sf_dir))


def evaluation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evaluate.summary(_left_out(spark, sf_dir))
    return s.select("evaluated", F.round("accuracy", 6).alias("accuracy"), F.round("balanced_accuracy", 6).alias("balanced_accuracy"))


def animal_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.animals(_left_out(spark, sf_dir))


_VOTES = f"""{_LOO}, v AS (SELECT grp, truth, predicted, count(*) AS n FROM loo GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY grp, truth ORDER BY n DESC, predicted) AS k, max(CASE WHEN predicted IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY grp, truth) AS open FROM v)"""


def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, rows = _distance_scores(spark, sf_dir)
    truth = _grouped(rows).select(F.col("id").alias("query_id"), "group", F.col("label").alias("truth"))
    of = scores.join(truth, "query_id").groupBy("query_id", "group", "truth").agg(F.sum(F.when(F.col("label") == F.col("truth"), F.pow(1 - F.col("score"), F.lit(2.0))).otherwise(F.col("score") * F.col("score"))).alias("b"), F.max(F.when(F.col("label") == F.col("truth"), 1)).alias("seen"))
    best = similarity.argmax(scores).select("query_id", F.col("label").alias("top_label"), F.col("score").alias("top_p"))
    return of.join(best, "query_id").select("group", "truth", "top_label", "top_p", (F.col("b") + F.when(F.col("seen").isNull(), 1.0).otherwise(0.0)).alias("brier"))


def calibration_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.calibration_stats(_top(spark, sf_dir)).select(*[F.round(c, 6).alias(c) for c in ("top_probability", "hit", "brier")])


_TOP = f"""{_HOLD}, tr AS (SELECT id AS query_id, label AS truth, label || '-' || CAST(id // 2 AS VARCHAR) AS grp FROM e WHERE id % 5 = 0),
bs AS (SELECT query_id, grp, truth, sum(CASE WHEN label = truth THEN (1 - score) * (1 - score) ELSE score * score END) + CASE WHEN max(CASE WHEN label = truth THEN 1 ELSE 0 END) = 0 THEN 1 ELSE 0 END AS brier FROM sc JOIN tr USING (query_id) GROUP BY ALL),
bk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS k FROM sc),
top AS (SELECT grp, truth, bk.label AS top_label, bk.score AS top_p, brier FROM bs JOIN bk USING (query_id) WHERE k = 1)"""
CALIBRATION_SQL = f"""WITH {_TOP}, w AS (SELECT *, 1.0 / (count(DISTINCT grp) OVER (PARTITION BY truth) * count(*) OVER (PARTITION BY truth, grp)) AS w FROM top)
SELECT round(sum(w * top_p) / sum(w), 6) AS top_probability, round(sum(CASE WHEN truth = top_label THEN w ELSE 0 END) / sum(w), 6) AS hit, round(sum(w * brier) / sum(w), 6) AS brier FROM w"""


def reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _top(spark, sf_dir).select(F.col("top_p").alias("confidence"), (F.col("truth") == F.col("top_label")).cast("int").alias("hit"))
    return evaluate.reliability(rows).select("bin", "n", F.round("confidence", 6).alias("confidence"), F.round("accuracy", 6).alias("accuracy"))


RELIABILITY_SQL = f"""WITH {_TOP}, b AS (SELECT CAST(least(9, floor(top_p * 10)) AS INTEGER) AS bin, top_p, CASE WHEN truth = top_label THEN 1.0 ELSE 0.0 END AS hit FROM top)
SELECT CAST(r.range AS INTEGER) AS bin, count(b.bin) AS n, round(avg(top_p), 6) AS confidence, round(avg(hit), 6) AS accuracy FROM range(10) r LEFT JOIN b ON b.bin = r.range GROUP BY ALL"""


def _conformal(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """p-values of rows 0 modulo 5 against calibration rows 1 modulo 5, from the other rows."""
    rows = _grouped(_rows(spark, sf_dir))
    known = rows.where("id % 5 > 1")
    # Each group's best view per label, over all references.
    scores = conformal.nonconformity(similarity.group_similarities(rows.where("id % 5 <= 1"), known, conformal.NEAREST))
    asked = rows.select(F.col("id").alias("query_id"), F.col("label").alias("truth"), "group")
    own = scores.join(asked, "query_id")
    cal = conformal.by_specimen(own.where((F.col("query_id") % 5 == 1) & (F.col("label") == F.col("truth"))).select("group", "label", "score"))
    return conformal.p_values(scores.where("query_id % 5 = 0"), cal), asked


_CONF = f"""{_G}, p AS (SELECT a.id AS query_id, b.id AS ref_id, b.label, b.grp, {_COS} AS similarity FROM g a JOIN g b ON a.id % 5 <= 1 AND b.id % 5 > 1),
gb AS (SELECT query_id, label, grp, max(CAST(similarity AS DOUBLE)) AS s FROM p GROUP BY ALL),
gr AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY s DESC, grp) AS k FROM gb),
nc AS (SELECT query_id, label, 1 - avg(s) AS score FROM gr WHERE k <= 3 GROUP BY ALL),
cal AS (SELECT g.grp, min(nc.label) AS label, max(score) AS score FROM nc JOIN g ON g.id = query_id AND g.label = nc.label WHERE query_id % 5 = 1 GROUP BY g.grp),
pv AS (SELECT nc.query_id, nc.label, count(cal.grp) AS n, (count(CASE WHEN cal.score >= nc.score - 1e-12 THEN 1 END) + 1) / CAST(count(cal.grp) + 1 AS DOUBLE) AS p FROM nc JOIN cal ON cal.label = nc.label WHERE query_id % 5 = 0 GROUP BY nc.query_id, nc.label, nc.score)"""


def conformal_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conformal(spark, sf_dir)[0].select("query_id", "label", "n", F.round("p", 6).alias("p"))


def conformal_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = conformal.prediction_sets(_conformal(spark, sf_dir)[0])
    return s.select("query_id", F.array_join("labels", ",").alias("labels"), F.array_join("uncalibrated", ",").alias("uncalibrated"), "valid", "unknown")


_SETS = f"{_CONF}, st AS (SELECT query_id, coalesce(list_sort(list(label) FILTER (p > 0.1)), []) AS labels, coalesce(list_sort(list(label) FILTER (n < 9)), []) AS unc FROM pv GROUP BY query_id)"
SETS_SQL = f"WITH {_SETS} SELECT query_id, array_to_string(labels, ',') AS labels, array_to_string(unc, ',') AS uncalibrated, len(unc) = 0 AS valid, len(unc) = 0 AND len(labels) = 0 AS unknown FROM st"


def conformal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, asked = _conformal(spark, sf_dir)
    s = conformal.summarize(conformal.prediction_sets(p).withColumn("valid", F.lit(True)).join(asked, "query_id"))
    return s.select("groups", *[F.round(c, 6).alias(c) for c in ("coverage", "empty_rate", "mean_size")])


def prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from specton.operators.references import prototypes as of

    p = of(_grouped(_rows(spark, sf_dir)), "group", "label", "vector")
    return p.select("group", "label", "views", F.round(F.get("vector", F.lit(0)), 6).alias("first"), F.round(V.norm(F.col("vector")), 6).alias("norm"))


PROTOTYPES_SQL = f"""WITH {_G}, x AS (SELECT grp, label, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM g), m AS (SELECT grp, label, dim, avg(x) AS x, count(*) AS n FROM x GROUP BY ALL)
SELECT grp AS "group", label, max(n) AS views, round(max(CASE WHEN dim = 1 THEN x END), 6) AS first, round(sqrt(sum(x * x)), 6) AS norm FROM m GROUP BY grp, label"""


def walk_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps of the walk with restart from rows 0 modulo 50 over the 7-nearest graph of the other rows."""
    rows = _rows(spark, sf_dir)
    asked, known = rows.where("id % 50 = 0"), rows.where("id % 50 <> 0")
    edges = graph.neighbour_transitions(similarity.neighbours(known, known, 7), 7).unionByName(graph.neighbour_transitions(similarity.neighbours(asked, known, 7), 7))
    starts = asked.select("id", F.col("id").alias("node"), F.lit(1.0).alias("value"))
    mass = diffusion.gathered(edges, starts, rows.select(F.col("id").alias("node"), F.col("id").alias("name")), "name", graph.STEPS, graph.RESTART)
    return mass.select(F.col("id").alias("query"), F.col("name").alias("node"), F.round("value", 8).alias("p"))


WALK_SQL = f"""WITH RECURSIVE {_E}, p AS (SELECT a.id AS src, b.id AS dst, {_COS} AS similarity FROM e a JOIN e b ON b.id % 50 <> 0 AND a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY similarity DESC, dst) AS rank FROM p),
w AS (SELECT src, dst, power(greatest(0.0, CAST(similarity AS DOUBLE)), 3) + 1e-12 AS w FROM r WHERE rank <= 7),
t AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM w),
m AS (
  SELECT 0 AS step, id AS query, id AS node, CAST(1.0 AS DOUBLE) AS p FROM e WHERE id % 50 = 0
  UNION ALL
  SELECT step, query, node, sum(p) AS p FROM (
    SELECT m.step + 1 AS step, m.query, t.dst AS node, 0.8 * m.p * t.p AS p FROM m JOIN t ON t.src = m.node WHERE m.step < 40
    UNION ALL
    SELECT DISTINCT m.step + 1, m.query, m.query, CAST(0.2 AS DOUBLE) FROM m WHERE m.step < 40
  ) GROUP BY step, query, node
) SELECT query, node, round(p, 8) AS p FROM m WHERE step = 40"""

QUERIES = {
    "classify_by_distance": (classify_by_distance, CLASSIFY_SQL),
    "standardizer": (standardizer, f"WITH {_HOLD} SELECT dim::INTEGER AS dim, round(mean, 6) AS mean, round(sd, 6) AS sd, round(weight, 6) AS weight FROM p"),
    "score_entropy": (score_entropy, f"WITH {_HOLD} SELECT query_id, round(-sum(score * log2(score)), 6) AS bits FROM sc WHERE score > 0 GROUP BY query_id"),
    "l2_normalized": (l2_normalized, f"WITH {_E} SELECT id, round(sqrt(list_inner_product(v, v)), 6) AS norm, CAST(CASE WHEN list_inner_product(v, v) = 0 THEN 0 ELSE 1 END AS DOUBLE) AS unit FROM e"),
    "compact_features": (compact_features, f"WITH {_E} SELECT id, round(list_sum(list_transform(v, lambda x: CAST(printf('%.4e', x) AS DOUBLE))), 9) AS total FROM e"),
    "cosine_neighbours": (cosine_neighbours, _pairs_sql(_COS, 7)),
    "euclidean_neighbours": (euclidean_neighbours, _pairs_sql("CAST(-list_distance(a.v, b.v) AS FLOAT)", 5)),
    "cosine_scores": (cosine_scores, COSINE_SCORES_SQL),
    "leave_one_out": (leave_one_out, f'WITH {_LOO} SELECT query_id, grp AS "group", truth, predicted FROM loo'),
    "confusion_matrix": (confusion_matrix, f"WITH {_LOO} SELECT truth, predicted, count(*) AS n FROM loo WHERE predicted IS NOT NULL GROUP BY ALL"),
    "evaluation_summary": (evaluation_summary, f"WITH {_LOO}, c AS (SELECT truth, count(*) AS n, avg(CASE WHEN truth = predicted THEN 1.0 ELSE 0.0 END) AS r FROM loo WHERE predicted IS NOT NULL GROUP BY truth) SELECT CAST(sum(n) AS BIGINT) AS evaluated, round(sum(n * r) / sum(n), 6) AS accuracy, round(avg(r), 6) AS balanced_accuracy FROM c"),
    "animal_votes": (animal_votes, f'WITH {_VOTES} SELECT grp AS "group", truth, CASE WHEN open = 0 THEN predicted END AS predicted FROM o WHERE k = 1'),
    "calibration_statistics": (calibration_statistics, CALIBRATION_SQL),
    "reliability_bins": (reliability_bins, RELIABILITY_SQL),
    "conformal_p_values": (conformal_p_values, f"WITH {_CONF} SELECT query_id, label, n, round(p, 6) AS p FROM pv"),
    "conformal_sets": (conformal_sets, SETS_SQL),
    "conformal_summary": (conformal_summary, f"""WITH {_SETS}, x AS (SELECT g.grp, g.label AS truth, st.query_id, unnest(CASE WHEN len(labels) = 0 THEN [NULL] ELSE labels END) AS l FROM st JOIN g ON g.id = st.query_id),
q AS (SELECT grp, min(truth) AS truth, count(DISTINCT query_id) AS nq FROM x GROUP BY grp), y AS (SELECT x.grp, l FROM x JOIN q ON q.grp = x.grp WHERE l IS NOT NULL GROUP BY x.grp, l HAVING count(*) = max(nq)),
z AS (SELECT q.grp, truth, count(l) AS size, max(CASE WHEN l = truth THEN 1.0 ELSE 0.0 END) AS hit FROM q LEFT JOIN y ON y.grp = q.grp GROUP BY ALL)
SELECT count(*) AS groups, round(avg(coalesce(hit, 0)), 6) AS coverage, round(avg(CASE WHEN size = 0 THEN 1.0 ELSE 0.0 END), 6) AS empty_rate, round(avg(CAST(size AS DOUBLE)), 6) AS mean_size FROM z"""),
    "prototypes": (prototypes, PROTOTYPES_SQL),
    "walk_mass": (walk_mass, WALK_SQL),
}
