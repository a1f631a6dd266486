"""Conformal prediction over label groups: nonconformity, calibration, p-values and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specton.operators.similarity import group_similarities

#: Nearest groups that a label's nonconformity averages, and the default error rate.
NEAREST, EPSILON = 3, 0.1


def nonconformity(similar: DataFrame, m: int = NEAREST, key: list[str] | None = None) -> DataFrame:
    """query_id, label, score: 1 less the mean of the m best groups' best similarity. similar: query_id, label, group, similarity,
    and any further columns of key."""
    by = [*(key or []), "query_id", "label"]
    best = similar.groupBy(*by, "group").agg(F.max(F.col("similarity").cast("double")).alias("s"))
    w = Window.partitionBy(*by).orderBy(F.desc("s"), "group")
    return best.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= m).groupBy(*by).agg((1 - F.avg("s")).alias("score"))


def by_specimen(scores: DataFrame, key: list[str] | None = None) -> DataFrame:
    """group, label, score: the largest finite score of each group."""
    finite = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))
    return scores.where(finite).groupBy(*(key or []), "group").agg(F.min("label").alias("label"), F.max("score").alias("score"))


def jackknife(rows: DataFrame, metric: str = "cosine", m: int = NEAREST) -> DataFrame:
    """group, label, score: each group scored against its own label with all its rows left out, so that views can't vouch for
    one another. A heuristic: sets from it aren't valid. A label's only group has no score. rows: id, group, label, vector."""
    own = rows.select(F.col("id").alias("query_id"), "group", F.col("label").alias("truth"))
    similar = group_similarities(rows, rows, m, metric, own_group=False, own_label=True)
    scores = nonconformity(similar, m).join(own, "query_id").where("label = truth")
    return by_specimen(scores.select("group", "label", "score"))


def p_values(scores: DataFrame, calibration: DataFrame, key: list[str] | None = None) -> DataFrame:
    """query_id, label, n, p: (calibration scores at or above the query's, plus 1) / (n + 1), within the columns of key.

    Calibration scores are ranked once and each query is merged into that order with a window a label, split by ranges
    of the score so that one label doesn't land in one task."""
    by = [*(key or []), "label"]
    cal = calibration.select(*by, (F.col("score") + 1e-12).alias("s"), F.lit(None).cast("long").alias("query_id"), F.lit(1).alias("is_cal"))
    ask = scores.select(*by, F.col("score").alias("s"), "query_id", F.lit(0).alias("is_cal"))
    both = cal.unionByName(ask).withColumn("cell", F.floor(F.col("s") * 1024).cast("long"))
    cells = both.groupBy(*by, "cell").agg(F.sum("is_cal").alias("c"))
    above = Window.partitionBy(*by).orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("above", F.coalesce(F.sum("c").over(above), F.lit(0))).withColumn("n", F.sum("c").over(Window.partitionBy(*by))).drop("c")
    inside = Window.partitionBy(*by, "cell").orderBy(F.desc("s"), F.desc("is_cal")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = both.withColumn("within", F.sum("is_cal").over(inside)).where("is_cal = 0").join(cells, [*by, "cell"])
    return ranked.select(*(key or []), "query_id", "label", "n", ((F.col("above") + F.col("within") + 1) / (F.col("n") + 1)).alias("p"))


def prediction_sets(p: DataFrame, epsilon: float = EPSILON, split: bool = True) -> DataFrame:
    """query_id, labels (sorted), uncalibrated (sorted), valid, unknown. A label is in the set if p is above epsilon, and
    uncalibrated with fewer than ceil(1 / epsilon) - 1 scores; a set is valid only after a split without such labels."""
    least = -(-1 // epsilon) - 1
    pick = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("label"))))
    out = p.groupBy("query_id").agg(pick(F.col("p") > epsilon).alias("labels"), pick(F.col("n") < least).alias("uncalibrated"))
    valid = F.lit(split) & (F.size("uncalibrated") == 0)
    return out.withColumn("valid", valid).withColumn("unknown", valid & (F.size("labels") == 0))


def summarize(sets: DataFrame) -> DataFrame:
    """groups, coverage, empty_rate, mean_size over groups, a group's set being what all its views' sets share. sets:
    group, truth, labels, valid."""
    shared = F.aggregate(F.collect_list("labels"), F.lit(None).cast("array<string>"), lambda a, b: F.when(a.isNull(), b).otherwise(F.array_intersect(a, b)))
    groups = sets.groupBy("group").agg(F.min("truth").alias("truth"), shared.alias("labels"), F.bool_and("valid").alias("valid")).where("valid")
    hit = F.array_contains("labels", F.col("truth")).cast("double")
    return groups.agg(F.count("*").alias("groups"), F.avg(hit).alias("coverage"), F.avg((F.size("labels") == 0).cast("double")).alias("empty_rate"), F.avg(F.size("labels").cast("double")).alias("mean_size"))
