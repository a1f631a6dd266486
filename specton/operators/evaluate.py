"""Evaluation: confusion, votes of an animal's views, reliability, bootstrap, folds."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specton.functions.scalars import mulberry32, shuffled

RESAMPLES = 400
#: Draws of a row.
PIECE = 1 << 20
BOOTSTRAP_SEED = 29


def confusion(rows: DataFrame) -> DataFrame:
    """truth, predicted, n of the rows with a prediction."""
    return rows.where(F.col("predicted").isNotNull()).groupBy("truth", "predicted").agg(F.count("*").alias("n"))


def recalls(rows: DataFrame) -> DataFrame:
    """truth, n, recall for each label with an evaluated row."""
    own = rows.where(F.col("predicted").isNotNull())
    return own.groupBy("truth").agg(F.count("*").alias("n"), F.avg((F.col("truth") == F.col("predicted")).cast("double")).alias("recall"))


def summary(rows: DataFrame) -> DataFrame:
    """evaluated, accuracy, balanced_accuracy (the mean of recalls)."""
    by = recalls(rows)
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("evaluated"), (F.sum(F.col("n") * F.col("recall")) / F.sum("n")).alias("accuracy"), F.avg("recall").alias("balanced_accuracy"))


def animals(rows: DataFrame) -> DataFrame:
    """group, truth, predicted: the views' majority, ties to the smallest label; null if any view has none."""
    votes = rows.groupBy("group", "truth", "predicted").agg(F.count("*").alias("n"))
    open_view = F.max(F.col("predicted").isNull())
    best = F.min(F.when(F.col("predicted").isNotNull(), F.struct((-F.col("n")).alias("n"), F.col("predicted").alias("p"))))
    return votes.groupBy("group", "truth").agg(open_view.alias("open"), best.alias("b")).select("group", "truth", F.when(~F.col("open"), F.col("b.p")).alias("predicted"))


def calibration_stats(rows: DataFrame) -> DataFrame:
    """top_probability, hit, brier, each row weighing 1 / (groups of its label * views of its group). rows: group, truth,
    top_label, top_p, brier."""
    views = rows.groupBy("truth", "group").agg(F.count("*").alias("_v"))
    groups = views.groupBy("truth").agg(F.count("*").alias("_g"))
    x = rows.join(views, ["truth", "group"]).join(groups, "truth").withColumn("_w", 1 / (F.col("_g") * F.col("_v")))
    mean = lambda c: F.sum(F.col("_w") * c) / F.sum("_w")
    return x.agg(mean(F.col("top_p")).alias("top_probability"), mean((F.col("truth") == F.col("top_label")).cast("double")).alias("hit"), mean(F.col("brier")).alias("brier"))


def reliability(animals: DataFrame, bins: int = 10) -> DataFrame:
    """bin, n, confidence, accuracy; a bin for each tenth, the last one closed. animals: confidence, hit (0 or 1)."""
    placed = animals.withColumn("bin", F.least(F.lit(bins - 1), F.floor(F.col("confidence") * bins)).cast("int"))
    by = placed.groupBy("bin").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"), F.avg(F.col("hit").cast("double")).alias("accuracy"))
    every = animals.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(by, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def expected_calibration_error(table: DataFrame) -> DataFrame:
    """ece: the gap of confidence and accuracy, weighed by the bins' rows."""
    return table.where("n > 0").agg((F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"))


def novel_rejection(rows: DataFrame) -> DataFrame:
    """label, groups, valid, rejected, rate of labels unseen in training. rows: label, group, valid, unknown."""
    by = rows.groupBy("label", "group").agg(F.bool_and("valid").alias("valid"), F.bool_and("unknown").alias("unknown"))
    out = by.groupBy("label").agg(F.count("*").alias("groups"), F.count_if("valid").alias("valid"), F.count_if(F.col("valid") & F.col("unknown")).alias("rejected"))
    return out.withColumn("rate", F.try_divide("rejected", "valid"))


def bootstrap(animals: DataFrame, resamples: int = RESAMPLES, seed: int = BOOTSTRAP_SEED) -> DataFrame:
    """low, high of the balanced accuracy under resampling of animals within each label; null if a label has one.

    Every draw of every resample is made: draw number i of a label's n picks animal floor(u * n), u being a seeded number of the resample,
    the label and i. Animals of a label are numbered by whether they hit, misses first, so a draw hits from the first hit's
    number on, and the draws of a resample and label are counted as they are made, without a row for each."""
    known = animals.where(F.col("predicted").isNotNull())
    counts = known.groupBy(F.col("truth").cast("string").alias("truth")).agg(F.count("*").alias("n"), F.sum((F.col("truth") == F.col("predicted")).cast("long")).alias("hits"))
    # A label's draws are cut into pieces, so that no row makes more than PIECE of them.
    pieces = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PIECE)))
    rows = counts.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("piece", pieces)

    def draw(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            hit = []
            for t, n, h, r, piece in zip(pdf["truth"], pdf["n"], pdf["hits"], pdf["r"], pdf["piece"], strict=True):
                size = min(PIECE, int(n) - int(piece) * PIECE)
                picks = np.random.default_rng([seed, int(r), int(piece), *str(t).encode()]).integers(0, int(n), size)
                hit.append(int((picks >= n - h).sum()))
            yield pd.DataFrame({"r": pdf["r"], "truth": pdf["truth"], "n": pdf["n"], "hit": hit})

    hits = rows.mapInPandas(draw, "r int, truth string, n long, hit long").groupBy("r", "truth").agg((F.sum("hit") / F.max("n")).alias("mean"), F.max("n").alias("n"))
    means = hits.groupBy("r").agg(F.avg("mean").alias("x"), F.min("n").alias("n"))
    picks = means.agg(F.array_sort(F.collect_list("x")).alias("x"), F.min("n").alias("n"))
    at = lambda q: F.when(F.col("n") >= 2, F.get("x", F.floor(F.size("x") * q).cast("int")))
    return picks.select(at(0.025).alias("low"), at(0.975).alias("high"))


def stratified_folds(labels: list[str], groups: list[str], k: int = 5, seed: int = 1) -> dict[str, int]:
    """The fold of each group: labels in order, each label's groups shuffled by one stream and dealt in turn."""
    by: dict[str, set[str]] = {}
    for label, group in zip(labels, groups, strict=True):
        by.setdefault(label, set()).add(group)
    draws, offset, out = mulberry32(seed), 0, {}
    for label in sorted(by):
        own = shuffled(sorted(by[label]), draws)
        out |= {g: (i + offset) % k for i, g in enumerate(own)}
        offset += len(own)
    return out


def calibration_split(labels: list[str], groups: list[str], share: float = 0.2, seed: int = 17) -> set[str]:
    """Groups held for calibration: of each label a share, at least one, and two at least stay."""
    by: dict[str, set[str]] = {}
    for label, group in zip(labels, groups, strict=True):
        by.setdefault(label, set()).add(group)
    draws, out = mulberry32(seed), set()
    for label in sorted(by):
        own = shuffled(sorted(by[label]), draws)
        out |= set(own[: max(0, min(len(own) - 2, max(1, int(share * len(own)))))])
    return out


def leave_out(similar: DataFrame) -> DataFrame:
    """Similar pairs without those of the query's own group. similar: query_group, group."""
    return similar.where(~F.col("query_group").eqNullSafe(F.col("group")))


def ranked(rows: DataFrame, key: str, *order) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
