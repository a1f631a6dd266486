"""Folds and roles of groups as tables: stratified folds, calibration groups, and what each group does under each held-out part.

Groups are put in order by a hash of their names, within a label and with no task that holds a whole label: they are counted by
the hash's first digits, and numbered within these.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOLDS, FOLD_SEED, SHARE, SHARE_SEED = 5, 1, 0.2, 17


def positions(groups: DataFrame, by: list[str], seed: int) -> DataFrame:
    """The groups with position (from 0) in hashed order and size, both within the columns of by."""
    hashed = groups.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col("group").cast("string")))).withColumn("_b", F.substring("_h", 1, 3))
    counts = hashed.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    below = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_below", below).withColumn("size", F.sum("_n").over(Window.partitionBy(*by))).drop("_n")
    same = reduce(Column.__and__, [F.col(f"h.{c}").eqNullSafe(F.col(f"c.{c}")) for c in [*by, "_b"]])
    joined = hashed.alias("h").join(counts.alias("c"), same).select("h.*", "c._below", "c.size")
    inside = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", "group")) - 1
    return joined.withColumn("position", F.col("_below") + inside).drop("_h", "_b", "_below")


def stratified(groups: DataFrame, k: int = FOLDS, seed: int = FOLD_SEED) -> DataFrame:
    """group, label, fold: each label's groups dealt in turn, each label going on where the one before ended. groups: group, label."""
    own = positions(groups.select("group", "label"), ["label"], seed)
    # A row a label.
    before = F.coalesce(F.sum("size").over(Window.orderBy("label").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = own.select("label", "size").distinct().withColumn("_o", before).select("label", "_o")
    return own.join(F.broadcast(offsets), "label").select("group", "label", ((F.col("position") + F.col("_o")) % k).cast("int").alias("fold"))


def with_calibration(groups: DataFrame, by: list[str], share: float = SHARE, seed: int = SHARE_SEED) -> DataFrame:
    """The groups with held: whether they calibrate. Of each label a share does, at least one group, and two at least don't."""
    if not 0 < share < 1:
        raise ValueError("the share is between 0 and 1")
    n = F.greatest(F.lit(0), F.least(F.col("size") - 2, F.greatest(F.lit(1), F.floor(F.col("size") * share))))
    return positions(groups, by, seed).withColumn("held", F.col("position") < n).drop("position", "size")


def roles(groups: DataFrame, held: DataFrame, share: float = SHARE) -> DataFrame:
    """key, group, label, role for every key: its own groups are ``test``, of the others some are ``calibration`` and the rest
    ``training``. groups: group, label; held: key, group."""
    keys = held.select("key").distinct()
    every = groups.select("group", "label").crossJoin(F.broadcast(keys))
    rest = every.join(held, ["key", "group"], "left_anti")
    marked = with_calibration(rest, ["key", "label"], share).withColumn("role", F.when(F.col("held"), "calibration").otherwise("training"))
    test = groups.select("group", "label").join(held, "group").withColumn("role", F.lit("test"))
    return test.select("key", "group", "label", "role").unionByName(marked.select("key", "group", "label", "role"))
