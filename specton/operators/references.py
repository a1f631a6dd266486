"""Reference records: contracts, views of one animal, prototypes, readiness, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The order of feature blocks, and groups of a label from which it is ready or weak.
BLOCKS = ("landmarks", "size", "shape", "venation", "wip")
READY, WEAK = 10, 5


class ContractError(ValueError):
    """An input breaks a rule; the message names the rule and how many rows break it."""


def assert_none(violations: DataFrame) -> None:
    """Raise unless the only row's counts are all zero."""
    bad = {k: v for k, v in violations.first().asDict().items() if v}
    if bad:
        raise ContractError(", ".join(f"{k}: {v}" for k, v in sorted(bad.items())))


def view_key(blocks: list[str], version: str = "version", scheme: str = "scheme") -> Column:
    """One hash of version, scheme (only with landmarks) and the chosen blocks."""
    parts = [F.col(version), *([F.col(scheme)] if "landmarks" in blocks else []), *[F.col(b) for b in blocks]]
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def _last(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Of each key the row with the highest order (nulls are lowest), kept while counting: no task holds all rows of a key."""
    best = F.max_by(F.struct(*[F.col(c) for c in rows.columns]), F.struct(F.col(order).isNotNull(), F.col(order)))
    return rows.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]).agg(best.alias("_r")).select("_r.*")


def distinct_views(rows: DataFrame, group: str, key: str, position: str) -> DataFrame:
    """Per group one row for each key, the last by position."""
    return _last(rows, [group, key], position)


def label_conflicts(rows: DataFrame, group: str, label: str) -> DataFrame:
    """Groups with two labels, or none."""
    return rows.groupBy(group).agg(F.count_distinct(label).alias("labels")).where((F.col("labels") != 1) | F.col(group).isNull() | (F.trim(F.col(group).cast("string")) == ""))


def prototypes(rows: DataFrame, group: str, label: str, vector: str) -> DataFrame:
    """group, label, views and the elementwise mean of the vectors."""
    parts = rows.select(group, label, F.posexplode(F.col(vector).cast("array<double>")).alias("dim", "x"))
    mean = parts.groupBy(group, label, "dim").agg(F.avg("x").alias("x"), F.count("*").alias("views"))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"])
    return mean.groupBy(group, label).agg(F.max("views").alias("views"), packed.alias(vector))


def common_blocks(rows: DataFrame, blocks: tuple[str, ...] = BLOCKS, scheme: str = "scheme") -> DataFrame:
    """One row, a boolean for each block: present in every row; landmarks only under one scheme."""
    present = [(F.bool_and(F.col(b).isNotNull()) & (F.count_distinct(scheme) == 1) if b == "landmarks" else F.bool_and(F.col(b).isNotNull())).alias(b) for b in blocks]
    return rows.agg(*present)


def violations(rows: DataFrame, selected: list[str], lengths: dict[str, int], version: str = "version") -> DataFrame:
    """One row of counts: rows without a selected block, with a wrong length, with a non-finite number, and versions beyond one."""
    finite = lambda b: F.forall(F.col(b), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    checks = []
    for b in selected:
        checks += [F.count_if(F.col(b).isNull()).alias(f"missing_{b}"), F.count_if(F.size(b) != lengths[b]).alias(f"length_{b}"), F.count_if(~finite(b)).alias(f"nonfinite_{b}")]
    return rows.agg(*checks, F.greatest(F.count_distinct(version) - 1, F.lit(0)).alias("extra_versions"))


def readiness(rows: DataFrame, label: str, group: str, series: str, landmarks: str, sex: str) -> DataFrame:
    """label, groups, rows, with_landmarks, females, males, unknown_sex, series, status."""
    status = F.when(F.col("groups") >= READY, "ready").when(F.col("groups") >= WEAK, "weak").otherwise("insufficient")
    out = rows.groupBy(label).agg(
        F.count_distinct(group).alias("groups"), F.count("*").alias("rows"), F.count(landmarks).alias("with_landmarks"), F.count_if(F.col(sex) == "F").alias("females"),
        F.count_if(F.col(sex) == "M").alias("males"), F.count_if(F.col(sex).isNull()).alias("unknown_sex"), F.count_distinct(series).alias("series"))
    return out.withColumn("status", status)


def reused_sources(rows: DataFrame, source_hash: str, group: str) -> DataFrame:
    """source hash, groups: one source under more than one group."""
    return rows.groupBy(source_hash).agg(F.count_distinct(group).alias("groups")).where("groups > 1")


def fingerprint(rows: DataFrame, identity: str) -> DataFrame:
    """n and one value of all rows' identities, whatever their order: sums of two hashes, which merge in any tree."""
    digits = lambda seed: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(identity))), 1, 15), 16, 10).cast("decimal(38,0)")
    total = lambda seed: F.coalesce(F.sum(digits(seed)).cast("string"), F.lit("0"))
    return rows.agg(F.count("*").alias("n"), F.sha2(F.concat_ws(":", total(1), total(2)), 256).alias("fingerprint"))


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, side: keys that only one side has."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).union(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def representative(rows: DataFrame, group: str, name: str, prefix: str) -> DataFrame:
    """group, name: of each group the name with the smallest SHA-256 of prefix + name."""
    return rows.groupBy(group).agg(F.min_by(name, F.struct(F.sha2(F.concat(F.lit(prefix), F.col(name)), 256), F.col(name))).alias(name))


def not_own(rows: DataFrame, archive: Column, specimen: Column) -> Column:
    """True where a candidate is neither of the query's archive nor its specimen; null is like null for neither."""
    return ~(F.col("archive").eqNullSafe(archive) & archive.isNotNull()) & ~(F.col("specimen").eqNullSafe(specimen) & specimen.isNotNull())


def append_new(stored: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """stored and the rows of incoming whose key it doesn't hold."""
    return stored.unionByName(incoming.join(stored.select(key), key, "left_anti"), allowMissingColumns=True)


def upsert(stored: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """incoming, and the rows of stored whose key it doesn't hold."""
    return incoming.unionByName(stored.join(incoming.select(key), key, "left_anti"), allowMissingColumns=True)


def last_revision(rows: DataFrame, key: str, revision: str) -> DataFrame:
    """Of each key the row with the highest revision."""
    return _last(rows, [key], revision)
