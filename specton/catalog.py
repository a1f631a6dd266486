"""Registered queries of the engine proper, and their SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from specton.plans import analysis, images, models, streams, tables, vectors

MODULES = [vectors, tables, analysis, models, streams, images]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.classify_by_distance(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
