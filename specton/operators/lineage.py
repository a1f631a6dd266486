"""Cutting lineage: checkpoints and short-lived tables in the folder that all machines share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in spark.checkpoint.dir; only a session on one machine may do without."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or f"{tempfile.gettempdir()}/specton-checkpoints").rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows as a checkpoint."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def at_once(*steps: Callable) -> list:
    """The results of steps that don't read each other's, their jobs submitted side by side: on a small table each has few tasks, and what
    takes long is that they wait for each other. The first step's error comes first."""
    with ThreadPoolExecutor(len(steps)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(SparkSession.active())(step)) for step in steps]]


@contextmanager
def deleted(spark: SparkSession, path: str) -> Iterator[None]:
    """Delete the folder in the end; nothing lazy may read it then."""
    try:
        yield
    finally:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
