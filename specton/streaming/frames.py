"""Frame streams: mergeable statistics, count windows and meters, for batches and for Structured Streaming alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def sums(key: str, value: str) -> list[Column]:
    x = F.col(value)
    return [F.count(x).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("ss")]


def finished(rows: DataFrame) -> DataFrame:
    """mean and noise (the sample deviation; null for one value) from n, s, ss."""
    n = F.col("n")
    var = (F.col("ss") - F.col("s") * F.col("s") / n) / F.when(n > 1, n - 1)
    return rows.withColumn("mean", F.col("s") / F.when(n > 0, n)).withColumn("noise", F.sqrt(F.greatest(var, F.lit(0.0)) + F.when(n <= 1, F.lit(None).cast("double")).otherwise(0.0)))


def statistics(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, mean, noise. On a stream: an aggregation that only keeps the three sums of each key."""
    return finished(rows.groupBy(key).agg(*sums(key, value))).select(key, "n", "mean", "noise")


def count_windows(rows: DataFrame, sequence: str, value: str, size: int) -> DataFrame:
    """window, n, mean of so many frames each, by their sequence numbers."""
    return rows.groupBy(F.floor(F.col(sequence) / size).alias("window")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))


def meters(rows: DataFrame, session: str, at: str, value: str, tie: str) -> DataFrame:
    """Each row with the share of its value in the session's maximum so far (a batch, ordered by time)."""
    w = Window.partitionBy(session).orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0)
    best = F.max(value).over(w)
    return rows.withColumn("share", F.col(value) / F.when(best != 0, best))


def running_maximum(stream: DataFrame, session: str, value: str) -> DataFrame:
    """session, best: the maximum so far of each session of a stream; a new session begins anew."""
    return stream.groupBy(session).agg(F.max(value).alias("best"))


def by_event_time(stream: DataFrame, at: str, key: str, value: str, width: str, late: str) -> DataFrame:
    """window, key, n, mean over event-time windows; rows later than ``late`` are dropped with the state they'd need."""
    w = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, width), key)
    return w.agg(F.count(value).alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), key, "n", "mean")


def last_revisions(stream: DataFrame, key: str, revision: str) -> DataFrame:
    """key, revision: the newest of each key; older results that arrive late change nothing."""
    return stream.groupBy(key).agg(F.max(revision).alias(revision))


def to_memory(result: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Run a stream over what its source holds now, into an in-memory table."""
    return result.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
