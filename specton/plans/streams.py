"""Queries of frame bursts and live meters, as batches and as streams that run over what their source holds now."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specton.operators.lineage import cut, deleted, shared_folder
from specton.sources.files import table_stream
from specton.streaming import meters, pixels

_E = "f AS (SELECT CAST(label AS VARCHAR) AS session, vec_id, list_transform(embedding, lambda x: CAST(greatest(0, least(255, floor(128 + 60 * CAST(x AS DOUBLE)))) AS INTEGER)) AS d FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL)"


def _through(stream: DataFrame, result: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """result of all rows that the stream appends to a table in the shared folder by now."""
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    with deleted(spark, path):
        stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return cut(result(spark.read.schema(stream.schema).parquet(f"{path}/rows")))


def _frames(rows: DataFrame) -> DataFrame:
    """Each embedding as a frame of 4 x 4 pixels in its label's session: 64 components as 16 pixels of 4 channels."""
    level = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 60 * x.cast("double")))).cast("int"))
    data = F.unhex(F.array_join(F.transform(level, lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    return rows.where("label IS NOT NULL AND embedding IS NOT NULL").select(F.col("label").cast("string").alias("session"), F.col("vec_id").alias("frame"), F.lit(4).alias("width"), F.lit(4).alias("height"), data.alias("data"))


def _embeddings(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    path = f"{sf_dir}/embeddings.parquet"
    return table_stream(spark, path) if stream else spark.read.parquet(path)


def frame_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pixels.noise(pixels.sums(pixels.check(_frames(_embeddings(spark, sf_dir)))))
    return out.select("session", "frames", F.round("noise", 6).alias("noise"))


def streamed_frame_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _through(pixels.stream_sums(_frames(_embeddings(spark, sf_dir, True))), lambda rows: pixels.noise(pixels.newest(rows)))
    return out.select("session", "frames", F.round("noise", 6).alias("noise"))


NOISE_SQL = f"""WITH {_E}, p AS (SELECT session, unnest(range(16)) AS p, d FROM f), l AS (SELECT session, p, 0.2126::DOUBLE * d[4 * p + 1] + 0.7152::DOUBLE * d[4 * p + 2] + 0.0722::DOUBLE * d[4 * p + 3] AS x FROM p),
s AS (SELECT session, p, count(*) AS frames, stddev_samp(x) AS sd FROM l GROUP BY ALL), o AS (SELECT session, max(frames) AS frames, list_sort(list(sd) FILTER (sd IS NOT NULL)) AS sds FROM s GROUP BY session)
SELECT session, frames, round(sds[len(sds) // 2 + 1], 6) AS noise FROM o"""


def mean_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = pixels.images(pixels.sums(pixels.check(_frames(_embeddings(spark, sf_dir)))))
    at = F.explode(F.sequence(F.lit(0), F.octet_length("data") - 1)).alias("idx")
    return image.select("session", "frames", "data", at).select("session", "frames", "idx", F.conv(F.hex(F.substring("data", F.col("idx") + 1, F.lit(1))), 16, 10).cast("int").alias("level"))


MEANS_SQL = f"""WITH {_E}, p AS (SELECT session, unnest(range(64)) AS idx, d FROM f)
SELECT session, count(*) AS frames, CAST(idx AS INTEGER) AS idx, CAST(floor(sum(d[idx + 1]) / CAST(count(*) AS DOUBLE) + 0.5) AS INTEGER) AS level FROM p GROUP BY session, idx"""


def _readings(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("session"), F.col("ts").alias("at"), F.col("event_id").alias("tie"), F.col("event_type").alias("setting"), F.col("value").cast("double").alias("value"))


def metered_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = meters.metered(_readings(spark.read.parquet(f"{sf_dir}/events.parquet")))
    return out.select(F.col("tie").alias("event_id"), "run", F.round("best", 6).alias("best"), F.round("share", 6).alias("share"))


def streamed_meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = table_stream(spark, f"{sf_dir}/events.parquet")
    out = _through(meters.stream_metered(_readings(stream)), lambda rows: rows)
    return out.select(F.col("tie").alias("event_id"), "run", F.round("best", 6).alias("best"), F.round("share", 6).alias("share"))


METERS_SQL = """WITH c AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS changed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(changed) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c),
b AS (SELECT *, max(value) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS best FROM r)
SELECT event_id, CAST(run AS INTEGER) AS run, round(best, 6) AS best, round(value / nullif(best, 0), 6) AS share FROM b"""

QUERIES = {
    "frame_noise": (frame_noise, NOISE_SQL),
    "streamed_frame_noise": (streamed_frame_noise, NOISE_SQL),
    "mean_frames": (mean_frames, MEANS_SQL),
    "metered_settings": (metered_settings, METERS_SQL),
    "streamed_meters": (streamed_meters, METERS_SQL),
}
