"""Queries of images: every embedding drawn as an object on a rig's light, its label naming the rig."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specton.operators import pairs, rig

#: Side of a drawn image, its pixel size in micrometres, and frames of an empty rig.
SIDE, MICROMETRES, FRAMES = 160, 20.0, 6
#: Rows a task: an image takes long, but the row that tells it is short, so parts by bytes would be a few tasks of hours.
IMAGES_A_TASK = 256


def spread(rows: DataFrame) -> DataFrame:
    """The rows (id, ...) in parts by their number. Parts go by id, so that a lost one comes back as it was."""
    return rows.repartition(max(1, -(-rows.count() // IMAGES_A_TASK)), "id")


def spread_by_rig(rows: DataFrame) -> DataFrame:
    """The rows (id, rig, ...) in parts by their number, each of few rigs, so that few tasks have sums of one."""
    n, rigs = rows.agg(F.count("*"), F.count_distinct("rig")).first()
    parts = max(1, -(-n // IMAGES_A_TASK))
    return rows.repartition(parts, "rig", F.pmod(F.xxhash64("id"), F.lit(max(1, parts // max(1, rigs)))))


@lru_cache(maxsize=8)
def light(side: int) -> np.ndarray:
    """Light that falls off to the corners, with a colour cast and a speck of dust."""
    y, x = np.mgrid[0:side, 0:side].astype(float)
    r = ((x - side / 2) ** 2 + (y - side / 2) ** 2) / (side / 2) ** 2
    speck = np.where(np.hypot(x - side * 0.5, y - side * 0.3) < side / 40, 0.35, 1.0)
    out = (235 * (1 - 0.45 * np.minimum(1, r / 2)) * speck)[..., None] * [1.0, 0.9, 0.78]
    out.setflags(write=False)
    return out


def wing(v: np.ndarray, side: int) -> np.ndarray:
    """An elongated object, whose turn, place, size and waist come from four numbers."""
    a, dx, dy, s = np.tanh(v[:4])
    at = np.arange(side, dtype=float)
    x, y = (at - side / 2 - dx * side / 20)[None, :], (at - side / 2 - dy * side / 20)[:, None]
    k, c, n = side / 360 * (1 + 0.15 * s), np.cos(a / 2), np.sin(a / 2)
    u, w = (x * c + y * n) / k, (-x * n + y * c) / k
    # The outline's bend and width never exceed 8 and 50.
    near = (np.abs(u) < 110) & (np.abs(w) < 60)
    t = np.clip((u[near] + 110) / 220, 0, 1)
    bend = np.sin(np.pi * t)
    near[near] = np.abs(w[near] - 8 * bend) < 50 * bend**0.65 * (0.3 + 0.7 * t)
    return near


def rgba(mask: np.ndarray | None, seed: int, side: int, gain: float = 1.0, sigma: float = 2.0) -> bytes:
    own = np.random.default_rng(seed).normal(0, sigma, (side, side, 3))
    own += light(side) * gain if mask is None else light(side) * gain * np.where(mask, 0.39, 1.0)[..., None]
    out = np.full((side, side, 4), 255, np.uint8)
    whole = np.clip(np.rint(own, out=own), 0, 255, out=own).astype(np.uint8)
    for c in range(3):
        out[..., c] = whole[..., c]
    return out.tobytes()


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("label IS NOT NULL AND embedding IS NOT NULL")
    return rows.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("rig"), F.slice("embedding", 1, 4).cast("array<double>").alias("v"))


def drawn(rows: DataFrame, side: int = SIDE) -> DataFrame:
    """path, rig, modality, width, height, rgba, um_per_px of each row (id, rig, v)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), 16):
                part = pdf.iloc[k : k + 16]
                data = [rgba(wing(np.asarray(v), side), int(i), side) for i, v in zip(part["id"], part["v"], strict=True)]
                yield pd.DataFrame({"path": part["id"].astype(str), "rig": part["rig"], "modality": "venation", "width": np.int32(side), "height": np.int32(side), "rgba": data, "um_per_px": MICROMETRES})

    return rows.mapInPandas(run, "path string, rig string, modality string, width int, height int, rgba binary, um_per_px double")


def empty_frames(rows: DataFrame, side: int = SIDE) -> DataFrame:
    """Frames of every rig without an object: one of each row, so that a burst is as long as the rig has rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), 16):
                part = pdf.iloc[k : k + 16]
                yield pd.DataFrame({"rig": part["rig"], "modality": "venation", "kind": "transmitted", "role": "background", "frame": part["id"], "width": np.int32(side), "height": np.int32(side), "data": [rgba(None, -int(i) % (1 << 31), side) for i in part["id"]]})

    return rows.mapInPandas(run, "rig string, modality string, kind string, role string, frame long, width int, height int, data binary")


def rig_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rig.profiles(empty_frames(spread_by_rig(_rows(spark, sf_dir))))
    return out.select("rig", "frames", *[F.round(c, 3).alias(c) for c in ("noise", "target", "red", "green", "blue", "limit")])


def rig_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every drawn image under the profile of its rig."""
    rows = _rows(spark, sf_dir)
    out = rig.preprocess(drawn(spread(rows)), rig.profiles(empty_frames(spread_by_rig(rows))))
    return out.select("path", "status", "method", "drift", "area", F.round("length_mm", 3).alias("length_mm"), F.round("area_mm2", 3).alias("area_mm2"), "reliable")


#: Canvas and margin of the small drawn images.
CANVAS, MARGIN = (320, 160), 10


def pictured(id: int, modality: str, v: np.ndarray) -> np.ndarray:
    """The object of four numbers: dark with darker veins where light shines through, or in a colour of three more numbers."""
    v, vein = np.asarray(v), (np.arange(SIDE) // 4 % 4 == 0) & (modality == "venation")
    mask = wing(v[:4], SIDE)
    colour = np.array([90.0, 70, 50]) if modality == "venation" else 70 + 60 * (1 + np.tanh(v[4:7])) / 2
    own = np.random.default_rng(int(id) % (1 << 31)).normal(0, 1.5, (SIDE, SIDE, 3))
    own += np.array([[230.0, 228, 225], colour, colour * 0.6]).take(mask * (1 + vein[:, None]), axis=0)
    return np.clip(np.rint(own, out=own), 0, 255, out=own).astype(np.uint8)


def registered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 2 k and 2 k + 1 as the two images of specimen k: overlap before and after registration, and what the cells add up to."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    odd = F.pmod("vec_id", F.lit(2)) == 1
    named = rows.select(F.floor(F.col("vec_id") / 2).cast("string").alias("specimen"), F.when(odd, pairs.MOVING).otherwise(pairs.STILL).alias("modality"), F.col("vec_id").cast("string").alias("path"), F.col("vec_id").alias("id"), F.slice("embedding", 1, 7).cast("array<double>").alias("v"), F.lit(MICROMETRES).alias("um_per_px"))
    out = pairs.registered(spread(named), read=pictured, columns=("id", "modality", "v"), size=CANVAS, margin=MARGIN)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 2).alias(c)
    return out.select("specimen", "still", "moving", "status", F.concat_ws("; ", "reasons").alias("reasons"), *[F.round(c, 4).alias(c) for c in ("initial", "overlap", "scale", "degrees")], *map(total, ("shape", "venation", "wip", "size")))


QUERIES = {"registered_pairs": (registered_pairs, None), "rig_profiles": (rig_profiles, None), "rig_images": (rig_images, None)}
