"""Rig profiles: what an empty rig looks like, fitted from bursts of frames, kept as a keyed table, and used on images of that rig.

The first pass over the frames adds up pixels (``streaming.pixels``), so that a burst of any length gives one mean image and its
noise; the second makes of each mean image the light field, the background at the analysed size and the limit of drift.
Images join their rig's profile by rig and modality: one of another size is noted, not corrected. A rig that drifted isn't
compared pixel by pixel, and its image is to be reviewed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specton.functions import raster
from specton.operators.lineage import cut
from specton.operators.references import assert_none
from specton.streaming import pixels

VERSION = "specton-rig-1"
PROFILE = "rig string, modality string, kind string, version string, width int, height int, analysed int, field binary, field_height int, field_width int, target double, light string, background binary, background_height int, background_width int, frames long, noise double, clipped double, red double, green double, blue double, limit double"
SEPARATOR = "\u0001"


def profiles(frames: DataFrame, analysed: int = raster.ANALYSED) -> DataFrame:
    """A row of PROFILE for each rig and modality. frames: rig, modality, kind (transmitted or reflected), role (background or card), frame,
    width, height, data.

    Under transmitted light the background is the light; under reflected light only a grey card, if there is one, tells it. An
    error: a modality without background frames, of two kinds, or with a card of another size; a light field that is too dark."""
    # A row a burst and size, and a few a tile: frames are long to make or read, so they are passed through twice and not for every rule.
    seen = cut(pixels.sizes(frames, ["rig", "modality", "kind", "role"]))
    keys = seen.groupBy("rig", "modality").agg(F.sum(F.when(F.col("role") == "background", F.col("n")).otherwise(0)).alias("n"), F.count_distinct("kind").alias("kinds"), F.sum(F.when(~F.col("kind").isin("transmitted", "reflected") | ~F.col("role").isin("background", "card"), F.col("n")).otherwise(0)).alias("odd"))
    assert_none(keys.agg(F.count_if(F.col("n") == 0).alias("without_background"), F.count_if(F.col("kinds") != 1).alias("kinds"), F.coalesce(F.sum("odd"), F.lit(0)).alias("unknown_kind_or_role")))
    pixels.check_sizes(seen, ["rig", "modality", "kind", "role"])
    tiles = cut(pixels.sums(frames.withColumn("session", F.concat_ws(SEPARATOR, "rig", "modality", "kind", "role"))))
    parts = F.split("session", SEPARATOR)
    mean = pixels.images(tiles).join(pixels.noise(tiles).select("session", "noise"), "session", "left")
    named = mean.select(*[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(("rig", "modality", "kind", "role"))], F.struct("width", "height", "frames", "data", "noise").alias("m"))
    both = named.groupBy("rig", "modality", "kind").agg(F.max(F.when(F.col("role") == "background", F.col("m"))).alias("background"), F.max(F.when(F.col("role") == "card", F.col("m"))).alias("card"))
    assert_none(both.agg(F.count_if(F.col("card").isNotNull() & ((F.col("card.width") != F.col("background.width")) | (F.col("card.height") != F.col("background.height")))).alias("cards_of_another_size")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([_profile(*row, analysed) for row in zip(pdf["rig"], pdf["modality"], pdf["kind"], pdf["background"], pdf["card"], strict=True)], columns=[c.split()[0] for c in PROFILE.split(", ")])

    return both.mapInPandas(run, PROFILE)


def _image(data: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, 4)


def _profile(rig: str, modality: str, kind: str, bg: dict, card: dict | None, analysed: int) -> tuple:
    image = _image(bg["data"], bg["width"], bg["height"])[..., :3]
    source = bg if kind == "transmitted" else card
    field = raster.illumination_field(_image(source["data"], source["width"], source["height"])) if source is not None else None
    corrected = raster.flat_field_correct(image, field) if field is not None else image
    small = np.clip(np.rint(raster.area_average(corrected, analysed)[0]), 0, 255).astype(np.uint8)
    noise = None if bg["noise"] is None or np.isnan(bg["noise"]) else float(bg["noise"])
    light = "background" if kind == "transmitted" else "card" if card is not None else None
    cells = (field.data.astype(np.float32).tobytes(), *field.data.shape[:2], field.target) if field is not None else (None, None, None, None)
    means = corrected.reshape(-1, 3).mean(0).tolist()
    return (rig, modality, kind, VERSION, bg["width"], bg["height"], analysed, *cells, light, small.tobytes(), *small.shape[:2], bg["frames"], noise, raster.clipped_fraction(image), *means, max(6.0, 4 * (noise or 0.0)))


def options(images: DataFrame, profile: DataFrame) -> DataFrame:
    """The images (rig, modality, width, height, ...) with profile, a struct that is null if there is none of their size, and note.
    Profiles are a row a rig and modality, and are sent to the images, which would otherwise meet by rig in a few tasks."""
    found = profile.select(F.col("rig"), F.col("modality"), F.struct(*[c.split()[0] for c in PROFILE.split(", ")]).alias("profile"))
    joined = images.join(F.broadcast(found), ["rig", "modality"], "left")
    fits = (F.col("profile.width") == F.col("width")) & (F.col("profile.height") == F.col("height"))
    note = F.when(F.col("rig").isNull() | F.col("modality").isNull() | F.col("profile").isNull(), "no profile").when(~fits, "another size")
    return joined.withColumn("note", note).withColumn("profile", F.when(fits, F.col("profile")))


def micrometres(ax: Column, ay: Column, bx: Column, by: Column, millimetres: Column) -> Column:
    """Micrometres a pixel from two points of a ruler and their distance; null for points that are near each other or no distance."""
    px = F.sqrt(F.pow(bx - ax, F.lit(2.0)) + F.pow(by - ay, F.lit(2.0)))
    return F.when((millimetres > 0) & (px >= 10), millimetres * 1000 / px)


RECORD = "path string, status string, reasons array<string>, method string, drift string, difference double, limit double, threshold double, area long, length_mm double, area_mm2 double, reliable boolean, size array<double>, mask binary, mask_width int, mask_height int"


def preprocess(images: DataFrame, profile: DataFrame, longest: int = raster.ANALYSED) -> DataFrame:
    """Of each image (path, rig, modality, width, height, rgba; um_per_px if known) under its rig's profile: its object, what is to be reviewed,
    and its metric size: length and area in millimetres, and their logarithms as a feature block if nothing touches the edge.
    An image of another size than its profile's is treated as one without, with the note among the reasons."""
    scale = F.col("um_per_px") if "um_per_px" in images.columns else F.lit(None)
    own = options(images.withColumn("um_per_px", scale.cast("double")), profile)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([_one(*row, longest) for row in zip(*(pdf[c] for c in ("path", "width", "height", "rgba", "um_per_px", "profile", "note")), strict=True)], columns=[c.split()[0] for c in RECORD.split(", ")])

    return own.select("path", "width", "height", "rgba", "um_per_px", "profile", "note").mapInPandas(run, RECORD)


@dataclass
class Analysed:
    """An image under its rig's light, its object in analysed pixels, and what is to be reviewed."""

    image: np.ndarray
    scale: float
    own: raster.Segmentation
    quality: raster.Quality
    reasons: list[str]
    state: str | None
    difference: float | None
    limit: float | None
    method: str

    def metric(self, um_per_px: float | None) -> tuple[float | None, float | None, bool | None, list[float] | None]:
        """Length and area in millimetres, whether nothing is cut off, and the feature block; null without a scale or an object."""
        if not self.quality.area or um_per_px is None or um_per_px != um_per_px:
            return None, None, None, None
        step = um_per_px / 1000 / self.scale
        length, area = raster.length_along(self.own.mask) * step, self.quality.area * step * step
        reliable = "touches edge" not in self.quality.reasons
        return length, area, reliable, [float(np.log(length)), float(np.log(area))] if reliable and length > 0 else None


def analysed(image: np.ndarray, profile: dict | None, note: str | None, longest: int = raster.ANALYSED) -> Analysed:
    """Whole numbers of a struct come as floats if another row of the batch has none."""
    state, difference, limit, background, reasons = None, None, None, None, []
    if profile is not None:
        if profile["field"] is not None:
            light = np.frombuffer(profile["field"], np.float32).reshape(int(profile["field_height"]), int(profile["field_width"]), 3)
            image = raster.flat_field_correct(image, raster.Field(light, profile["target"]))
        longest = int(profile["analysed"])
    small, scale = raster.area_average(image, longest)
    if profile is not None:
        background = np.frombuffer(profile["background"], np.uint8).reshape(int(profile["background_height"]), int(profile["background_width"]), 3)
        state, difference, limit = raster.drift_check(np.clip(np.rint(small), 0, 255), background, profile["noise"])
        if state != "ok":
            background = None
            reasons.append("light or background differ from the profile")
    elif note == "another size":
        reasons.append(note)
    own = raster.segmented(small, None if background is None else background.astype(float))
    # What was segmented is one component.
    q = raster.quality(own.mask, 1)
    reasons = q.reasons + ([] if own.plausible or not q.area else ["no plausible object"]) + reasons
    return Analysed(image, scale, own, q, reasons, state, difference, limit, "background difference" if background is not None else "border colour")


def _one(path: str, width: int, height: int, rgba: bytes, um_per_px: float, profile: dict | None, note: str | None, longest: int) -> tuple:
    a = analysed(np.ascontiguousarray(_image(rgba, width, height)[..., :3]), profile, note, longest)
    length, area, reliable, size = a.metric(um_per_px)
    mask = a.own.mask
    return (path, "REVIEW" if a.reasons else "GOOD", a.reasons, a.method, a.state, a.difference, a.limit, a.own.threshold, a.quality.area, length, area, reliable, size, np.packbits(mask).tobytes(), mask.shape[1], mask.shape[0])
