"""Two images of one specimen: transmitted light tells outline and veins, reflected light tells colours, registered to the first.

Each image is analysed where Spark reads it. What meets its partner is a canvas mask and, of the image that moves, the cut-out
of its object, as no table of bounded size could bring a transform back to the image: one shuffle by specimen, in which repeated
images are dropped before they are sent. The moving image is then read from its own pixels once, by the composed matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specton.functions import canvas, cells, raster
from specton.operators import rig

#: The modality that stays and the one that moves.
STILL, MOVING = "venation", "wip"
IMAGE = "path string, reasons array<string>, matrix array<double>, mask binary, shape array<double>, venation array<double>, size array<double>, width int, height int, left int, top int, cut binary, cut_width int, cut_height int, object binary, object_width int, object_height int"
RECORD = "specimen string, still string, moving string, status string, reasons array<string>, initial double, overlap double, matrix array<double>, before array<double>, scale double, degrees double, shape array<double>, venation array<double>, wip array<double>, size array<double>, mask binary"


def from_rgba(width: int, height: int, rgba: bytes) -> np.ndarray:
    return np.frombuffer(rgba, np.uint8).reshape(height, width, 4)[..., :3]


def registered(images: DataFrame, profile: DataFrame | None = None, read: Callable[..., np.ndarray] = from_rgba, columns: tuple[str, ...] = ("width", "height", "rgba"), size: tuple[int, int] = (canvas.WIDTH, canvas.HEIGHT), margin: int = canvas.MARGIN, longest: int = raster.ANALYSED) -> DataFrame:
    """A row of RECORD for each specimen of images (specimen, modality, path, the columns that read makes pixels of; um_per_px if known; with
    a profile also rig, width, height).

    matrix leads from original pixels of the moving image to the canvas, before is the one without registration, mask its canvas mask.
    Of several images of a modality the one with the greatest path counts, which is among the reasons. A null specimen has no partner.
    An image without an object has its reason and no features; a missing partner leaves overlap null, the single image keeps what it
    tells. Outline and size are the still image's, if it has them. An unknown modality is an error."""
    own = images.withColumn("um_per_px", (F.col("um_per_px") if "um_per_px" in images.columns else F.lit(None)).cast("double"))
    if profile is None:
        own = own.withColumn("profile", F.lit(None).cast("string")).withColumn("note", F.lit(None).cast("string"))
    else:
        own = rig.options(own, profile)
    width, height = size
    names = [c.split()[0] for c in IMAGE.split(", ")]

    def analyse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), 16):
                part = pdf.iloc[k : k + 16]
                rows = [_analysed(*row[:6], read(*row[6:]), width, height, margin, longest) for row in zip(*(part[c] for c in ("specimen", "modality", "path", "um_per_px", "profile", "note", *columns)), strict=True)]
                yield pd.DataFrame(rows, columns=["specimen", "modality", *names])

    def together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), 16):
                part = pdf.iloc[k : k + 16]
                rows = [_together(*row, width, height) for row in zip(*(part[c] for c in ("specimen", "still", "moving", "repeated")), strict=True)]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")])

    each = own.select(*dict.fromkeys(("specimen", "modality", "path", "um_per_px", "profile", "note", *columns))).mapInPandas(analyse, f"specimen string, modality string, {IMAGE}")
    image = F.struct(*names)
    still, moving = (F.col("modality") == m for m in (STILL, MOVING))
    alone = F.when(F.col("specimen").isNull(), F.struct("path", "modality"))
    pairs = each.groupBy("specimen", alone.alias("alone")).agg(F.max(F.when(still, image)).alias("still"), F.max(F.when(moving, image)).alias("moving"), ((F.count_if(still) > 1) | (F.count_if(moving) > 1)).alias("repeated"))
    return pairs.select("specimen", "still", "moving", "repeated").mapInPandas(together, RECORD)


def _pack(mask: np.ndarray) -> bytes:
    return np.packbits(mask).tobytes()


def _unpack(data: bytes, width: int, height: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=width * height).reshape(height, width).astype(bool)


def _measure(block: Callable[[cells.Small], np.ndarray], small: cells.Small, reasons: list[str]) -> np.ndarray | None:
    try:
        return block(small)
    except ValueError as e:
        reasons.append(str(e))
        return None


def _analysed(specimen: str | None, modality: str, path: str, um_per_px: float | None, profile: dict | None, note: str | None, image: np.ndarray, width: int, height: int, margin: int, longest: int) -> tuple:
    if modality not in (STILL, MOVING):
        raise ValueError(f"unknown modality: {modality}")
    a = rig.analysed(image, profile, note, longest)
    mask, reasons = a.own.mask, [f"{modality}: {r}" for r in a.reasons]
    h, w = a.image.shape[:2]
    if not a.quality.area:
        return (specimen, modality, path, reasons, None, None, None, None, None, w, h, *[None] * 8)
    matrix = canvas.normalization(mask, raster.orientation(mask), (w / mask.shape[1], h / mask.shape[0]), width=width, height=height, margin=margin)
    placed = canvas.place(a.image, mask, matrix, width=width, height=height)
    block = a.metric(um_per_px)[3]
    if modality == STILL:
        small = cells.downsample(placed)
        return (specimen, modality, path, reasons, matrix.ravel(), _pack(placed.mask), _measure(cells.shape, small, reasons), _measure(cells.venation, small, reasons), block, w, h, *[None] * 8)
    part, (left, top) = canvas.cut(a.image, mask)
    return (specimen, modality, path, reasons, matrix.ravel(), _pack(placed.mask), None, None, block, w, h, left, top, part.tobytes(), part.shape[1], part.shape[0], _pack(mask), mask.shape[1], mask.shape[0])


def _together(specimen: str | None, still: dict | None, moving: dict | None, repeated: bool, width: int, height: int) -> tuple:
    reasons = [r for image in (still, moving) if image is not None for r in image["reasons"]] + (["several images"] if repeated else [])
    shape, venation, size = (None if still is None else still[c] for c in ("shape", "venation", "size"))
    initial = overlap = matrix = before = scale = degrees = wip = mask = None
    if moving is not None and moving["matrix"] is not None:
        matrix = before = np.array(moving["matrix"], float).reshape(3, 3)
        if still is not None and still["matrix"] is not None:
            found = canvas.register(_unpack(still["mask"], width, height), _unpack(moving["mask"], width, height))
            initial, overlap, matrix = found.initial, found.overlap, found.matrix @ before
            if found.status != "GOOD":
                reasons.append("outlines don't agree")
        # Whole numbers of a struct come as floats if another row of the batch has none.
        n = {c: int(moving[c]) for c in ("width", "height", "left", "top", "cut_width", "cut_height", "object_width", "object_height")}
        part = np.frombuffer(moving["cut"], np.uint8).reshape(n["cut_height"], n["cut_width"], 3)
        own = _unpack(moving["object"], n["object_width"], n["object_height"])
        placed = canvas.place(part, own, matrix, (n["height"], n["width"]), (n["left"], n["top"]), width, height)
        small = cells.downsample(placed)
        wip, mask = _measure(cells.wip, small, reasons), _pack(placed.mask)
        motion = canvas.motion(matrix)
        scale, degrees, matrix, before = motion["scale"], motion["degrees"], matrix.ravel(), before.ravel()
        if shape is None:
            shape = _measure(cells.shape, small, reasons)
        size = moving["size"] if size is None else size
    if still is None or moving is None:
        reasons.append("no partner")
    return (specimen, *(None if x is None else x["path"] for x in (still, moving)), "REVIEW" if reasons else "GOOD", reasons, initial, overlap, matrix, before, scale, degrees, shape, venation, wip, size, mask)
