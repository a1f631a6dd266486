"""Images as rows: preprocessing and features, one image a row in Arrow batches, without a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from specton.functions import canvas, cells, raster

RECORD = "path string, status string, reasons array<string>, area long, angle double, elongation double, confidence double, sharpness double, clipped double, shape array<double>, venation array<double>, colour array<double>"


def preprocess(images: DataFrame) -> DataFrame:
    """Of path, width, height, rgba: the object's quality, orientation and feature cells; one that fails has its reason."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([_one(*row) for row in zip(pdf["path"], pdf["width"], pdf["height"], pdf["rgba"], strict=True)], columns=[c.split()[0] for c in RECORD.split(", ")])

    return images.select("path", "width", "height", "rgba").mapInPandas(run, RECORD)


def _one(path: str, width: int, height: int, rgba: bytes) -> tuple:
    image = np.frombuffer(rgba, np.uint8).reshape(height, width, 4)[..., :3]
    small, _ = raster.area_average(image)
    mask = raster.segment(small)
    q = raster.quality(mask)
    meters = raster.sharpness(small), raster.clipped_fraction(image)
    if not q.area:
        return (path, q.status, q.reasons, 0, None, None, None, *meters, None, None, None)
    turn = raster.orientation(mask)
    matrix = canvas.normalization(mask, turn, (width / mask.shape[1], height / mask.shape[0]))
    small = cells.downsample(canvas.place(image, mask, matrix))
    blocks = []
    for block in (cells.shape, cells.venation, cells.wip):
        try:
            blocks.append(block(small))
        except ValueError as e:
            blocks.append(None)
            q.reasons.append(str(e))
    return (path, q.status, q.reasons, q.area, turn["angle"], turn["elongation"], turn["confidence"], *meters, *blocks)


def crops(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """name, width, height, rgba of each box (name, x, y, w, h; a fixed short list) of each image."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, x, y, w, h, width, height, rgba in zip(*(pdf[c] for c in ("name", "x", "y", "w", "h", "width", "height", "rgba")), strict=True):
                part = np.frombuffer(rgba, np.uint8).reshape(height, width, 4)[y : y + h, x : x + w]
                rows.append((name, part.shape[1], part.shape[0], part.tobytes()))
            yield pd.DataFrame(rows, columns=["name", "width", "height", "rgba"])

    from pyspark.sql.functions import broadcast

    return images.join(broadcast(boxes)).mapInPandas(cut, "name string, width int, height int, rgba binary")
