"""Averages of frame bursts: sums for every pixel that merge in any order, on batches and on streams.

A frame is cut into tiles, so that no task holds a whole session of large frames: a tile's sums are 64-bit numbers for each channel,
and for a sample of pixels the sums of luminance and of its square. Tiles of one session add up wherever they are. The temporal
noise is the median over sampled pixels of the deviation over time.

Frames are rows of session, frame, width, height, data (RGBA, row by row). Defined results: frames without data don't count; frames
of one session that differ in size, or whose data don't fit it, are errors; one frame has no noise.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from specton.operators.references import assert_none
from specton.operators.similarity import order_statistic

#: Pixels of a tile, sampled pixels of a frame at least, tiles held at once.
TILE, SAMPLES, HELD = 1 << 16, 20_000, 64
#: Parts of a tile's partial sums that are added up before the whole.
MERGED = 16
_SUMS = "session string, tile int, width int, height int, n long, total binary, s1 binary, s2 binary"
_STATE = "width int, height int, n long, total binary, s1 binary, s2 binary"


def sizes(frames: DataFrame, by: list[str]) -> DataFrame:
    """The columns of by, width, height, n, bad: frames with data, and those of another length than their size needs."""
    bad = F.count_if(F.octet_length("data") != 4 * F.col("width") * F.col("height"))
    return frames.where(F.col("data").isNotNull()).groupBy(*by, "width", "height").agg(F.count("*").alias("n"), bad.alias("bad"))


def check_sizes(seen: DataFrame, by: list[str]) -> None:
    """One size a session, and as many bytes as it needs."""
    assert_none(seen.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("data_length")))
    own = seen.where(F.col("width").isNotNull() & F.col("height").isNotNull()).groupBy(*by).agg(F.count("*").alias("k"))
    assert_none(own.agg(F.count_if(F.col("k") > 1).alias("sessions_of_two_sizes")))


def check(frames: DataFrame) -> DataFrame:
    """One size a session, and as many bytes as it needs."""
    check_sizes(sizes(frames, ["session"]), ["session"])
    return frames


def _tiles(frames: DataFrame) -> DataFrame:
    last = F.ceil(F.col("width") * F.col("height") / TILE).cast("int") - 1
    rows = frames.where(F.col("data").isNotNull()).select(F.col("session").cast("string").alias("session"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "data", F.explode(F.sequence(F.lit(0), last)).alias("tile"))
    return rows.withColumn("data", F.substring("data", F.col("tile") * 4 * TILE + 1, F.lit(4 * TILE)))


def _sampled(width: int, height: int, tile: int, size: int) -> np.ndarray:
    """Which of a tile's pixels are in the frame's sample: every step-th of the frame."""
    step = max(1, width * height // SAMPLES)
    first = tile * size
    return np.arange(-first % step, min(size, width * height - first), step)


def _tile_sums(frames: list[bytes], width: int, height: int, tile: int, size: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    x = np.stack([np.frombuffer(f, np.uint8) for f in frames])
    own = x.reshape(len(frames), -1, 4)[:, _sampled(width, height, tile, size)].astype(float)
    light = 0.2126 * own[:, :, 0] + 0.7152 * own[:, :, 1] + 0.0722 * own[:, :, 2]
    return len(frames), x.sum(0, dtype=np.int64), light.sum(0), (light * light).sum(0)


def _row(session: str, tile: int, width: int, height: int, n: int, total: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> tuple:
    return session, tile, width, height, n, total.tobytes(), s1.tobytes(), s2.tobytes()


def sums(frames: DataFrame) -> DataFrame:
    """Additive sums of tiles: session, tile, width, height, n, total, s1, s2; each tile may have several rows."""

    size, most = TILE, HELD

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        names = [c.split()[0] for c in _SUMS.split(", ")]

        def out() -> pd.DataFrame:
            rows = pd.DataFrame([_row(*k, *v) for k, v in held.items()], columns=names)
            held.clear()
            return rows

        for pdf in batches:
            for (session, tile, width, height), at in pdf.groupby(["session", "tile", "width", "height"]).indices.items():
                new = _tile_sums(pdf["data"].iloc[at].tolist(), width, height, tile, size)
                k = session, int(tile), int(width), int(height)
                held[k] = [a + b for a, b in zip(held[k], new, strict=True)] if k in held else list(new)
                if len(held) >= most:
                    yield out()
        if held:
            yield out()

    return merged(_tiles(frames).mapInPandas(run, _SUMS))


def _numbers(row: Any) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    return row.n, np.frombuffer(row.total, np.int64), np.frombuffer(row.s1, float), np.frombuffer(row.s2, float)


def merged(parts: DataFrame) -> DataFrame:
    """The sums with one row a tile."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = [sum(x) for x in zip(*map(_numbers, pdf.itertuples()), strict=True)]
        first = pdf.iloc[0]
        return pd.DataFrame([_row(first.session, first.tile, first.width, first.height, *total)], columns=pdf.columns)

    # A group is the partial sums of one tile: a row for each task that saw it, so they are added up in two rounds.
    some = parts.groupBy("session", "tile", F.pmod(F.xxhash64("s1", "n"), F.lit(MERGED))).applyInPandas(add, _SUMS)
    return some.groupBy("session", "tile").applyInPandas(add, _SUMS)


def noise(tiles: DataFrame) -> DataFrame:
    """session, frames, noise: the element in the middle of all sampled pixels' deviations over time; null for one frame."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                n, _, s1, s2 = _numbers(row)
                if n > 1 and len(s1):
                    yield pd.DataFrame({"session": row.session, "sd": np.sqrt(np.maximum(0, s2 / n - (s1 / n) ** 2) * (n / (n - 1)))})

    sds = tiles.mapInPandas(spread, "session string, sd double")
    return tiles.groupBy("session").agg(F.max("n").alias("frames")).join(order_statistic(sds, "session", "sd", 0.5).withColumnRenamed("sd", "noise"), "session", "left")


def means(tiles: DataFrame) -> DataFrame:
    """session, tile, width, height, frames, data: the mean frame's tiles, halves rounded up."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            data = [np.clip(np.floor(np.frombuffer(t, np.int64) / n + 0.5), 0, 255).astype(np.uint8).tobytes() for t, n in zip(pdf["total"], pdf["n"], strict=True)]
            yield pd.DataFrame({"session": pdf["session"], "tile": pdf["tile"], "width": pdf["width"], "height": pdf["height"], "frames": pdf["n"], "data": data})

    return tiles.mapInPandas(run, "session string, tile int, width int, height int, frames long, data binary")


def images(tiles: DataFrame) -> DataFrame:
    """session, width, height, frames, data: the mean frame of each session, put together from its tiles."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("tile", "data"))), lambda t: F.hex(t["data"]))
    return means(tiles).groupBy("session", "width", "height", "frames").agg(F.unhex(F.array_join(parts, "")).alias("data"))


def stream_sums(frames: DataFrame) -> DataFrame:
    """The sums of a stream of frames: each batch gives the tiles it has changed, with all frames so far. The last row of a tile (that of most
    frames) equals the sums of a batch over the same frames."""
    names, size = [c.split()[0] for c in _SUMS.split(", ")], TILE

    def add(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        session, tile = key
        width = height = None
        total: list | None = None
        if state.exists:
            width, height, n, *packed = state.get
            total = [n, np.frombuffer(packed[0], np.int64), np.frombuffer(packed[1], float), np.frombuffer(packed[2], float)]
        for pdf in parts:
            for (w, h), at in pdf.groupby(["width", "height"]).indices.items():
                if width is not None and (w, h) != (width, height):
                    raise ValueError("frames of one session differ in size")
                width, height = int(w), int(h)
                new = _tile_sums(pdf["data"].iloc[at].tolist(), width, height, tile, size)
                total = list(new) if total is None else [a + b for a, b in zip(total, new, strict=True)]
        if total is not None:
            row = _row(session, tile, width, height, *total)
            state.update(row[2:])
            yield pd.DataFrame([row], columns=names)

    return _tiles(frames).groupBy("session", "tile").applyInPandasWithState(add, _SUMS, _STATE, "append", GroupStateTimeout.NoTimeout)


def newest(rows: DataFrame) -> DataFrame:
    """Of each tile of a stream's output the row of most frames."""
    columns: list[Column] = [F.col(c.split()[0]) for c in _SUMS.split(", ") if c.split()[0] not in ("session", "tile")]
    best = rows.groupBy("session", "tile").agg(F.max_by(F.struct(*columns), "n").alias("r"))
    return best.select("session", "tile", "r.*")
