"""Feature cells of a normalized object: outline, vein directions and colours, from its canvas averaged four by four pixels.

Only pixels of the object count. An object without pixels, or with too few inside to measure, is an error: the caller says so.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from specton.functions.canvas import Placed
from specton.functions.raster import pixels

#: Version of the layout; pixels averaged a side; cells, directions, outline bins, hues, chroma steps and their width.
VERSION = "wing-features-2"
FACTOR, COLUMNS, ROWS, DIRECTIONS, OUTLINE, HUES, CHROMAS, CHROMA_STEP = 4, 8, 4, 8, 32, 12, 4, 20.0
#: Shares of a cell's pixels that make it part of the object, or of its inside; the fewest inside; the least contrast.
COVERED, INSIDE, FEWEST, CONTRAST = 0.5, 0.99, 50, 1.0
LENGTHS = {"shape": 2 * OUTLINE + 2, "venation": COLUMNS * ROWS * (DIRECTIONS + 1), "wip": COLUMNS * ROWS * 3 + HUES + CHROMAS}
#: Linear sRGB to XYZ, a row each for X, Y, Z, and the white point.
XYZ = np.array([[0.4124, 0.3576, 0.1805], [0.2126, 0.7152, 0.0722], [0.0193, 0.1192, 0.9505]])
WHITE = np.array([0.95047, 1.0, 1.08883])


@dataclass
class Small:
    """Mean colours of the inside, and the shares of each cell in the object and in its inside."""

    rgb: np.ndarray
    coverage: np.ndarray
    signal: np.ndarray

    @property
    def inside(self) -> np.ndarray:
        return self.signal >= INSIDE


def downsample(placed: Placed, factor: int = FACTOR) -> Small:
    h, w = (n // factor for n in placed.mask.shape)

    def blocks(x: np.ndarray) -> np.ndarray:
        """Sums of whole numbers: rows first, then columns, each by slices."""
        rows = sum(x[k : h * factor : factor, : w * factor].astype(np.int64) for k in range(factor))
        return sum(rows[:, k::factor] for k in range(factor))

    n = blocks(placed.signal)
    rgb = np.stack([blocks(placed.rgb[..., c] * placed.signal) / np.maximum(n, 1) for c in range(3)], -1)
    return Small(rgb, blocks(placed.mask) / factor**2, n / factor**2)


def lab(rgb: np.ndarray) -> np.ndarray:
    c = rgb / 255.0
    c = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    xyz = c @ XYZ.T / WHITE
    f = np.where(xyz > 216 / 24389, np.cbrt(xyz), (24389 / 27 * xyz + 16) / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1)


def _cell(y: np.ndarray, x: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    return y * ROWS // shape[0] * COLUMNS + x * COLUMNS // shape[1]


def _measured(small: Small) -> tuple[np.ndarray, np.ndarray]:
    ys, xs = pixels(small.inside)
    if len(ys) < FEWEST:
        raise ValueError("too little inside the object")
    return ys, xs


def shape(small: Small) -> np.ndarray:
    """66: upper and lower edge in 32 bins along the object, as shares of the canvas's height (a half where a bin is empty), the share of
    the box that is filled, and its height over its width."""
    ys, xs = pixels(small.coverage >= COVERED)
    if not len(ys):
        raise ValueError("the object is empty")
    wide, high = np.ptp(xs) + 1, np.ptp(ys) + 1
    b = (xs - xs.min()) * OUTLINE // wide
    top, low = np.full(OUTLINE, np.inf), np.full(OUTLINE, -np.inf)
    np.minimum.at(top, b, ys)
    np.maximum.at(low, b, ys + 1)
    edges = np.concatenate([top, low]) / small.coverage.shape[0]
    return np.concatenate([np.where(np.isfinite(edges), edges, 0.5), [len(ys) / (wide * high), high / wide]]).astype(np.float32)


def venation(small: Small) -> np.ndarray:
    """288: of 8 x 4 cells, the strength of 8 directions a pixel, then the mean darkness. Light is in deviations from the object's mean, so
    that exposure doesn't matter; without contrast all are zero. Steps are only taken between pixels inside."""
    ys, xs = _measured(small)
    light = small.rgb @ XYZ[1]
    own = light[ys, xs]
    spread = np.sqrt(max(1e-6, own.var()))
    cells = COLUMNS * ROWS
    if spread < CONTRAST:
        return np.zeros(LENGTHS["venation"], np.float32)
    z = (light - own.mean()) / spread
    inner = np.zeros_like(small.inside)
    inner[1:-1, 1:-1] = small.inside[1:-1, 1:-1]
    ys, xs = pixels(inner)
    where = _cell(ys, xs, inner.shape)
    count = np.maximum(1, np.bincount(where, minlength=cells))
    dark = np.bincount(where, -z[ys, xs], cells) / count
    full = np.zeros_like(inner)
    full[1:-1, 1:-1] = inner[1:-1, 1:-1] & small.inside[1:-1, :-2] & small.inside[1:-1, 2:] & small.inside[:-2, 1:-1] & small.inside[2:, 1:-1]
    ys, xs = pixels(full)
    dx, dy = z[ys, xs + 1] - z[ys, xs - 1], z[ys + 1, xs] - z[ys - 1, xs]
    angle = np.arctan2(dy, dx)
    bins = np.minimum(DIRECTIONS - 1, np.floor(np.where(angle < 0, angle + np.pi, angle) / np.pi * DIRECTIONS).astype(np.int64))
    strength = np.bincount(_cell(ys, xs, full.shape) * DIRECTIONS + bins, np.hypot(dx, dy), cells * DIRECTIONS).reshape(cells, -1) / count[:, None]
    return np.concatenate([strength.ravel(), dark]).astype(np.float32)


def wip(small: Small) -> np.ndarray:
    """112: mean L, a, b of 8 x 4 cells, shares of 12 hues weighted by chroma, and shares of 4 steps of chroma. Colour is the signal, so there
    is no white balance."""
    ys, xs = _measured(small)
    v = lab(small.rgb[ys, xs])
    where = _cell(ys, xs, small.inside.shape)
    count = np.maximum(1, np.bincount(where, minlength=COLUMNS * ROWS))
    cells = np.stack([np.bincount(where, v[:, k], COLUMNS * ROWS) / count for k in range(3)], 1)
    chroma = np.hypot(v[:, 1], v[:, 2])
    angle = np.arctan2(v[:, 2], v[:, 1])
    hue = np.minimum(HUES - 1, np.floor(np.where(angle < 0, angle + 2 * np.pi, angle) / (2 * np.pi) * HUES).astype(np.int64))
    step = np.minimum(CHROMAS - 1, np.floor(chroma / CHROMA_STEP).astype(np.int64))
    return np.concatenate([cells.ravel(), np.bincount(hue, chroma, HUES) / (chroma.sum() or 1.0), np.bincount(step, minlength=CHROMAS) / len(ys)]).astype(np.float32)
