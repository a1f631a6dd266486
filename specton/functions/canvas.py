"""The normalized canvas: an object turned level at one scale, laid there by one matrix from original pixels, read from the original once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from specton.functions.raster import pixels

#: Size of the canvas and its margin; a signal pixel's distance to the object's edge.
WIDTH, HEIGHT, MARGIN, INTERIOR = 1024, 512, 32, 2
#: Fixed values of the registration: sampling, bounds (turn in radians, scale, shifts in pixels), steps from coarse to fine, and a good overlap.
STRIDE = 8
LOWER, UPPER = np.array([-0.26, 0.8, -64.0, -32.0]), np.array([0.26, 1.2, 64.0, 32.0])
STEPS = np.array([[0.04, 0.04, 12, 12], [0.015, 0.015, 4, 4], [0.005, 0.005, 1, 1]])
GOOD = 0.9
#: Moves with one step width, in case the overlap rises forever by rounding.
MOVES = 64


def interior(mask: np.ndarray, radius: int = INTERIOR) -> np.ndarray:
    """Pixels whose whole square of that radius lies in the mask; what is outside the image isn't in it."""
    padded = np.pad(mask, (radius + 1, radius)).cumsum(0, dtype=np.int32).cumsum(1, dtype=np.int32)
    n = 2 * radius + 1
    return padded[n:, n:] - padded[:-n, n:] - padded[n:, :-n] + padded[:-n, :-n] == n * n


def normalization(mask: np.ndarray, turn: dict[str, float], pixel: tuple[float, float] = (1.0, 1.0), flipped: bool = False, mirrored: bool = False, width: int = WIDTH, height: int = HEIGHT, margin: int = MARGIN) -> np.ndarray:
    """3 x 3 matrix from original pixels to the canvas: the centroid in the middle, the long axis level, all of the object within the margin.

    mask and turn are in analysed pixels, each pixel (x, y) original ones wide and high."""
    px, py = pixel
    angle = -turn["angle"] + (np.pi if flipped else 0.0)
    rotation = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
    if mirrored:
        rotation[1] *= -1
    ys, xs = pixels(mask)
    reach = np.abs(rotation @ np.stack([(xs - turn["cx"]) * px, (ys - turn["cy"]) * py])).max(1) + max(px, py)
    scale = min((width / 2 - margin) / reach[0], (height / 2 - margin) / reach[1])
    centre = np.array([(turn["cx"] + 0.5) * px - 0.5, (turn["cy"] + 0.5) * py - 0.5])
    out = np.eye(3)
    out[:2, :2] = scale * rotation
    out[:2, 2] = np.array([(width - 1) / 2, (height - 1) / 2]) - out[:2, :2] @ centre
    return out


@dataclass
class Placed:
    """rgb is zero outside mask; signal is the part of mask that is away from the object's edge."""

    rgb: np.ndarray
    mask: np.ndarray
    signal: np.ndarray


def place(image: np.ndarray, mask: np.ndarray, matrix: np.ndarray, size: tuple[int, int] | None = None, corner: tuple[int, int] = (0, 0), width: int = WIDTH, height: int = HEIGHT) -> Placed:
    """The object on the canvas: colours bilinear from original pixels, masks by the nearest analysed pixel.

    image may be a part of the original of that size (height, width), with corner (x, y): all that the mask covers and a pixel more."""
    h, w = size or image.shape[:2]
    mh, mw = mask.shape
    inverse = np.linalg.inv(matrix)
    y, x = np.arange(height)[:, None], np.arange(width)[None, :]
    sx, sy = (inverse[k, 0] * x + inverse[k, 1] * y + inverse[k, 2] for k in (0, 1))
    mx, my = (np.floor((v + 0.5) * m / n).astype(np.int64) for v, m, n in ((sx, mw, w), (sy, mh, h)))
    own = np.flatnonzero((mx >= 0) & (my >= 0) & (mx < mw) & (my < mh) & (sx >= 0) & (sy >= 0) & (sx <= w - 1) & (sy <= h - 1))
    at = my.ravel()[own] * mw + mx.ravel()[own]
    hit = mask.ravel()[at]
    own, at = own[hit], at[hit]
    found, signal, rgb = np.zeros(height * width, bool), np.zeros(height * width, bool), np.zeros((height * width, 3), np.uint8)
    found[own], signal[own] = True, interior(mask).ravel()[at]
    sx, sy = sx.ravel()[own], sy.ravel()[own]
    x0, y0 = np.floor(sx).astype(np.int64), np.floor(sy).astype(np.int64)
    x1, y1 = np.minimum(x0 + 1, w - 1) - corner[0], np.minimum(y0 + 1, h - 1) - corner[1]
    fx, fy = sx - x0, sy - y0
    x0, y0 = x0 - corner[0], y0 - corner[1]
    # A channel at a time: its pixels lie side by side.
    stride = image.shape[1]
    upper, lower, gx, gy = y0 * stride, y1 * stride, 1 - fx, 1 - fy
    corners = upper + x0, upper + x1, lower + x0, lower + x1
    for c in range(3):
        a, b, d, e = (image[..., c].ravel()[at] for at in corners)
        rgb[own, c] = np.clip(np.rint((a * gx + b * fx) * gy + (d * gx + e * fx) * fy), 0, 255)
    return Placed(rgb.reshape(height, width, 3), found.reshape(height, width), signal.reshape(height, width))


def cut(image: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple[int, int]]:
    """The part of the original that ``place`` reads, and its corner (x, y)."""
    ys, xs = pixels(mask)
    bounds = []
    for v, n, m in ((ys, image.shape[0], mask.shape[0]), (xs, image.shape[1], mask.shape[1])):
        bounds.append((max(0, int(np.floor(v.min() * n / m)) - 2), min(n, int(np.ceil((v.max() + 1) * n / m)) + 2)))
    (top, bottom), (left, right) = bounds
    return image[top:bottom, left:right, :3], (left, top)


def similarity(p: np.ndarray, width: int, height: int) -> np.ndarray:
    """Matrices of turns, scales and shifts (... x 4) about the canvas's middle."""
    c, s = np.cos(p[..., 0]) * p[..., 1], np.sin(p[..., 0]) * p[..., 1]
    cx, cy = (width - 1) / 2, (height - 1) / 2
    zero, one = np.zeros_like(c), np.ones_like(c)
    return np.stack([c, -s, cx - c * cx + s * cy + p[..., 2], s, c, cy - s * cx - c * cy + p[..., 3], zero, zero, one], -1).reshape(*p.shape[:-1], 3, 3)


@dataclass
class Registration:
    matrix: np.ndarray
    initial: float
    overlap: float

    @property
    def status(self) -> str:
        return "GOOD" if self.overlap >= GOOD else "REVIEW"


def register(reference: np.ndarray, moving: np.ndarray, stride: int = STRIDE) -> Registration:
    """The similarity that lays a mask on another of its size best: of the eight moves of a step width the best one is taken while one
    helps. The overlap is intersection over union at every stride-th pixel; an object may not leave the canvas (overlap -1), and two
    empty masks overlap by 0."""
    h, w = reference.shape
    grid = np.stack(np.meshgrid(np.arange(0, w, stride), np.arange(0, h, stride)), 0).reshape(2, -1).astype(float)
    target = reference[::stride, ::stride].ravel()
    rows = np.nonzero(moving.any(1))[0]
    # The outermost pixels of the rows hold all corners of the convex hull, and with them whatever could leave the canvas.
    outer = np.stack([np.concatenate([moving[rows].argmax(1), w - 1 - moving[rows, ::-1].argmax(1)]), np.tile(rows, 2)]).astype(float)

    def overlaps(p: np.ndarray) -> np.ndarray:
        m = similarity(p, w, h)
        edge = m[:, :2, :2] @ outer + m[:, :2, 2:]
        left = ((edge < 0) | (edge > np.array([[w - 1], [h - 1]]))).any((1, 2))
        back = np.linalg.inv(m)
        at = np.floor(back[:, :2, :2] @ grid + back[:, :2, 2:] + 0.5).astype(np.int64)
        inside = (at >= 0).all(1) & (at[:, 0] < w) & (at[:, 1] < h)
        moved = inside & moving[np.clip(at[:, 1], 0, h - 1), np.clip(at[:, 0], 0, w - 1)]
        return np.where(left, -1.0, (moved & target).sum(1) / np.maximum(1, (moved | target).sum(1)))

    p = np.array([0.0, 1.0, 0.0, 0.0])
    best = initial = float(overlaps(p[None])[0])
    for step in STEPS:
        moves = np.concatenate([np.diag(step), -np.diag(step)])
        for _ in range(MOVES):
            tried = p + moves
            tried = tried[((tried >= LOWER) & (tried <= UPPER)).all(1)]
            own = overlaps(tried)
            if own.max() <= best + 1e-8:
                break
            p, best = tried[own.argmax()], float(own.max())
    return Registration(similarity(p, w, h), initial, best)


def motion(matrix: np.ndarray) -> dict[str, float]:
    """Scale, shifts and turn in degrees of a similarity's matrix (mirrored or not: the turn of its first axis)."""
    return {"scale": float(np.hypot(matrix[0, 0], matrix[1, 0])), "x": float(matrix[0, 2]), "y": float(matrix[1, 2]), "degrees": float(np.degrees(np.arctan2(matrix[1, 0], matrix[0, 0])))}
