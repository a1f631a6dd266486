"""Raster kernels in numpy: what one image of a row goes through. Masks are boolean arrays, images height x width x 3."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Fixed value: longest side analysed. Pixels of images whose gain is kept.
ANALYSED, KEPT = 640, 1 << 17


def area_average(image: np.ndarray, longest: int = ANALYSED) -> tuple[np.ndarray, float]:
    """The image at most so long a side, each pixel the mean of those it covers; and the scale."""
    h, w = image.shape[:2]
    scale = min(1.0, longest / max(h, w))
    if scale == 1.0:
        return image.astype(float), 1.0
    ys, xs = (np.unique(np.floor(np.arange(max(1, round(n * scale))) / scale).astype(int)) for n in (h, w))
    sums = np.add.reduceat(np.add.reduceat(image.astype(float), ys, 0), xs, 1)
    area = np.diff(np.append(ys, h))[:, None] * np.diff(np.append(xs, w))[None, :]
    return sums / area[..., None], scale


def blur(x: np.ndarray, radius: int) -> np.ndarray:
    """A separable box mean; edges repeat."""
    for axis in (0, 1):
        pad = [(radius + 1, radius) if a == axis else (0, 0) for a in range(x.ndim)]
        c = np.cumsum(np.pad(x.astype(float), pad, mode="edge"), axis)
        n = x.shape[axis]
        x = (np.take(c, range(2 * radius + 1, 2 * radius + 1 + n), axis) - np.take(c, range(n), axis)) / (2 * radius + 1)
    return x


def dilate(mask: np.ndarray, radius: int) -> np.ndarray:
    """The mask grown by a disc."""
    out, (h, w) = mask.copy(), mask.shape
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            if dx * dx + dy * dy <= radius * radius:
                y0, y1, x0, x1 = max(0, dy), min(h, h + dy), max(0, dx), min(w, w + dx)
                out[y0:y1, x0:x1] |= mask[y0 - dy : y1 - dy, x0 - dx : x1 - dx]
    return out


def close(mask: np.ndarray, radius: int) -> np.ndarray:
    return ~dilate(~dilate(mask, radius), radius)


def pixels(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a mask's pixels as np.nonzero gives them, which is slow where many are set."""
    at = np.flatnonzero(mask)
    y = at // mask.shape[1]
    return y, at - y * mask.shape[1]


def components(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """4-connected labels from 1 in order of first pixel (0 outside), and their number. Rows are taken as runs, and runs of neighbouring
    rows that overlap are joined, so time goes with the runs and not with the pixels."""
    h, w = mask.shape
    edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = pixels(edge == 1)
    end = pixels(edge == -1)[1]
    place = row * (w + 1)
    first = np.searchsorted(place + end, place + w + 1 + start, side="right")
    size = np.maximum(np.searchsorted(place + start, place + w + 1 + end, side="left") - first, 0)
    a = np.repeat(np.arange(len(row)), size)
    b = np.repeat(first - np.cumsum(size) + size, size) + np.arange(len(a))
    root = np.arange(len(row))
    while True:
        low = np.minimum(root[a], root[b])
        now = root.copy()
        np.minimum.at(now, root[a], low)
        np.minimum.at(now, root[b], low)
        while (now[now] != now).any():
            now = now[now]
        if (now == root).all():
            break
        root = now
    ids, own = np.unique(root, return_inverse=True)
    out = np.zeros((h, w), np.int64)
    out[mask] = np.repeat(own + 1, end - start)
    return out, len(ids)


def fill_holes(mask: np.ndarray) -> np.ndarray:
    """Background that doesn't reach the border becomes part of the mask."""
    label, n = components(~mask)
    if n == 1 and not mask[[0, -1]].all():
        return mask.copy()
    outside = np.zeros(n + 1, bool)
    for edge in (label[0], label[-1], label[:, 0], label[:, -1]):
        outside[edge] = True
    return mask | ~outside[label]


@lru_cache(maxsize=8)
def border_band(h: int, w: int) -> np.ndarray:
    """Three pixels along the border, a little inside it: publication frames are one pixel wide."""
    y, x = np.arange(h)[:, None], np.arange(w)[None, :]
    edge = np.minimum(np.minimum(x, y), np.minimum(w - 1 - x, h - 1 - y))
    inset = max(2, int(np.floor(min(h, w) * 0.025 + 0.5)))
    out = (edge >= inset) & (edge < inset + 3)
    out.setflags(write=False)
    return out


def _middle(x: np.ndarray) -> float:
    return float(np.sort(x)[len(x) // 2])


@dataclass
class Segmentation:
    mask: np.ndarray
    plausible: bool
    threshold: float
    noise: float
    background: np.ndarray


def segmented(image: np.ndarray, background: np.ndarray | None = None, alpha: np.ndarray | None = None) -> Segmentation:
    """The largest plausible object of an image: colour distance, over a threshold, to the border band's dominant colour, or pixel by
    pixel to the empty background; closed and filled. Objects of under half a hundredth or over four fifths of the image, or that
    aren't elongated, are only taken if there is no other."""
    h, w = image.shape[:2]
    if background is not None and background.shape[:2] != (h, w):
        raise ValueError("the background has another size")
    opaque = np.ones((h, w), bool) if alpha is None else alpha > 127
    band = border_band(h, w) & opaque
    band = band if band.any() else np.ones((h, w), bool)
    r, g, b = (np.clip(image[..., c][band], 0, 255).astype(int) >> 4 for c in range(3))
    levels = r * 256 + g * 16 + b
    own = band.copy()
    own[band] = levels == np.bincount(levels).argmax()
    dominant = np.array([_middle(image[..., c][own]) for c in range(3)])
    r, g, b = ((image[..., c] - (dominant[c] if background is None else background[..., c])) ** 2 for c in range(3))
    distance = np.sqrt((r + g + b) / 3)
    noise = _middle(distance[own if background is None else band])
    threshold = max(9.0, 3 * noise + 5) if background is None else max(5.0, 3 * noise + 3)
    radius = max(1, int(np.floor(max(h, w) / 250 + 0.5)))
    # Padded, so that an object at the edge stays there.
    closed = close(np.pad((distance > threshold) & opaque, 2 * radius), radius)[2 * radius : -2 * radius, 2 * radius : -2 * radius]
    mask = fill_holes(closed)
    label, n = components(mask)
    if not n:
        return Segmentation(mask, False, threshold, noise, dominant)
    sizes = np.bincount(label.ravel(), minlength=n + 1)
    order = np.argsort(-sizes[1:], kind="stable") + 1
    for k in order:
        if 0.005 * mask.size <= sizes[k] <= 0.8 * mask.size and 2 <= _elongation(label == k) <= 100:
            return Segmentation(label == k, True, threshold, noise, dominant)
    return Segmentation(label == order[0], False, threshold, noise, dominant)


def _elongation(mask: np.ndarray) -> float:
    """The ratio of the long and short second moments."""
    ys, xs = (v - v.mean() for v in pixels(mask))
    xx, xy, yy = (xs * xs).sum(), (xs * ys).sum(), (ys * ys).sum()
    delta = np.hypot(xx - yy, 2 * xy)
    return float((xx + yy + delta) / max(1.0, xx + yy - delta))


def segment(image: np.ndarray, background: np.ndarray | None = None) -> np.ndarray:
    return segmented(image, background).mask


@dataclass
class Quality:
    area: int
    bbox: tuple[int, int, int, int]
    reasons: list[str]

    @property
    def status(self) -> str:
        return "REVIEW" if self.reasons else "GOOD"


def quality(mask: np.ndarray, pieces: int | None = None) -> Quality:
    """Area, bounding box (x0, y0, x1, y1) and the reasons to review. pieces: the number of the mask's components, where it is known."""
    area = int(mask.sum())
    if not area:
        return Quality(0, (0, 0, 0, 0), ["empty"])
    ys, xs = pixels(mask)
    box = (int(xs.min()), int(ys.min()), int(xs.max()), int(ys.max()))
    n = components(mask)[1] if pieces is None else pieces
    share = area / mask.size
    edge = box[0] == 0 or box[1] == 0 or box[2] == mask.shape[1] - 1 or box[3] == mask.shape[0] - 1
    checks = [("touches edge", edge), ("too small", share < 0.01), ("too large", share > 0.8), ("fragmented", n > 1)]
    return Quality(area, box, [r for r, bad in checks if bad])


def length_along(mask: np.ndarray) -> float:
    """The object's extent along its long axis, a pixel being one wide."""
    ys, xs = (v - v.mean() for v in pixels(mask))
    angle = 0.5 * np.arctan2(2 * (xs * ys).sum(), (xs * xs).sum() - (ys * ys).sum())
    along = xs * np.cos(angle) + ys * np.sin(angle)
    return float(np.ptp(along)) + 1.0 if len(along) else 0.0


def orientation(mask: np.ndarray) -> dict[str, float]:
    """Centre, angle of the long axis (base, the narrower end, to the left), elongation and confidence."""
    ys, xs = pixels(mask)
    cx, cy = xs.mean(), ys.mean()
    cov = np.cov(np.stack([xs - cx, ys - cy])) if len(xs) > 1 else np.eye(2)
    angle = 0.5 * np.arctan2(2 * cov[0, 1], cov[0, 0] - cov[1, 1])
    values = np.sort(np.linalg.eigvalsh(cov))
    u, v = (xs - cx) * np.cos(angle) + (ys - cy) * np.sin(angle), -(xs - cx) * np.sin(angle) + (ys - cy) * np.cos(angle)
    b = np.minimum(39, ((u - u.min()) / max(np.ptp(u), 1e-9) * 40).astype(int))
    top, low = np.full(40, -np.inf), np.full(40, np.inf)
    np.maximum.at(top, b, v)
    np.minimum.at(low, b, v)
    width = np.where(np.isfinite(top), top - low, 0)
    left, right = width[3:13].mean(), width[27:37].mean()
    if left > right:
        angle += np.pi
    return {"cx": float(cx), "cy": float(cy), "angle": float(angle), "elongation": float(np.sqrt(values[1] / max(values[0], 1e-9))), "confidence": float(abs(left - right) / max(left + right, 1e-9))}


def iou(a: np.ndarray, b: np.ndarray) -> float:
    either = (a | b).sum()
    return float((a & b).sum() / either) if either else 0.0


def luminance(image: np.ndarray) -> np.ndarray:
    return image[..., 0] * 0.2126 + image[..., 1] * 0.7152 + image[..., 2] * 0.0722


def clipped_fraction(image: np.ndarray) -> float:
    return float((image[..., :3] >= 254).any(-1).mean())


def sharpness(image: np.ndarray) -> float:
    y = luminance(image)
    return float((4 * y[1:-1, 1:-1] - y[:-2, 1:-1] - y[2:, 1:-1] - y[1:-1, :-2] - y[1:-1, 2:]).var()) if min(y.shape) > 2 else 0.0


@dataclass
class Field:
    """Light over the frame in a coarse grid, and the level that corrected pixels of the reference get in every channel."""

    data: np.ndarray
    target: float


def _spread_light(x: np.ndarray, radius: int) -> np.ndarray:
    """A separable box mean over what is inside the frame."""
    for axis in (0, 1):
        n = x.shape[axis]
        c = np.concatenate([np.zeros_like(np.take(x, [0], axis)), np.cumsum(x, axis)], axis)
        low, high = np.maximum(np.arange(n) - radius, 0), np.minimum(np.arange(n) + radius + 1, n)
        count = (high - low).reshape([-1 if a == axis else 1 for a in range(x.ndim)])
        x = (np.take(c, high, axis) - np.take(c, low, axis)) / count
    return x


def illumination_field(frame: np.ndarray, longest: int = 128, radius: int = 2) -> Field:
    """The light of an empty frame: its means in a coarse grid, blurred, so that dust isn't part of it. The common target of all
    channels is the mean of their ninth deciles, as dark edges may fill half a frame; an error if a channel is too dark."""
    data = _spread_light(area_average(frame[..., :3], longest)[0], radius)
    flat = np.sort(data.reshape(-1, 3), 0)
    levels = flat[int(len(flat) * 0.9)]
    if (levels < 12).any():
        raise ValueError("the frame is too dark")
    return Field(data.astype(np.float32), float(levels.mean()))


def _gain(data: bytes, kind: str, shape: tuple[int, ...], target: float, h: int, w: int) -> np.ndarray:
    """What a field multiplies an image of h x w with: between grid cells by lines."""
    light = np.frombuffer(data, kind).reshape(shape).astype(float)
    gy, gx = (np.clip((np.arange(n) + 0.5) * k / n - 0.5, 0, k - 1) for n, k in ((h, light.shape[0]), (w, light.shape[1])))
    y0, x0 = np.floor(gy).astype(int), np.floor(gx).astype(int)
    y1, x1 = np.minimum(y0 + 1, light.shape[0] - 1), np.minimum(x0 + 1, light.shape[1] - 1)
    fy, fx = (gy - y0)[:, None, None], (gx - x0)[None, :, None]
    own = (light[y0][:, x0] * (1 - fx) + light[y0][:, x1] * fx) * (1 - fy) + (light[y1][:, x0] * (1 - fx) + light[y1][:, x1] * fx) * fy
    return target / np.maximum(1.0, own)


#: Images of a rig have one gain; those of small images are kept.
_kept_gain = lru_cache(maxsize=16)(_gain)


def flat_field_correct(image: np.ndarray, field: Field) -> np.ndarray:
    """The image under even light: each sample times target over the light there; clipped samples stay clipped."""
    h, w = image.shape[:2]
    gain = (_kept_gain if h * w <= KEPT else _gain)(field.data.tobytes(), field.data.dtype.str, field.data.shape, field.target, h, w)
    own = image * gain
    np.clip(np.rint(own, out=own), 0, 255, out=own)
    np.copyto(own, 255, where=image >= 255)
    return own.astype(np.uint8)


def drift_check(image: np.ndarray, background: np.ndarray, noise: float | None) -> tuple[str, float | None, float]:
    """ok, drift or mismatch; the median distance of the border bands, and what it may be."""
    limit = max(6.0, 4 * (noise or 0.0))
    if image.shape != background.shape:
        return "mismatch", None, limit
    band = border_band(*image.shape[:2])
    median = _middle(np.sqrt(((image[band].astype(float) - background[band]) ** 2).sum(-1) / 3))
    return ("drift" if median > limit else "ok"), median, limit


def drift(image: np.ndarray, background: np.ndarray, noise: float) -> str:
    return drift_check(image, background, noise)[0]
