"""The canvas, feature cells, registration of masks, and paired images of specimens."""

import numpy as np
import pytest
from pyspark.errors import PythonException

from specton.functions import canvas, cells, raster
from specton.operators import pairs, rig
from specton.plans import images
from tests.test_files import silhouette

IMAGES = "specimen string, modality string, path string, width int, height int, rgba binary, um_per_px double"
SIZE, MARGIN = (320, 160), 10


def mask_of(**change):
    image, _ = silhouette(**change)
    mask = raster.segment(image.astype(float))
    matrix = canvas.normalization(mask, raster.orientation(mask), width=320, height=160, margin=10)
    return canvas.place(image, mask, matrix, width=320, height=160)


def test_place_reads_every_pixel_once():
    r = np.random.default_rng(1)
    image, mask = r.integers(0, 256, (60, 90, 3)).astype(np.uint8), np.zeros((30, 45), bool)
    mask[6:20, 9:40] = r.random((14, 31)) < 0.9
    matrix = canvas.similarity(np.array([0.3, 0.7, -4.0, 3.0]), 80, 50)
    got = canvas.place(image, mask, matrix, width=80, height=50)
    inner = np.array([[all(0 <= y + b < 30 and 0 <= x + a < 45 and mask[y + b, x + a] for a in range(-2, 3) for b in range(-2, 3)) for x in range(45)] for y in range(30)])
    back = np.linalg.inv(matrix)
    for y in range(50):
        for x in range(80):
            u, v, _ = back @ [x, y, 1]
            i, j = int(np.floor((v + 0.5) / 2)), int(np.floor((u + 0.5) / 2))
            here = 0 <= i < 30 and 0 <= j < 45 and 0 <= u <= 89 and 0 <= v <= 59 and mask[i, j]
            assert got.mask[y, x] == here and got.signal[y, x] == (here and inner[i, j])
            if here:
                a, b = int(u), int(v)
                corners = [(image[min(59, b + q), min(89, a + p)].astype(float), (u - a if p else 1 - u + a) * (v - b if q else 1 - v + b)) for p in (0, 1) for q in (0, 1)]
                assert np.abs(sum(c * w for c, w in corners) - got.rgb[y, x]).max() <= 0.5 + 1e-9
            else:
                assert not got.rgb[y, x].any()
    assert got.mask.sum() > 100
    part, corner = canvas.cut(image, mask)
    again = canvas.place(part, mask, matrix, (60, 90), corner, 80, 50)
    assert (again.rgb == got.rgb).all() and part.size < image.size


def test_normalization():
    image, truth = silhouette(angle=0.7, dx=15, dy=-10)
    turn = raster.orientation(truth)
    for flags in ({}, {"flipped": True}, {"mirrored": True}):
        m = canvas.normalization(truth, turn, **flags)
        ys, xs = np.nonzero(truth)
        x, y, _ = m @ np.stack([xs, ys, np.ones(len(xs))])
        assert x.min() >= 32 and x.max() <= 1024 - 33 and y.min() >= 32 and y.max() <= 512 - 33
        assert np.allclose([x.mean(), y.mean()], [511.5, 255.5]) and abs(np.linalg.det(m[:2, :2])) == pytest.approx(np.hypot(*m[:2, 0]) ** 2)
    doubled = canvas.normalization(truth, turn, (2.0, 2.0))
    assert np.allclose(doubled[:2, :2] * 2, canvas.normalization(truth, turn)[:2, :2])
    base = mask_of().mask
    for change in ({"angle": 0.6}, {"angle": 2.5}, {"dx": 20, "dy": -15}, {"scale": 0.8}):
        assert raster.iou(mask_of(**change).mask, base) > 0.9


def test_registration():
    a = mask_of().mask
    same = canvas.register(a, a)
    assert same.overlap == same.initial == 1 and np.allclose(same.matrix, np.eye(3)) and same.status == "GOOD"
    shifted = np.zeros_like(a)
    shifted[4:, 8:] = a[:-4, :-8]
    r = canvas.register(a, shifted)
    assert r.overlap > 0.98 and r.overlap > r.initial and np.allclose(r.matrix[:2, 2] + r.matrix[:2, :2] @ [159.5, 79.5] - [159.5, 79.5], [-8, -4], atol=2)
    turned = canvas.place(np.zeros((160, 320, 3), np.uint8), a, canvas.similarity(np.array([0.08, 1.04, 3.0, -2.0]), 320, 160), width=320, height=160).mask
    r = canvas.register(a, turned)
    assert r.overlap > 0.95 and r.overlap > r.initial and abs(r.matrix[:2, 0] @ r.matrix[:2, 1]) < 1e-12
    full, empty = np.ones_like(a), np.zeros_like(a)
    assert canvas.register(a, empty).overlap == 0 and canvas.register(empty, empty).status == "REVIEW"
    assert canvas.register(full, full).overlap == 1


def test_registration_stays_in_its_bounds():
    a = np.zeros((160, 640), bool)
    b = a.copy()
    a[60:100, 400:560], b[60:100, 60:220] = True, True
    assert canvas.register(a, b).overlap == 0  # farther than a shift may go
    a = np.zeros((160, 320), bool)
    a[:, 100:200] = True  # touches both edges, and may not leave the canvas
    b = np.roll(a, 30, 1)
    b[:40] = False
    r = canvas.register(b, a)
    x, y, _ = r.matrix @ np.stack([*np.nonzero(a)[::-1], np.ones(a.sum())])
    assert r.overlap > r.initial and x.min() >= 0 and y.min() >= 0 and x.max() <= 319 and y.max() <= 159
    scale, turn = np.hypot(*r.matrix[:2, 0]), np.arctan2(r.matrix[1, 0], r.matrix[0, 0])
    assert 0.8 <= scale <= 1.2 and abs(turn) <= 0.26


def canvas_of(rgb, mask):
    return canvas.Placed(np.where(mask[..., None], rgb, 0).astype(np.uint8), mask, canvas.interior(mask))


def test_outline_cells():
    mask = np.zeros((512, 1024), bool)
    mask[128:384, 256:768] = True
    got = cells.shape(cells.downsample(canvas_of([100, 100, 100], mask)))
    assert len(got) == 66 and np.allclose(got[:32], 0.25) and np.allclose(got[32:64], 0.75) and got[64] == 1 and got[65] == 0.5
    mask[:, 256:512] = False
    mask[128:130, 300:304] = True  # half of a cell counts, and the bins between are empty
    got = cells.shape(cells.downsample(canvas_of([100, 100, 100], mask)))
    assert got[1:5].tolist() == [0.5] * 4 and got[0] == np.float32(32 / 128) and got[32] == np.float32(33 / 128)
    with pytest.raises(ValueError):
        cells.shape(cells.downsample(canvas_of([0, 0, 0], np.zeros((512, 1024), bool))))


def test_vein_cells():
    mask = np.ones((512, 1024), bool)
    x = np.arange(1024)[None, :, None] // 8 % 2 * 40 + 100.0
    up = cells.venation(cells.downsample(canvas_of(np.broadcast_to(x, (512, 1024, 3)), mask)))
    assert len(up) == 288 and (up[:256].reshape(32, 8)[:, [0, 7]].sum(1) > 0).all() and (up[:256].reshape(32, 8)[:, 1:7] == 0).all()  # a step down of no slope is half a turn: the last bin
    brighter = cells.venation(cells.downsample(canvas_of(np.broadcast_to(x * 1.2 + 20, (512, 1024, 3)), mask)))
    assert np.allclose(up, brighter, atol=2e-2)  # exposure doesn't matter
    ramp = np.broadcast_to(np.arange(512)[:, None, None] / 4 + 60, (512, 1024, 3))
    down = cells.venation(cells.downsample(canvas_of(ramp, mask)))
    assert (down[:256].reshape(32, 8).argmax(1) == 4).all() and (np.diff(down[256:].reshape(4, 8)[:, 0]) < 0).all()
    assert not cells.venation(cells.downsample(canvas_of([99, 99, 99], mask))).any()
    with pytest.raises(ValueError):
        cells.venation(cells.downsample(canvas_of([99, 99, 99], np.zeros((512, 1024), bool))))
    # By the definition: one cell's figures, pixel by pixel.
    r = np.random.default_rng(2)
    small = cells.downsample(canvas_of(r.integers(0, 256, (512, 1024, 3)), r.random((512, 1024)) < 0.9995))
    light = small.rgb @ [0.2126, 0.7152, 0.0722]
    z = (light - light[small.inside].mean()) / light[small.inside].std()
    strength, dark, n = np.zeros(8), 0.0, 0
    for y in range(32, 64):
        for x in range(32, 64):
            if small.inside[y, x]:
                dark, n = dark - z[y, x], n + 1
                if small.inside[y, x - 1] and small.inside[y, x + 1] and small.inside[y - 1, x] and small.inside[y + 1, x]:
                    gx, gy = z[y, x + 1] - z[y, x - 1], z[y + 1, x] - z[y - 1, x]
                    strength[min(7, int(np.arctan2(gy, gx) % np.pi / np.pi * 8))] += np.hypot(gx, gy)
    got = cells.venation(small)
    assert 0 < n < 1024 and np.allclose(got[9 * 8 : 10 * 8], strength / n, atol=1e-5) and abs(got[256 + 9] - dark / n) < 1e-5


def test_colour_cells():
    mask = np.ones((512, 1024), bool)
    got = cells.wip(cells.downsample(canvas_of([40, 60, 200], mask)))
    own = cells.lab(np.array([40.0, 60, 200]))
    c = np.hypot(own[1], own[2])
    hue = int(np.arctan2(own[2], own[1]) % (2 * np.pi) / (2 * np.pi) * 12)
    # Cells whose every pixel counts are exact; the canvas's edge isn't inside.
    assert len(got) == 112 and np.allclose(got[:96].reshape(32, 3), own, atol=1e-3)
    assert got[96 + hue] == pytest.approx(1) and got[96:108].sum() == pytest.approx(1) and got[108 + min(3, int(c // 20))] == 1
    grey = cells.wip(cells.downsample(canvas_of([120, 120, 120], mask)))
    assert grey[108] == 1 and np.linalg.norm(grey[:96] - got[:96]) > 100


def row(specimen, modality, path, image, um=20.0):
    h, w = image.shape[:2]
    return (specimen, modality, path, w, h, bytearray(np.dstack([image, np.full((h, w), 255)]).astype(np.uint8).tobytes()), um)


def picture(modality, seed, angle=0.0, dx=0.0, scale=1.0):
    image, inside = silhouette(angle=angle, dx=dx, scale=scale)
    own = image.astype(float)
    own[inside] = [60, 90, 170] if modality == "wip" else [90, 70, 50]
    own[inside & (np.mgrid[0:360, 0:360][0] // 6 % 4 == 0)] *= 0.7
    return np.clip(own + np.random.default_rng(seed).normal(0, 1, own.shape), 0, 255).astype(np.uint8)


def test_pairs(spark):
    v, w, blank = picture("venation", 1), picture("wip", 2, 0.9, 12, 0.9), np.full((80, 80, 3), 200, np.uint8)
    rows = [
        row("a", "venation", "a1", v), row("a", "wip", "a2", w), row("b", "venation", "b1", v), row("c", "wip", "c2", w), row(None, "venation", "n1", v), row(None, "wip", "n2", w),
        row("d", "venation", "d1", v), row("d", "wip", "d2", blank), row("d", "wip", "d3", w), row("e", "venation", "e1", v), row("e", "wip", "e2", blank), row("f", "venation", "f1", v, None), row("f", "wip", "f2", w),
    ]
    df = spark.createDataFrame(rows, IMAGES)
    got = {(r.specimen, r.still, r.moving): r for r in pairs.registered(df.repartition(3), size=SIZE, margin=MARGIN).collect()}
    assert set(got) == {("a", "a1", "a2"), ("b", "b1", None), ("c", None, "c2"), (None, "n1", None), (None, None, "n2"), ("d", "d1", "d3"), ("e", "e1", "e2"), ("f", "f1", "f2")}
    a = got["a", "a1", "a2"]
    assert a.status == "GOOD" and a.overlap >= a.initial and a.overlap > 0.95
    assert [len(a[c]) for c in ("shape", "venation", "wip", "size")] == [66, 288, 112, 2]
    # The moving image is read from its own pixels, once, by the composed matrix.
    mask = raster.segment(w.astype(float))
    direct = canvas.place(w, mask, np.array(a.matrix).reshape(3, 3), width=320, height=160)
    assert pairs._pack(direct.mask) == bytes(a.mask) and np.allclose(cells.wip(cells.downsample(direct)), a.wip)
    motion = np.array(a.matrix).reshape(3, 3) @ np.linalg.inv(np.array(a.before).reshape(3, 3))
    assert abs(motion[:2, 0] @ motion[:2, 1]) < 1e-9 and a.scale == pytest.approx(np.hypot(a.matrix[0], a.matrix[3]))
    # A partner changes neither outline nor veins, and without one the moving image tells the outline.
    assert a.shape == got["b", "b1", None].shape == got[None, "n1", None].shape and a.size == got["b", "b1", None].size
    c = got["c", None, "c2"]
    assert c.overlap is None and c.reasons == ["no partner"] and len(c["shape"]) == 66 and c.venation is None and c.matrix == c.before
    assert np.abs(np.array(c["shape"]) - np.array(a["shape"])).max() < 0.1
    d, e, f = got["d", "d1", "d3"], got["e", "e1", "e2"], got["f", "f1", "f2"]
    assert d.reasons == ["several images"] and d.overlap == a.overlap
    assert e.reasons == ["wip: empty"] and e.overlap is None and e.wip is None and len(e.venation) == 288
    assert f.size is not None and f.size != a.size  # the still image has no scale, the moving one has
    assert pairs.registered(df.limit(0), size=SIZE, margin=MARGIN).count() == 0
    with pytest.raises(PythonException, match="unknown modality"):
        pairs.registered(spark.createDataFrame([row("a", "x", "p", v)], IMAGES)).collect()


def test_pairs_under_a_rig(spark):
    side, truth = 240, images.wing(np.array([0.2, 0.1, -0.2, 0.3]), 240)
    frames = [("r", m, "transmitted", "background", k, side, side, bytearray(images.rgba(None, k, side))) for k in range(3) for m in ("venation", "wip")] + [("q", "wip", "reflected", "background", 0, side, side, bytearray(images.rgba(None, 0, side)))]
    profile = rig.profiles(spark.createDataFrame(frames, "rig string, modality string, kind string, role string, frame int, width int, height int, data binary"))
    rows = [("s", "venation", "1", "r", side, side, bytearray(images.rgba(truth, 99, side)), 10.0), ("s", "wip", "2", "r", side, side, bytearray(images.rgba(truth, 98, side)), 10.0), ("t", "venation", "3", "r", side, side, bytearray(images.rgba(truth, 5, side, 0.75)), 10.0)]
    df = spark.createDataFrame(rows, "specimen string, modality string, path string, rig string, width int, height int, rgba binary, um_per_px double")
    got = {r.specimen: r for r in pairs.registered(df, profile, size=SIZE, margin=MARGIN).collect()}
    assert got["s"].overlap > 0.9 and len(got["s"].size) == 2
    assert "venation: light or background differ from the profile" in got["t"].reasons


def test_query_of_pairs(spark, sf_dir):
    rows = images.registered_pairs(spark, sf_dir).collect()
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id IS NOT NULL AND embedding IS NOT NULL").selectExpr("count(distinct floor(vec_id / 2))").first()[0]
    assert len(rows) == n
    paired = [r for r in rows if r.overlap is not None]
    assert len(paired) > 0.9 * n and all(r.overlap >= r.initial for r in paired) and np.mean([r.overlap > 0.9 for r in paired]) > 0.95


def test_kernels_give_what_their_plain_forms_do():
    r = np.random.default_rng(8)
    image, mask = r.integers(0, 256, (40, 60, 3)).astype(np.uint8), np.zeros((40, 60), bool)
    mask[5:33, 8:50] = r.random((28, 42)) < 0.9
    assert all((a == b).all() for a, b in zip(raster.pixels(mask), np.nonzero(mask), strict=True))
    assert not raster.border_band(40, 60).flags.writeable
    turn = np.array([[1.7, 0.3, 2.0], [-0.3, 1.7, 11.0], [0, 0, 1.0]])
    placed, back = canvas.place(image, mask, turn, width=96, height=64), np.linalg.inv(turn)
    for y, x in zip(*np.nonzero(placed.mask), strict=True):
        sx, sy = (back[k, 0] * x + back[k, 1] * y + back[k, 2] for k in (0, 1))
        x0, y0 = int(sx), int(sy)
        x1, y1, fx, fy = min(x0 + 1, 59), min(y0 + 1, 39), sx - x0, sy - y0
        own = (image[y0, x0] * (1 - fx) + image[y0, x1] * fx) * (1 - fy) + (image[y1, x0] * (1 - fx) + image[y1, x1] * fx) * fy
        assert (placed.rgb[y, x] == np.rint(own)).all()
    assert placed.mask.sum() > 1000 and not placed.rgb[~placed.mask].any()
    small = cells.downsample(placed)
    own = placed.rgb.astype(int) * placed.signal[..., None]
    n = placed.signal.reshape(16, 4, 24, 4).sum((1, 3))
    assert (small.rgb == own.reshape(16, 4, 24, 4, 3).sum((1, 3)) / np.maximum(n, 1)[..., None]).all() and (small.signal == n / 16).all()
