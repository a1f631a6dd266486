"""Rig profiles: light, drift, segmentation against the empty rig, metric size, and images that don't fit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from specton.functions import raster
from specton.operators import rig
from specton.operators.references import ContractError
from specton.plans import images

SIDE = 240
FRAMES = "rig string, modality string, kind string, role string, frame int, width int, height int, data binary"
IMAGES = "path string, rig string, modality string, width int, height int, rgba binary, um_per_px double"


def frames(name, n, seed, modality="venation", kind="transmitted", role="background", side=SIDE, gain=1.0):
    return [(name, modality, kind, role, k, side, side, bytearray(images.rgba(None, seed + k, side, gain))) for k in range(n)]


@pytest.fixture(scope="module")
def profile(spark):
    rows = frames("r", 4, 1) + frames("r", 1, 50, "wip", "reflected") + frames("s", 2, 80, "wip", "reflected") + frames("s", 3, 90, "wip", "reflected", "card")
    return rig.profiles(spark.createDataFrame(rows, FRAMES)).cache()


def pixels(row):
    return np.unpackbits(np.frombuffer(row.mask, np.uint8))[: row.mask_height * row.mask_width].reshape(row.mask_height, row.mask_width).astype(bool)


def test_profiles(profile):
    got = {(r.rig, r.modality): r for r in profile.collect()}
    own = got["r", "venation"]
    assert own.frames == 4 and 1 < own.noise < 2 and own.light == "background" and own.version == rig.VERSION
    assert abs(own.red - own.blue) < 3 and abs(own.limit - max(6, 4 * own.noise)) < 1e-9
    assert got["r", "wip"].field is None and got["r", "wip"].noise is None and got["r", "wip"].limit == 6
    assert got["s", "wip"].light == "card" and got["s", "wip"].frames == 2


def test_flat_field_removes_vignetting_and_cast():
    mean = np.mean([np.frombuffer(images.rgba(None, k, SIDE), np.uint8).reshape(SIDE, SIDE, 4)[..., :3] for k in range(4)], 0)
    raw = np.frombuffer(images.rgba(None, 9, SIDE), np.uint8).reshape(SIDE, SIDE, 4)[..., :3]
    blocks = lambda x: x.reshape(SIDE // 20, 20, SIDE // 20, 20, 3).mean((1, 3))
    away = np.ones((SIDE // 20, SIDE // 20), bool)
    away[2:5, 4:8] = False  # the speck and its halo
    before, after = (blocks(x.astype(float))[away] for x in (raw, raster.flat_field_correct(raw, raster.illumination_field(mean))))
    assert np.ptp(before.mean(1)) > 60 and np.ptp(after.mean(1)) < 6
    assert np.abs(before[:, 0] - before[:, 2]).max() > 30 and np.abs(after[:, 0] - after[:, 2]).max() < 3
    with pytest.raises(ValueError):
        raster.illumination_field(np.full((50, 50, 3), 8.0))


def test_empty_rig_segments_a_vignetted_image(spark, profile):
    truth = images.wing(np.array([0.2, 0.1, -0.2, 0.3]), SIDE)
    rows = [("a", "r", "venation", SIDE, SIDE, bytearray(images.rgba(truth, 99, SIDE)), 10.0), ("b", None, None, SIDE, SIDE, bytearray(images.rgba(truth, 99, SIDE)), None), ("c", "r", "venation", SIDE, SIDE, bytearray(images.rgba(truth, 5, SIDE, 0.75)), 10.0), ("d", "r", "venation", 100, 100, bytearray(images.rgba(None, 5, 100)), 10.0), ("e", "nowhere", "venation", SIDE, SIDE, bytearray(images.rgba(truth, 99, SIDE)), 10.0)]
    got = {r.path: r for r in rig.preprocess(spark.createDataFrame(rows, IMAGES), profile).collect()}
    a, b, c = (raster.iou(pixels(got[k]), truth) for k in "abc")
    assert a > 0.95 and got["a"].method == "background difference" and got["a"].drift == "ok" and a >= b
    assert got["c"].drift == "drift" and got["c"].status == "REVIEW" and got["c"].method == "border colour" and "light or background differ from the profile" in got["c"].reasons
    assert "another size" in got["d"].reasons and got["d"].drift is None
    assert got["b"].method == got["e"].method == "border colour" and got["b"].size is None and got["b"].reliable is None
    area = truth.sum() * (10.0 / 1000) ** 2
    assert abs(got["a"].area_mm2 - area) / area < 0.05 and got["a"].reliable
    assert np.allclose(got["a"].size, [np.log(got["a"].length_mm), np.log(got["a"].area_mm2)])


def test_size_is_that_of_the_drawn_object(spark, profile):
    truth = images.wing(np.zeros(4), SIDE)
    row = rig.preprocess(spark.createDataFrame([("a", "r", "venation", SIDE, SIDE, bytearray(images.rgba(truth, 3, SIDE)), 10.0)], IMAGES), profile).first()
    assert abs(row.length_mm - 220 * SIDE / 360 / 100) < 0.05  # 220 pixels of an image of 360
    cut = np.roll(truth, -int(np.nonzero(truth.any(0))[0][0]) - 5, 1)
    row = rig.preprocess(spark.createDataFrame([("a", None, None, SIDE, SIDE, bytearray(np.dstack([np.where(cut[..., None], [90, 70, 50], [230, 228, 225]), np.full((SIDE, SIDE), 255)]).astype(np.uint8).tobytes()), 10.0)], IMAGES), profile).first()
    assert row.reliable is False and row.size is None


def test_ruler(spark):
    df = spark.createDataFrame([(10.0, 10.0, 310.0, 10.0, 3.0), (0.0, 0.0, 2.0, 0.0, 1.0), (0.0, 0.0, 200.0, 0.0, 0.0)], "ax double, ay double, bx double, by double, mm double")
    assert [r.um for r in df.select(rig.micrometres(*map(F.col, ("ax", "ay", "bx", "by", "mm"))).alias("um")).collect()] == [10.0, None, None]


def test_profiles_need_a_background_of_one_kind_and_size(spark):
    for name, rows in {
        "without_background": frames("r", 1, 1, "wip", "reflected", "card"), "kinds": frames("r", 1, 1) + frames("r", 1, 1, kind="reflected"), "unknown_kind_or_role": frames("r", 2, 1, role="x") + frames("r", 1, 1),
        "cards_of_another_size": frames("r", 1, 1, "wip", "reflected") + frames("r", 1, 1, "wip", "reflected", "card", 50), "sessions_of_two_sizes": frames("r", 1, 1) + frames("r", 1, 1, side=50),
    }.items():
        with pytest.raises(ContractError, match=name):
            rig.profiles(spark.createDataFrame(rows, FRAMES)).collect()


def test_definitions_of_segmentation():
    truth = images.wing(np.zeros(4), 300)
    image = np.where(truth[..., None], [90.0, 70, 50], [230.0, 228, 225])
    framed = image.copy()
    framed[0] = framed[-1] = framed[:, 0] = framed[:, -1] = 0  # a frame of one pixel
    assert raster.iou(raster.segment(image), truth) > 0.95 and raster.iou(raster.segment(framed) & truth, truth) > 0.9
    s = raster.segmented(np.full((60, 60, 3), 200.0))
    assert not s.plausible and not s.mask.any() and s.threshold == 9 and (s.background == 200).all()
    disc = np.hypot(*np.mgrid[-100:100, -100:100]) < 30
    assert not raster.segmented(np.where(disc[..., None], 50.0, np.full(3, 220.0))).plausible
    with pytest.raises(ValueError):
        raster.segment(image, image[:10])


def test_components_equal_a_flood_fill():
    r = np.random.default_rng(6)
    for share in (0.0, 0.3, 0.5, 0.6, 0.8, 1.0):
        mask = r.random((37, 29)) < share
        label, n = raster.components(mask)
        want, k = np.zeros(mask.shape, int), 0
        for y, x in zip(*np.nonzero(mask), strict=True):
            if not want[y, x]:
                k += 1
                todo = [(y, x)]
                while todo:
                    i, j = todo.pop()
                    if 0 <= i < 37 and 0 <= j < 29 and mask[i, j] and not want[i, j]:
                        want[i, j] = k
                        todo += [(i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)]
        assert n == k and (label == want).all()


def test_images_dont_meet_by_rig(spark):
    """Images stay where they are, and frames lie in parts by number with few rigs each."""
    from specton.plans import images as plans

    own = spark.range(2000).select(F.col("id"), F.pmod("id", F.lit(4)).cast("string").alias("rig"), F.array(F.lit(0.1)).alias("v"))
    parts = plans.spread_by_rig(own).withColumn("p", F.spark_partition_id())
    assert parts.groupBy("p").agg(F.count_distinct("rig").alias("n")).agg(F.max("n")).first()[0] <= 4 and parts.rdd.getNumPartitions() == 8
    assert parts.groupBy("rig").agg(F.count_distinct("p").alias("n")).agg(F.max("n")).first()[0] <= 2
    profile = spark.createDataFrame([], rig.PROFILE).repartition(2)
    images = own.select("rig", F.lit("m").alias("modality"), F.lit(1).alias("width"), F.lit(1).alias("height"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = rig.options(images, profile)._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_frames_are_passed_through_twice(spark):
    """Frames are long to make: one pass for all rules, one for the sums, however many steps read these."""
    made = spark.sparkContext.accumulator(0)

    def draw(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf.assign(data=[images.rgba(None, int(i), 32) for i in pdf["frame"]])

    rows = spark.range(6).selectExpr("'a' AS rig", "'venation' AS modality", "'transmitted' AS kind", "'background' AS role", "id AS frame", "32 AS width", "32 AS height", "CAST(NULL AS BINARY) AS data")
    assert rig.profiles(rows.mapInPandas(draw, rows.schema)).count() == 1
    assert made.value <= 12


def test_an_image_drawn_and_lit_by_kept_parts():
    """What all images of a rig share is made once, and gives the same bytes."""
    mask = images.wing(np.array([0.1, 0.2, -0.1, 0.3]), 40)
    own = images.light(40) * 1.0 * np.where(mask, 0.39, 1.0)[..., None] + np.random.default_rng(3).normal(0, 2.0, (40, 40, 3))
    assert images.rgba(mask, 3, 40) == np.dstack([np.clip(np.rint(own), 0, 255), np.full((40, 40), 255)]).astype(np.uint8).tobytes()
    assert images.light(40) is images.light(40) and not images.light(40).flags.writeable
    frame = np.frombuffer(images.rgba(None, 1, 40), np.uint8).reshape(40, 40, 4)[..., :3]
    field = raster.illumination_field(frame, 8)
    first = raster.flat_field_correct(frame, field)
    kept = raster._kept_gain.cache_info().hits
    assert (raster.flat_field_correct(frame, raster.Field(field.data.copy(), field.target)) == first).all() and raster._kept_gain.cache_info().hits == kept + 1
