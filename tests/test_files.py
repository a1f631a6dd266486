import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from specton.functions import canvas, cells, raster
from specton.operators import imaging, references
from specton.operators.references import ContractError
from specton.sources import files, sinks
from specton.streaming import frames


def test_csv_with_mark_blanks_and_line_ends(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿file, latitude ,notes\na, 1.5 ,"x\ny"\n'.encode())
    row = files.csv(spark, str(tmp_path / "a.csv")).first()
    assert row.asDict() == {"file": "a", "latitude": "1.5", "notes": "x\ny"}


def test_edges_and_graph_files(spark, tmp_path):
    (tmp_path / "e.csv").write_text("pre,post,n\na,b,3\nb,c,x\n")
    assert [tuple(r) for r in files.edges(spark, str(tmp_path / "e.csv"), "pre", "post", "n").collect()] == [("a", "b", 3.0)]
    with pytest.raises(ContractError):
        files.edges(spark, str(tmp_path / "e.csv"), "pre", "post", "weight")
    (tmp_path / "g.json").write_text(json.dumps({"format": "g", "nodes": ["a", "b"], "edges": [[0, 1], [1, 0, 2.5]]}))
    nodes, edges = files.graph_json(spark, str(tmp_path / "g.json"))
    assert sorted((r.src, r.dst, r.w) for r in edges.collect()) == [(0, 1, 1.0), (1, 0, 2.5)]
    doc = json.loads(sinks.graph_document(nodes, edges, "g").first().json)
    assert doc["nodes"] == ["a", "b"] and doc["edges"] == [[0, 1, 1], [1, 0, 2.5]]


def test_references_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("1", "a", "f1", "p1"), ("2", " ", "f1", "p1"), ("3", "b", "f0", "p1")], "id string, species string, featureVersion string, preprocessingVersion string")
    (tmp_path / "r.json").write_text(json.dumps({"references": [r.asDict() for r in rows.collect()]}))
    got = files.references_json(spark, str(tmp_path / "r.json"), "f1", "p1")
    assert [r.id for r in got.collect()] == ["1"]
    assert references.upsert(rows, got).count() == 3
    sinks.write_references(got, str(tmp_path / "out"), "v1")
    assert spark.read.json(str(tmp_path / "out")).first().reference.id == "1"
    got.write.parquet(str(tmp_path / "t"))
    moved = spark.read.parquet(sinks.save_rows(rows.limit(2), str(tmp_path / "t")))
    assert moved.count() == 2 and sinks.delete_rows(moved, rows.limit(1)).count() == 1
    sinks.write_report(got, str(tmp_path / "rep"), {"model": "ab"})
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sinks.write_report(got, str(tmp_path / "rep"), {"model": "ab"})


def test_typed_arrays():
    x = {"a": np.array([1.5, 2], "<f4"), "b": [np.array([1], "<i4")]}
    back = files.parse_typed(sinks.dump_typed(x))
    assert (back["a"] == x["a"]).all() and back["a"].dtype == np.float32 and back["b"][0].tolist() == [1]


def test_verified(spark):
    f = spark.createDataFrame([("a", bytearray(b"x"))], "name string, content binary")
    m = f.select("name", F.md5("content").alias("md5"), F.length("content").alias("size"))
    assert files.verified(f, m).count() == 1
    with pytest.raises(ContractError):
        files.verified(f, m.withColumn("size", F.lit(9)))


def test_mesh(spark):
    v = {"o": (0, 0, 0), "x": (1, 0, 0), "y": (0, 1, 0), "z": (0, 0, 1)}
    lines = [f"  vertex {' '.join(map(str, v[c]))}" for face in ("oyx", "oxz", "ozy", "xyz") for c in face]
    r = files.mesh_volume(spark.createDataFrame(list(enumerate(lines)), "n long, value string")).first()
    assert abs(r.volume - 1 / 6) < 1e-12 and (r.min_x, r.max_z) == (0, 1)


def silhouette(angle=0.0, dx=0.0, dy=0.0, scale=1.0, n=360):
    y, x = np.mgrid[0:n, 0:n].astype(float)
    c, s = np.cos(-angle), np.sin(-angle)
    u, v = ((x - n / 2 - dx) * c - (y - n / 2 - dy) * s) / scale, ((x - n / 2 - dx) * s + (y - n / 2 - dy) * c) / scale
    t = np.clip((u + 110) / 220, 0, 1)
    inside = (np.abs(u) < 110) & (np.abs(v - 8 * np.sin(np.pi * t)) < 50 * np.sin(np.pi * t) ** 0.65 * (0.3 + 0.7 * t))
    return np.where(inside[..., None], [90, 70, 50], [230, 228, 225]).astype(np.uint8), inside


def frame_mask(image):
    mask = raster.segment(image.astype(float))
    return canvas.place(image, mask, canvas.normalization(mask, raster.orientation(mask))).mask


def test_segmentation_and_invariance():
    image, truth = silhouette()
    assert raster.iou(raster.segment(image.astype(float)), truth) > 0.95
    base = frame_mask(image)
    for change in ({"angle": 0.6}, {"angle": 2.5}, {"dx": 20, "dy": -15}, {"scale": 0.8}):
        assert raster.iou(frame_mask(silhouette(**change)[0]), base) > 0.9


def test_kernels():
    m = np.zeros((9, 9), bool)
    m[1:4, 1:4] = True
    m[2, 2] = False
    m[6, 6] = True
    label, n = raster.components(m)
    assert n == 2 and label[1, 1] == 1 and label[6, 6] == 2 and raster.fill_holes(m)[2, 2]
    assert raster.components(np.ones((3, 3), bool))[1] == 1 and raster.components(np.zeros((3, 3), bool))[1] == 0
    assert np.allclose(raster.blur(np.full((6, 7), 3.0), 2), 3)
    assert raster.area_average(np.full((100, 50, 3), 7), 20)[0].shape[0] == 20
    frame = np.full((64, 64, 3), 200.0) * np.linspace(0.6, 1, 64)[None, :, None]
    even = raster.flat_field_correct(frame.astype(np.uint8), raster.illumination_field(frame))
    assert even[..., 0].std() < frame[..., 0].std() / 4
    assert raster.drift(frame, frame, 1.0) == "ok" and raster.drift(frame + 40, frame, 1.0) == "drift" and raster.drift(frame[:5], frame, 1) == "mismatch"
    assert np.allclose(cells.lab(np.array([[[255.0, 255, 255]]])), [100, 0, 0], atol=0.1)


def test_images_as_rows(spark):
    image, _ = silhouette()
    rgba = np.dstack([image, np.full(image.shape[:2], 255, np.uint8)]).tobytes()
    blank = np.full((50, 50, 4), 255, np.uint8).tobytes()
    df = spark.createDataFrame([("a", 360, 360, bytearray(rgba)), ("b", 50, 50, bytearray(blank))], "path string, width int, height int, rgba binary")
    got = {r.path: r for r in imaging.preprocess(df).collect()}
    assert got["a"].status == "GOOD" and [len(got["a"][c]) for c in ("shape", "venation", "colour")] == [66, 288, 112] and got["b"].reasons == ["empty"]
    boxes = spark.createDataFrame([("p", 1, 2, 10, 5)], "name string, x int, y int, w int, h int")
    assert len(imaging.crops(df, boxes).first().rgba) == 200


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, of in {"stats": lambda d: frames.statistics(d, "event_type", "value"), "maxima": lambda d: frames.running_maximum(d, "user_id", "value"), "newest": lambda d: frames.last_revisions(d, "user_id", "event_id")}.items():
        q = frames.to_memory(of(stream), name, str(tmp_path / name))
        q.awaitTermination(120)
        flat = lambda d: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in d.collect())
        assert flat(spark.table(name)) == flat(of(events))
    q = frames.to_memory(frames.by_event_time(stream, "ts", "event_type", "value", "1 day", "400 days"), "windows", str(tmp_path / "w"))
    q.awaitTermination(120)
    assert spark.table("windows").agg(F.sum("n")).first()[0] == events.where("value IS NOT NULL").count()
