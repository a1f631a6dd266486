"""Pixel sums and meters: batches against direct computations, streams against batches, across a restart."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from specton.operators.references import ContractError
from specton.streaming import meters, pixels

FRAMES = "session string, frame int, width int, height int, data binary"
READINGS = "session string, at long, tie long, setting string, value double"


def burst(session, n, w, h, seed, sd=2.0):
    r = np.random.default_rng(seed)
    base = r.uniform(40, 220, (h, w, 4))
    return [(session, k, w, h, bytearray(np.clip(np.rint(base + r.normal(0, sd, base.shape)), 0, 255).astype(np.uint8).tobytes())) for k in range(n)]


def direct(rows):
    x = np.stack([np.frombuffer(bytes(r[4]), np.uint8) for r in rows]).reshape(len(rows), -1, 4)
    mean = np.clip(np.floor(x.reshape(len(rows), -1).mean(0) + 0.5), 0, 255).astype(np.uint8).tobytes()
    step = max(1, rows[0][2] * rows[0][3] // 20_000)
    light = x[:, ::step, 0] * 0.2126 + x[:, ::step, 1] * 0.7152 + x[:, ::step, 2] * 0.0722
    sds = np.sort(light.std(0, ddof=1)) if len(rows) > 1 else None
    return mean, None if sds is None else sds[len(sds) // 2]


@pytest.fixture(scope="module")
def bursts():
    return {"a": burst("a", 4, 90, 70, 1), "b": burst("b", 1, 33, 9, 2), "c": burst("c", 7, 300, 201, 3, 5.0)}


@pytest.mark.parametrize(("tile", "held"), [(1 << 16, 64), (1000, 2)])
def test_sums_equal_direct_ones(spark, monkeypatch, bursts, tile, held):
    monkeypatch.setattr(pixels, "TILE", tile)
    monkeypatch.setattr(pixels, "HELD", held)
    rows = [r for x in bursts.values() for r in x] + [("a", 9, 90, 70, None)]
    tiles = pixels.sums(pixels.check(spark.createDataFrame(rows, FRAMES).repartition(5)))
    images = {r.session: r for r in pixels.images(tiles).collect()}
    noise = {r.session: r for r in pixels.noise(tiles).collect()}
    for session, own in bursts.items():
        mean, sd = direct(own)
        assert bytes(images[session].data) == mean and images[session].frames == noise[session].frames == len(own)
        assert noise[session].noise is None if sd is None else abs(noise[session].noise - sd) < 1e-6
    # Injected deviations of 2 a channel make about 1.5 in luminance; few frames bias the median down.
    assert 1 < noise["a"].noise < 2


def test_frames_have_to_fit(spark, bursts):
    with pytest.raises(ContractError, match="sessions_of_two_sizes"):
        pixels.check(spark.createDataFrame(bursts["a"] + burst("a", 1, 9, 9, 4), FRAMES))
    with pytest.raises(ContractError, match="data_length"):
        pixels.check(spark.createDataFrame([("x", 0, 5, 5, bytearray(3))], FRAMES))
    assert pixels.noise(pixels.sums(spark.createDataFrame([], FRAMES))).count() == 0


def streamed(spark, rows, schema, folder, of, files, start=0):
    """What the stream of so many files appends, each a batch, going on from its checkpoint."""
    (folder / "in").mkdir(parents=True, exist_ok=True)
    step = -(-len(rows) // files)
    for k in range(start, files):
        part = rows[k * step : (k + 1) * step]
        if part:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
        of(stream).writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start().awaitTermination(240)
    return spark.read.parquet(str(folder / "out"))


def test_streamed_sums_equal_the_batch(spark, bursts, tmp_path):
    rows = [r for k in range(7) for x in bursts.values() for r in x[k : k + 1]]
    out = pixels.newest(streamed(spark, rows, FRAMES, tmp_path, pixels.stream_sums, 3))
    got = {r.session: r for r in pixels.noise(out).collect()}
    for session, own in bursts.items():
        sd = direct(own)[1]
        assert got[session].frames == len(own) and (got[session].noise is None if sd is None else abs(got[session].noise - sd) < 1e-9)
    assert {r.session: bytes(r.data) for r in pixels.images(out).collect()} == {s: direct(x)[0] for s, x in bursts.items()}


def readings(n=90):
    r = np.random.default_rng(11)
    rows, setting = [], {s: "x" for s in "pqr"}
    for k in range(n):
        s = "pqr"[r.integers(0, 3)]
        if r.random() < 0.15:
            setting[s] = [None, "x", "y"][r.integers(0, 3)]
        rows.append((s, k // 2, k, setting[s], None if r.random() < 0.1 else float(r.integers(0, 50)) if r.random() < 0.9 else 0.0))
    return rows


def test_meters_reset_with_the_setting(spark):
    got = {r.tie: (r.run, r.best, r.share) for r in meters.metered(spark.createDataFrame(readings(), READINGS)).collect()}
    state = {}
    for s, _, tie, setting, value in readings():
        known = s in state
        best, old, run = state.get(s, (None, None, 0))
        if known and setting != old:
            best, run = None, run + 1
        if value is not None:
            best = value if best is None else max(best, value)
        state[s] = (best, setting, run)
        assert got[tie] == (run, best, None if value is None or not best else value / best)


def test_streamed_meters_equal_the_batch_across_restarts(spark, tmp_path):
    rows = readings()
    out = streamed(spark, rows, READINGS, tmp_path, meters.stream_metered, 4)
    flat = lambda d: sorted((tuple(r[c] for c in ("session", "at", "tie", "setting", "value", "best", "share", "run")) for r in d.collect()), key=str)
    assert flat(out) == flat(meters.metered(spark.createDataFrame(rows, READINGS)))
    assert out.agg(F.count("*")).first()[0] == len(rows)
