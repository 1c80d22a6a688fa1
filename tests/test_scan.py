"""Running maps over sessions against folds of one row at a time."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from vistrack.operators import events, scan
from vistrack.streaming import poses


def by_hand(rows, step, start):
    """{(obj_id, frame_id): state}, a row at a time."""
    out, last, state = {}, None, None
    for o, f, *z in sorted(rows):
        fresh = last is None or last[0] != o or f - last[1] > 1
        state = start(z) if fresh else step(state, z)
        out[o, f], last = state, (o, f)
    return out


@pytest.fixture(scope="module")
def rows():
    rng, out = np.random.default_rng(5), []
    for o in range(6):  # object 0 has one session over many chunks, the others gaps at and off the borders of chunks
        frames = range(-20, 300) if o == 0 else sorted(rng.choice(300, 30 * o, replace=False))
        out += [(o, int(f), float(rng.normal(5, 3)), float(rng.normal(-50, 9))) for f in frames]
    return out


@pytest.mark.parametrize("chunk", [1, 7, 64, 4096])
def test_smoothing_equals_a_fold(spark, rows, chunk):
    df = spark.createDataFrame(rows, "obj_id long, frame_id long, x double, y double").repartition(5)
    got = {(r.obj_id, r.frame_id): (r.x_smooth, r.y_smooth) for r in events.smoothed(df, ["x", "y"], 0.4, chunk).collect()}
    want = by_hand(rows, lambda s, z: [a + 0.4 * (b - a) for a, b in zip(s, z)], lambda z: z)
    assert set(got) == set(want) and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)


@pytest.mark.parametrize("corrected", [False, True])
def test_filter_equals_matrices(spark, rows, corrected):
    a, h = np.eye(12) + np.eye(12, k=6), np.eye(6, 12)
    q, r = np.diag([1e-7] * 3 + [1.0] * 9), np.diag([1.0] * 3 + [10.0] * 3)
    pose = lambda z: np.array([z[0], z[1], z[0] * z[1], z[1] - z[0], 3.0, z[0]])

    def correct(x, p, z):
        guess = x[:6].copy()
        gain = p @ h.T @ np.linalg.inv(h @ p @ h.T + r)
        return x + gain @ (z - h @ x), (np.eye(12) - gain @ h) @ p, guess

    start = lambda z: correct(np.r_[pose(z), np.zeros(6)], np.eye(12), pose(z))
    want = by_hand(rows, lambda s, z: correct(a @ s[0], a @ s[1] @ a.T + q, pose(z)), start)
    df = spark.createDataFrame([(o, f, pose(z).tolist()) for o, f, *z in rows], "obj_id long, frame_id long, pose array<double>")
    got = {(x.obj_id, x.frame_id): x.x for x in events.kalman(df, corrected, 64).collect()}
    assert set(got) == set(want)
    assert all(np.allclose(got[k], want[k][0][:6] if corrected else want[k][2], rtol=1e-9, atol=1e-7) for k in want)


def test_one_long_session_lies_in_many_tasks(spark):
    n = 200_000
    df = spark.range(n).selectExpr("1L as obj_id", "id as frame_id", "cast(id % 7 as double) as x", "'kept' as note")
    out = events.smoothed(df, ["x"], chunk=2000)
    s, want = 0.0, {}
    for f in range(n):
        s = f % 7 + 0.0 if f == 0 else s + 0.4 * (f % 7 - s)
        want[f] = s
    got = out.select("frame_id", "x_smooth", "note").toPandas()
    assert len(got) == n and set(got.note) == {"kept"}
    assert np.allclose(got.x_smooth, got.frame_id.map(want))
    spread = scan.along_sessions(df, ["x"], 2000).groupBy("__chunk").count().collect()
    assert len(spread) == 100 and max(r["count"] for r in spread) == 2000


def test_nulls_repeats_and_no_rows(spark):
    schema = "obj_id long, frame_id long, x double"
    df = spark.createDataFrame([(1, 1, 10.0), (1, 2, None), (1, 3, 20.0), (1, 3, 30.0), (None, 3, 1.0), (1, None, 1.0)], schema)
    got = sorted(((r.obj_id, r.frame_id, r.x, r.x_smooth) for r in events.smoothed(df, ["x"]).collect()), key=str)
    want = [(1, 1, 10.0, 10.0), (1, 2, None, None), (1, 3, 20.0, 20.0), (1, 3, 30.0, 24.0), (None, 3, 1.0, None), (1, None, 1.0, None)]
    assert got == sorted(want, key=str)
    assert events.smoothed(spark.createDataFrame([], schema), ["x"]).count() == 0


@pytest.mark.parametrize("form", ["smoothed", "kalman"])
def test_streams_equal_batch(spark, rows, tmp_path, form):
    """Rows come late and again; sessions go on over micro-batches, and end at gaps."""
    kind = "obj_id long, frame_id long, ts timestamp, x double, y double, pose array<double>"
    make = lambda rs: spark.createDataFrame([(o, f, datetime(2024, 1, 1) + timedelta(seconds=f), x, y, [x, y, x * y, y - x, 3.0, x]) for o, f, x, y in rs], kind)
    for a, b in ((-20, 40), (70, 120), (30, 90), (110, 200), (200, 301)):
        make([r for r in rows if a <= r[1] < b]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for day in (1, 2):
        make([(o, day * 86_400, 0.0, 0.0) for o in range(6)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(make(rows[:1]).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = poses.smoothed(stream, ["x", "y"], late="60 seconds") if form == "smoothed" else poses.kalman(stream, late="60 seconds")
    q = out.writeStream.format("memory").queryName(form).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(200)
    batch = events.smoothed(make(rows), ["x", "y"], chunk=64) if form == "smoothed" else events.kalman(make(rows), chunk=64)
    of = lambda df: {(r["obj_id"], r["frame_id"]): [r["x_smooth"], r["y_smooth"]] if form == "smoothed" else r["x"] for r in df.collect()}
    got, want = of(spark.table(form).where("frame_id < 1000")), of(batch)
    assert spark.table(form).where("frame_id < 1000").count() == len(want) and set(got) == set(want)
    assert all(np.allclose(got[k], want[k], rtol=1e-9, atol=1e-7) for k in want)
