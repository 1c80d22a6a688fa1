"""Planted objects over many frames, in batch and as a stream."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from vistrack.operators import follow
from vistrack.streaming import follow as live

START, FRAMES, POINTS = datetime(2024, 1, 1), 24, 40
POINT = "video_id long, frame_id long, ts timestamp, kpt_id long, track_id long, u double, v double, word long, ranked array<struct<cid:long,score:double>>"


@pytest.fixture(scope="module")
def planted(spark):
    """Two videos. Object 1 moves over all frames, its words are seen on the first three only; object 2, known by four
    words and by clusters, comes on frame 10; object 3 is a solid one. Of object 1 nothing is there on frames 15 and 16 of video 1."""
    rng = np.random.default_rng(2)
    at = {o: rng.uniform(0, 300, (POINTS, 2)) for o in (1, 2, 3, 4)}
    depth = rng.uniform(1, 2, POINTS)
    objects = [(o, 100 * o + i, 0 if o == 2 and i > 3 else 100 * o + i, *map(float, at[o][i]), 100 * o + i, 2 if o == 3 else 0) for o in at for i in range(POINTS)]
    rows = []
    for video in (0, 1):
        for t in range(FRAMES):
            def show(o, uv, word, ranked=()):
                for i in range(POINTS):
                    kpt = ((video * 100 + t) * 10 + o) * 100 + i
                    rows.append((video, t, START + timedelta(seconds=t), kpt, video * 10_000 + o * 100 + i, *map(float, uv[i]), word(i), list(ranked(i)) if ranked else []))

            if not (video == 1 and t in (15, 16)):
                show(1, at[1] * (1 + 0.01 * t) + (3 * t, t), lambda i: 100 + i if t < 3 else 0)
            if t >= 10:
                show(2, at[2] + (500, 2 * t), lambda i: 200 + i if i < 4 else 0, lambda i: [(200 + i, 0.9)])
            uv = at[3] + np.c_[4 * (t + 1) / depth, 2 * (t + 1) / depth] + (0, 600)
            show(3, uv, lambda i: 300 + i)
    o = spark.createDataFrame(objects, "obj_id long, obj_kpt_id long, word long, x double, y double, cid long, flags int")
    words = o.where("word <> 0").select("word", F.lit(1.0).alias("idf")).distinct()
    cids = o.select("cid", F.lit(1.0).alias("idf")).distinct()
    return spark.createDataFrame(rows, POINT), o, words, cids


def key(rows):
    return sorted((r.video_id, r.frame_id, r.obj_id, r.support, r.age, r.tracked, tuple(r.kpts), tuple(round(x, 6) for x in r.h)) for r in rows)


def test_planted_objects_are_followed(spark, planted):
    p, o, words, cids = planted
    got = {(r.video_id, r.frame_id, r.obj_id): r for r in follow.follow_objects(follow.correspondences(p, o, words, cids)).collect()}
    for video in (0, 1):
        for t in range(FRAMES):
            there = {1} if not (video == 1 and t >= 15) else set()
            assert {x for v, f, x in got if (v, f) == (video, t)} == there | {3} | ({2} if t >= 10 else set()), (video, t)
    assert follow.follow_objects(follow.correspondences(p.where("frame_id = 10"), o, words)).where("obj_id = 2").isEmpty(), "four words do not make an object"
    late = got[0, FRAMES - 1, 1]
    assert (late.support, late.age, late.tracked) == (POINTS, FRAMES - 1, POINTS)
    h = np.array(late.h) / late.h[8]
    assert np.allclose(h.reshape(3, 3), [[1.23, 0, 69], [0, 1.23, 23], [0, 0, 1]], atol=1e-4)
    assert got[0, 0, 1].tracked == 0 and got[0, 1, 1].tracked == POINTS


def test_stream_equals_batch(spark, planted, tmp_path):
    p, o, words, cids = planted
    end = [(v, 10_000, START + timedelta(days=k), -1, None, 0.0, 0.0, 0, []) for k in (1, 2) for v in (0, 1)]
    cuts = [(5, 12), (0, 5), (5, 8), (12, 19), (19, FRAMES)]  # frames come late and again
    for a, b in cuts:
        p.where(F.col("frame_id").between(a, b - 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for row in (end[:2], end[2:]):
        spark.createDataFrame(row, POINT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows = follow.correspondences(stream, o, words, cids)
    q = live.follow_objects(rows, late="20 seconds").writeStream.format("memory").queryName("followed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(200)
    want = key(follow.follow_objects(follow.correspondences(p, o, words, cids)).collect())
    assert key(spark.table("followed").where("frame_id < 10000").collect()) == want


def test_no_rows_and_rows_without_keys(spark, planted):
    p, o, words, cids = planted
    none = follow.correspondences(p.limit(0), o, words, cids)
    assert follow.follow_objects(none).count() == 0
    lost = p.where("frame_id = 0").withColumn("frame_id", F.lit(None).cast("long"))
    assert follow.follow_objects(follow.correspondences(lost, o, words)).count() == 0
