"""Streams from a file source against their batch forms."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from vistrack.operators import events
from vistrack.streaming import events as live

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def stream(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("s"))
    rows = [(0, o, o, START + timedelta(seconds=s), s % 5) for o in range(4) for s in (0, 5, 9, 40 + o, 44 + o, 90)] + [(0, 99, 99, START + timedelta(hours=2), 1)]
    rows += [(0, 99, 99, START + timedelta(hours=h), 1) for h in (4, 6)]
    df = spark.createDataFrame(rows, "video_id long, obj_id long, track_id long, ts timestamp, word long").withColumn("frame_id", F.unix_timestamp("ts"))
    for k, (lo, hi) in enumerate(((0, 60), (60, 10_000), (10_000, 20_000), (20_000, 30_000))):
        part = df.where((F.unix_timestamp("ts") - F.unix_timestamp(F.lit(START))).between(lo, hi - 1))
        part.coalesce(1).write.mode("append").parquet(path)
    return path, df


def run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def source(spark, stream):
    return spark.readStream.schema(stream[1].schema).option("maxFilesPerTrigger", 1).parquet(stream[0])


def test_sessions(spark, stream):
    got = {(r["obj_id"], r["start"], r["end"], r["n"]) for r in run(spark, live.visibility_sessions(source(spark, stream), "10 seconds", "1 second"), "sessions") if r["obj_id"] < 99}
    d = stream[1].where("obj_id < 99").withColumn("t", F.unix_timestamp("ts").cast("double"))
    want = {(r["obj_id"], int(r["start"]), int(r["end"]), r["n"]) for r in events.visibility_sessions(d, 10.0).collect()}
    assert {(o, int(a.timestamp()), int(b.timestamp()), n) for o, a, b, n in got} == want


def test_appearances(spark, stream):
    got = sorted((r["obj_id"], r["t_ms"] // 1000, r["event"]) for r in run(spark, live.appearance_events(source(spark, stream), 10_000, "1 second"), "appearances") if r["obj_id"] < 99)
    d = stream[1].where("obj_id < 99").withColumn("t", F.unix_timestamp("ts").cast("double"))
    want = sorted((r["obj_id"], int(r["t"]), r["event"]) for r in events.appearance_events(d, 10.0).collect())
    assert got == want


def test_lost_tracks(spark, stream):
    got = {r["track_id"]: (r["n"], len(r["words"])) for r in run(spark, live.lost_tracks(source(spark, stream), 60_000, late="1 second"), "lost") if r["track_id"] < 99}
    assert got == {o: (6, 6) for o in range(4)}


def test_counts_and_repeats(spark, stream):
    got = run(spark, live.windowed_counts(live.detections(source(spark, stream), "1 second"), "1 minute", None), "counts")
    assert sum(r["n"] for r in got if r["start"] < START + timedelta(hours=1)) == 24


def test_micro_batches(spark, stream, tmp_path):
    seen = []
    live.matched_pipeline(source(spark, stream), lambda df, k: seen.append(df.count()), str(tmp_path)).awaitTermination(120)
    assert sum(seen) == stream[1].count() and len(seen) > 1
