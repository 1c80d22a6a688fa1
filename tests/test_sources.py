"""Data sources: packets cut into ranges, frames in their order."""

import numpy as np
import pytest
from vistrack.sources import tables


def test_a_file_is_read_by_many_tasks(spark, tmp_path):
    n, dim = 5000, 6
    record = np.zeros(n, np.dtype([("ptr", "<i8"), ("x", "<f4", (dim,))]))
    record["ptr"], record["x"] = np.arange(n) * 32 - 1, np.random.default_rng(1).normal(size=(n, dim))
    (tmp_path / "one.bin").write_bytes(record.tobytes())
    (tmp_path / "none.bin").write_bytes(b"")
    (tmp_path / "_hidden.bin").write_bytes(b"123")
    got = tables.read_packets(spark, str(tmp_path), dim, split_bytes=10_000)
    assert got.rdd.getNumPartitions() == -(-n // (10_000 // record.itemsize)) > 10
    rows = sorted(got.collect(), key=lambda r: r["packet_no"])
    assert [r["packet_no"] for r in rows] == list(range(n)) and {r["source"][-8:] for r in rows} == {"/one.bin"}
    assert [r["ptr"] for r in rows] == record["ptr"].tolist() and np.array_equal(np.array([r["descriptor"] for r in rows], "f4"), record["x"])
    assert tables.read_packets(spark, f"file://{tmp_path}/no*.bin", dim).count() == 0
    (tmp_path / "part.bin").write_bytes(b"12345")
    with pytest.raises(Exception, match="whole number of packets"):
        tables.read_packets(spark, str(tmp_path), dim).count()
    with pytest.raises(Exception, match="missing"):
        tables.read_packets(spark, str(tmp_path / "missing"), dim).count()


def test_packets_come_back_as_written(spark, tmp_path):
    rows = [(f"s{i % 3}", i, i * 10 - 1, [float(i), 0.5]) for i in range(100)]
    d = spark.createDataFrame(rows, "source string, packet_no long, ptr long, descriptor array<float>").repartition(7)
    tables.write_packets(d, str(tmp_path / "p"), 2)
    tables.write_packets(d.where("packet_no < 9"), str(tmp_path / "p"), 2)
    got = tables.read_packets(spark, str(tmp_path / "p"), 2).collect()
    files = {}
    for r in sorted(got, key=lambda r: (r["source"], r["packet_no"])):
        files.setdefault(r["source"], []).append((r["ptr"], r["descriptor"]))
    want = [[(p, v) for s, k, p, v in rows if s == f"s{j}" and k < end] for j in range(3) for end in (9, 100)]
    assert sorted(files.values(), key=lambda f: (f[0], len(f))) == sorted(want, key=lambda f: (f[0], len(f)))
    assert not [p for p in (tmp_path / "p").iterdir() if p.name.startswith("_")]
    with pytest.raises(Exception, match="has not 3 numbers"):
        tables.write_packets(d, str(tmp_path / "q"), 3)


def test_frames_stream_in_order_and_go_on_after_a_restart(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put = lambda k: (folder / f"v{k:04d}.bmp").write_bytes(bytes([k]) * k)
    batches = []

    def run():
        frames = tables.read_frames(spark, str(folder), "v", first=2, last=9, stream=True)
        q = frames.writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
        q = q.foreachBatch(lambda df, _: batches.append(sorted((r["frame_id"], len(r["data"])) for r in df.collect()))).start()
        q.awaitTermination(120)
        return [x for b in batches for x in b]

    for k in (3, 4, 6, 7, 11):
        put(k)
    assert run() == [(3, 3), (4, 4)]  # 5 is waited for
    assert run() == [(3, 3), (4, 4)]
    put(5)
    (folder / "other.bmp").write_bytes(b"x")
    assert run() == [(k, k) for k in (3, 4, 5, 6, 7)]
    put(8), put(9), put(10)
    assert run() == [(k, k) for k in range(3, 10)]


def test_annotations_are_appended(spark, tmp_path):
    one = spark.createDataFrame([(1, 2.0, 3.0, "text", "a", 9)], "obj long, x double, y double, type string, descr string, other int")
    tables.add_annotation(one, str(tmp_path / "a"))
    tables.add_annotation(one.selectExpr("obj + 1 as obj", "x", "y", "type", "descr"), str(tmp_path / "a"))
    assert sorted(map(tuple, tables.annotations(spark, str(tmp_path / "a")).collect())) == [(1, 2.0, 3.0, "text", "a"), (2, 2.0, 3.0, "text", "a")]


def test_only_whole_images_are_added(spark, tmp_path):
    kind = "img_id long, width int, height int, step int, channels int, data binary"
    tables.add_images(spark.createDataFrame([(1, 2, 2, 2, 1, b"abcd"), (2, 1, 1, 1, 1, b"x")], kind), str(tmp_path / "i"))
    with pytest.raises(ValueError, match=r"\[3, 4\]"):
        tables.add_images(spark.createDataFrame([(3, 2, 2, 2, 1, b"abc"), (4, 2, 2, 2, 1, None)], kind).coalesce(1), str(tmp_path / "i"))
    images = spark.read.parquet(str(tmp_path / "i"))
    assert [bytes(r["data"]) for r in tables.get_images(images, spark.createDataFrame([(1,), (1,), (9,)], "img_id long")).collect()] == [b"abcd"]
