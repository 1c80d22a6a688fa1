"""Jobs whose pairs outgrow their input: the same rows by fewer or better dealt pairs."""

import numpy as np
from vistrack.functions import geometry
from vistrack.operators import cluster, match, track, views


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def crossed(spark, n=60, m=50):
    """Points and objects of which two thirds have word 1; word 0 is none."""
    points = spark.createDataFrame([(i % 7, i, i % 3 and 1 or i % 9) for i in range(n)], "frame_id long, kpt_id long, word long")
    objects = spark.createDataFrame([(j // 3, j, j % 3 and 1 or j % 9) for j in range(m)], "obj_id long, obj_kpt_id long, word long")
    return points, objects


def test_pairs_of_a_common_word_are_dealt_to_tasks(spark):
    from pyspark.sql import functions as F

    points, objects = crossed(spark)
    got = match.by_word(points, objects, rows=100)
    want = [(p.frame_id, o.obj_id, p.kpt_id, o.obj_kpt_id) for p in points.collect() for o in objects.collect() if p.word == o.word != 0]
    assert rows(got, "frame_id", "obj_id", "kpt_id", "obj_kpt_id") == sorted(want)
    held = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("t")).count().collect()]
    assert len(held) > 8 and max(held) < len(want) / 4


def test_weights_by_cluster_are_rounded_before_they_fan_out(spark):
    points, objects = crossed(spark)
    ranked = spark.createDataFrame([(0, 1, 0.5), (1, 1, 1 / 3), (1, 4, 1.0), (2, 5, 0.25)], "track_id long, cid long, score double")
    weights = spark.createDataFrame([(1, 0.1), (4, 2 / 3), (5, 0.0)], "word long, idf double")
    points = points.withColumn("track_id", points.kpt_id % 4)
    got = match.by_cid(points, ranked, objects.withColumnRenamed("word", "cid"), weights, digits=6, rows=100)
    idf = {r.word: r.idf for r in weights.collect()}
    want = [(p.frame_id, o.obj_id, p.kpt_id, o.obj_kpt_id, round(r.score * idf[r.cid], 6)) for p in points.collect() for r in ranked.collect() if p.track_id == r.track_id for o in objects.collect() if o.word == r.cid]
    assert rows(got, "frame_id", "obj_id", "kpt_id", "obj_kpt_id", "weight") == sorted(want)


def test_coverage_by_the_words_that_frames_show(spark):
    points, objects = crossed(spark)
    o = objects.withColumn("cid", objects.word)
    weights = spark.createDataFrame([(w, w * 0.25) for w in range(9)], "word long, idf double")
    matched = points.where("word <> 0").join(o, "word").select("frame_id", "obj_id", "cid")
    want = rows(match.coverage(matched, o, weights), "frame_id", "obj_id", "coverage")
    seen = points.where("word <> 0").withColumn("cid", points.word)
    got = rows(match.seen_coverage(seen, o, weights, rows=20), "frame_id", "obj_id", "coverage")
    assert len(got) > 50 and [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])


def test_only_the_first_object_keypoint_of_a_word_is_asked(spark):
    points, objects = crossed(spark)
    o = objects.withColumn("place", objects.obj_id * 5 % 7)
    first = match.first_of_word(o)
    assert first.count() == objects.select("word").distinct().count()
    place = {r.obj_id: r.place for r in o.collect()}
    c = match.by_word(points, first)
    got = rows(match.assign_keypoints(c.withColumn("place", c.obj_id * 5 % 7)), "kpt_id", "obj_id", "obj_kpt_id")
    met = [(p.kpt_id, (place[q.obj_id], q.obj_id, q.obj_kpt_id)) for p in points.collect() for q in objects.collect() if p.word == q.word != 0]
    assert got == sorted((k, *min(x for i, x in met if i == k)[1:]) for k in {k for k, _ in met})


def brute_closest(q, p, r, but_itself):
    out = []
    for f, i, x, y in q:
        near = [((u - x) ** 2 + (v - y) ** 2, k) for g, k, u, v in p if g == f and not (but_itself and k == i)]
        out += [(f, i, k, d) for d, k in [min(near)] if d < r * r] if near else []
    return sorted(out)


def test_closest_points_among_many_at_one_place(spark):
    """Two hundred points on four places, and others apart; a join on cells would meet 200 * 200 pairs."""
    rng = np.random.default_rng(5)
    p = [(0, i, float(i % 4), 7.0) for i in range(200)] + [(k % 3, 200 + k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(-60, 400, (150, 2)))]
    points = spark.createDataFrame(p, "frame_id long, kpt_id long, u double, v double")
    queries = points.selectExpr("frame_id", "kpt_id as q_id", "u as qu", "v as qv")
    for but_itself in (True, False):
        got = rows(track.closest_point(queries, points, 20.0, but_itself), "frame_id", "q_id", "kpt_id", "d2")
        want = brute_closest(p, p, 20.0, but_itself)
        assert len(got) == len(want) > 200 and [g[:3] for g in got] == [w[:3] for w in want]
    got, few = track.closest_point(queries.where("q_id % 3 = 0"), points.where("kpt_id % 3 <> 0"), 30.0), [x for x in p if x[1] % 3]
    assert [g[:3] for g in rows(got, "frame_id", "q_id", "kpt_id")] == [w[:3] for w in brute_closest([x for x in p if x[1] % 3 == 0], few, 30.0, False)]
    assert track.closest_point(queries, points, 20.0, True).inputFiles(), "the places are written once"


def test_claims_of_crowded_frames(spark):
    """Many points, copies of patches and common words; tiles, and chunks of them, against all pairs one by one."""
    rng = np.random.default_rng(8)
    n, kinds = 360, np.random.default_rng(1).normal(100, 30, (9, 16))
    at, word = rng.uniform(-5, 600, (n, 2)), rng.integers(0, 12, n) % 4
    patch = kinds[rng.integers(0, 9, n)] + rng.normal(0, 8, (n, 16)) * (rng.random(n) < 0.5)[:, None]
    p = [(i % 3, i, float(at[i, 0]), float(at[i, 1] / 4), int(word[i]), patch[i].tolist() if i % 29 else None) for i in range(n)]
    df = spark.createDataFrame(p, "frame_id long, kpt_id long, u double, v double, word long, patch array<double>")
    q = df.selectExpr("frame_id + 1 as frame_id", "kpt_id as q_id", "u as qu", "v as qv", "word as qword", "patch as b")
    met = {}
    for r in track.range_join(q, df, 20.0).collect():
        ncc = 0.95 if r.word == r.qword != 0 else 0.0
        if not ncc and r.patch and r.b:
            x, y = (np.array(v) - np.floor(np.mean(v)) for v in (r.patch, r.b))
            ncc = float(x @ y) / np.sqrt(((np.array(r.patch) - np.mean(r.patch)) ** 2).sum() * ((np.array(r.b) - np.mean(r.b)) ** 2).sum())
        if ncc > 0.88:
            met.setdefault(r.q_id, []).append((0 if ncc > 0.9 else 1, r.kpt_id if ncc > 0.9 else -round(ncc, 9), r.kpt_id))
    want = sorted((i, min(m)[2]) for i, m in met.items())
    assert len(want) > 100
    for chunk in (8192, 20):
        assert rows(track.claimed(df, 20.0, chunk=chunk), "q_id", "kpt_id") == want


def test_quads_in_closed_form():
    rng = np.random.default_rng(2)
    side = rng.uniform(100, 400, (50, 2))
    corners = np.array([(0, 0), (1, 0), (1, 1), (0, 1)], float)[None] * side[:, None]
    quad = (corners + rng.uniform(-20, 20, (50, 4, 2))) * rng.uniform(0.5, 2, (50, 1, 1)) + 9
    assert np.allclose(geometry.homography_from_quads(quad, side), geometry.homography_from_points(quad, corners), rtol=1e-9, atol=1e-9)
    other = rng.uniform(0, 300, (50, 4, 2))
    assert np.allclose(geometry.homography_from_fours(quad, other), geometry.homography_from_points(quad, other), rtol=1e-5, atol=1e-6)
    quad[3] = 1.0
    assert np.isnan(geometry.homography_from_quads(quad, side)[3]).all()


def test_groups_of_many_images_at_once(spark):
    """Images of up to forty points, and one of three hundred, as one by one; small groups left out in the task."""
    rng = np.random.default_rng(6)
    p = [(i, int(s), float(x), float(y), int(s) % 3) for i in range(30) for s, (x, y) in enumerate(rng.uniform(0, 25, (300 if i == 7 else i + 10, 2)))]
    df = spark.createDataFrame(p, "image_id long, seq long, x double, y double, word long").repartition(5, "x")
    want = {}
    for i in range(30):
        own = [r for r in p if r[0] == i]
        of, cx, cy = views.leaders(np.array([r[2] for r in own]), np.array([r[3] for r in own]), 3.0)
        for r, g in zip(own, of):
            key = (i, int(g) + 1, float(cx[g]), float(cy[g]), r[4])
            want[key] = want.get(key, 0) + 1
    cols = ("image_id", "group", "x", "y", "word", "cnt")
    all_ = sorted((*k, c) for k, c in want.items())
    assert rows(views.group_points(df), *cols) == all_
    assert rows(views.group_points(df, least=4), *cols) == rows(views.prune_points(spark.createDataFrame(all_, ", ".join(f"{c} {'double' if c in 'xy' else 'long'}" for c in cols)), 4, 1.0), *cols)


def test_track_clusters_by_a_collection_that_tasks_hold(spark):
    """The same as by the index, with small batches, tracks of many frames and words that no cluster has."""
    rng = np.random.default_rng(3)
    p = [(int(v), int(t), int(f), int(w)) for v, t, f, w in zip(rng.integers(0, 2, 900), rng.integers(0, 9, 900), rng.integers(0, 60, 900), rng.integers(0, 14, 900))]
    points = spark.createDataFrame(p, "video_id long, track_id long, frame_id long, word long")
    db = spark.createDataFrame([(int(c), int(w), int(n)) for c, w, n in zip(rng.integers(1, 8, 40), rng.integers(1, 11, 40), rng.integers(1, 9, 40))], "cid long, word long, cnt long")
    cols = ("video_id", "track_id", "frame_id", "rank", "cid")
    want = track.track_clusters(points, db, 0.9, cells=0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 13)
    try:
        got = track.track_clusters(points, db, 0.9)
        assert "MapInPandas" in got._jdf.queryExecution().toString()
        a, b = rows(got, *cols, "cscore"), rows(want, *cols, "cscore")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(a) > 500 and [x[:5] for x in a] == [x[:5] for x in b] and np.allclose([x[5] for x in a], [x[5] for x in b])


def test_supports_of_many_pairs_hold_little_memory():
    import tracemalloc

    rng = np.random.default_rng(4)
    a, h = rng.uniform(0, 300, (60_000, 2)), np.array([1.0, 0, 5, 0, 1, -3, 0, 0, 1]) + rng.normal(0, 1e-6, (64, 9))
    b = a + [5, -3] + rng.normal(0, 2, a.shape)
    tracemalloc.start()
    support, near = match.supports(h, a, b, 3.0)
    f = match.epipolar_distances(rng.normal(size=(64, 3, 3)), a, b)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    p = np.c_[a, np.ones(len(a))] @ h[9].reshape(3, 3).T
    d2 = ((p[:, :2] / p[:, 2:] - b) ** 2).sum(1)
    assert np.array_equal(near[9], d2 < 9) and np.isclose(support[9], (1 - 0.1 * d2[d2 < 9] / 9).sum()) and f.shape == (64, 60_000)
    assert most < 80e6


def test_dense_histograms_are_multiplied_by_blocks(spark):
    rng = np.random.default_rng(7)
    h = spark.createDataFrame([(c, w, int(rng.integers(1, 9))) for c in range(60) for w in range(12) if rng.random() < 0.7], "cid long, word long, cnt long")
    got, want = (rows(cluster.similarity_join(h, 0.07, block=b), "a", "b", "score") for b in (16, 1024))
    assert 100 < len(want) < 1770 and [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])
