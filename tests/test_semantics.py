"""The quirks of the semantics on hand-made tables, and properties of the iterative parts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from vistrack.functions import geometry, vectors
from vistrack.operators import cluster, events, evaluate, histo, match, retrieve, track, views, vocab
from vistrack.sources import tables


def hist(spark, h):
    return spark.createDataFrame([(c, w, n) for c, ws in h.items() for w, n in ws.items()], "cid long, word long, cnt long")


def scores(df):
    return {(r[0], r[1]): r["score"] for r in df.collect()}


def test_scaled_histograms(spark):
    h = hist(spark, {1: {1: 1, 2: 3}, 2: {1: 2, 2: 6}, 3: {1: 1, 2: 3}})
    q = h.withColumnRenamed("cid", "query_id")
    r1, r3 = scores(retrieve.similarity_scores(q, h)), scores(retrieve.double_normalised_product(q, h))
    assert r1[1, 2] == pytest.approx(r1[1, 3]) and (1, 1) not in r1
    assert r3[1, 2] == pytest.approx(r3[1, 3] / 2)


def test_idf_divides_whole_numbers(spark):
    h = hist(spark, {1: {1: 1, 2: 1}, 2: {1: 1, 2: 1}, 3: {2: 1}, 4: {9: 1}, 5: {9: 1}})
    assert {r["word"]: r["idf"] for r in histo.idf(h).collect()} == {1: pytest.approx(math.log(2)), 2: 0.0, 9: pytest.approx(math.log(2))}
    assert histo.idf(hist(spark, {1: {1: 1}})).first()["idf"] == 1.0


def test_zero_weights_give_no_row(spark):
    db = hist(spark, {1: {1: 2}, 2: {1: 1, 2: 1}, 3: {3: 4}, 4: {3: 1}})
    q = hist(spark, {7: {1: 1, 2: 2, 3: 1}}).withColumnRenamed("cid", "query_id")
    got = scores(retrieve.query_scores(q, hist(spark, {1: {1: 2}, 2: {1: 1}}), {"IDF", "NORM"}))
    assert got == {}
    assert set(scores(retrieve.query_scores(q, db, {"IDF", "NORM"}))) == {(7, 1), (7, 2), (7, 3), (7, 4)}


def test_min_ratio_is_strict(spark):
    s = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.98), (1, 3, 0.97), (2, 1, 0.0)], "query_id long, cid long, score double")
    assert [tuple(r)[:2] for r in retrieve.min_ratio(s, 0.98).collect()] == [(1, 1)]


@pytest.mark.parametrize("flags", [(), ("NORM",), ("IDF", "NORM"), ("MIN", "IDF", "NORM"), ("BIN", "IDF", "NORM")])
def test_incremental_scores_equal_those_from_scratch(spark, flags):
    rng = np.random.default_rng(3)
    make = lambda n, c: hist(spark, {i: {int(w): int(rng.integers(1, 5)) for w in rng.integers(1, 40, c)} for i in range(n)})
    db, old, new = make(20, 6), make(6, 8).withColumnRenamed("cid", "query_id"), make(6, 8).withColumnRenamed("cid", "query_id")
    flags = set(flags)
    stored = retrieve.query_scores(old, db, flags)
    got, want = scores(retrieve.update_scores(stored, old, new, db, flags)), scores(retrieve.query_scores(new, db, flags))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_claims_cancel_each_other(spark):
    c = spark.createDataFrame([(0, 1, 9), (0, 2, 8), (0, 3, 8), (0, 4, 7), (0, 5, 7), (0, 6, 7)], "frame_id long, q_id long, kpt_id long")
    assert sorted(tuple(r) for r in track.settle_claims(c).collect()) == [(0, 1, 9), (0, 6, 7)]


def test_range_join_takes_whole_cells(spark):
    q = spark.createDataFrame([(0, 1, 16.0, 0.0)], "frame_id long, q_id long, qu double, qv double")
    p = spark.createDataFrame([(0, 1, 15.9, 0.0), (0, 2, 31.0, 15.0), (0, 3, 32.0, 0.0)], "frame_id long, kpt_id long, u double, v double")
    assert sorted(r["kpt_id"] for r in track.range_join(q, p, 2.0).collect()) == [1, 2]
    assert [r["kpt_id"] for r in track.range_join(q, p, 2.0, exact=True).collect()] == [1]


def test_tracks_from_markers(spark):
    p = spark.createDataFrame([("f", i, ptr) for i, ptr in enumerate((-1, 0, 280, -1, 0))], "source string, packet_no long, ptr long")
    assert [r["track_id"] for r in histo.assign_track_ids(p).orderBy("packet_no").collect()] == [1, 1, 1, 2, 2]
    assert histo.assign_track_ids(p, drop_last=True).count() == 3


def naive_agglomerate(h, t):
    h = {c: dict(w) for c, w in h.items()}
    own = {c: {c} for c in h}
    sim = lambda a, b: sum(n * b.get(w, 0) for w, n in a.items()) / (sum(a.values()) * sum(b.values()))
    while True:
        best = max(((sim(h[a], h[b]), -a, -b) for a in h for b in h if a < b), default=(0, 0, 0))
        if best[0] <= t:
            return {frozenset(x) for x in own.values()}
        a, b = -best[1], -best[2]
        for w, n in h.pop(b).items():
            h[a][w] = h[a].get(w, 0) + n
        own[a] |= own.pop(b)


@pytest.mark.parametrize("seed,t,members", [(1, 0.1, 2000), (2, 0.2, 2000), (2, 0.2, 3)])
def test_agglomeration_equals_one_merge_at_a_time(spark, seed, t, members):
    rng = np.random.default_rng(seed)
    h = {i: {int(w): int(rng.integers(1, 50)) for w in rng.integers(1, 9, 3)} for i in range(16)}
    out, mapping = cluster.agglomerate(hist(spark, h), t, members=members)
    groups = {}
    for r in mapping.collect():
        groups.setdefault(r["cluster"], set()).add(r["cid"])
    assert {frozenset(g) for g in groups.values()} == naive_agglomerate(h, t)
    assert out.agg(F.sum("cnt")).first()[0] == sum(n for w in h.values() for n in w.values())


def test_chains_equal_one_merge_at_a_time():
    for seed in range(20):
        rng = np.random.default_rng(seed)
        h = {i: {int(w): int(rng.integers(1, 50)) for w in rng.integers(1, 30, 5)} for i in range(40)}
        cnt = np.array([[h[i].get(w, 0) for w in range(30)] for i in h], float)
        p = cnt / cnt.sum(1, keepdims=True)
        root = cluster.chained(p @ p.T, cnt.sum(1), 0.12)
        assert {frozenset(np.flatnonzero(root == r).tolist()) for r in set(root)} == naive_agglomerate(h, 0.12)


def test_components_of_chains_and_stars(spark):
    rng = np.random.default_rng(11)
    name = rng.permutation(1000)
    links = [(i, i + 1) for i in range(200)] + [(300, 301 + i) for i in range(200)] + [(600 + 2 * i, 601 + 2 * i) for i in range(50)] + [(0, 1), (900, 900)]
    pairs = spark.createDataFrame([(int(name[a]), int(name[b])) for a, b in links], "a long, b long").repartition(3)
    got = {r["cid"]: r["component"] for r in cluster.components(pairs).collect()}
    sets = [range(201), range(300, 501)] + [(600 + 2 * i, 601 + 2 * i) for i in range(50)]
    assert got == {int(name[i]): int(min(name[list(s)])) for s in sets for i in s}


def test_events_at_the_timeout(spark):
    d = spark.createDataFrame([(1, 0.0), (1, 1.0), (1, 2.001)], "obj_id long, t double")
    got = [(round(r["t"], 3), r["event"]) for r in events.appearance_events(d, 1.0).collect()]
    assert sorted(got) == sorted([(0.0, "appeared"), (0.0, "moved"), (1.0, "moved"), (2.0, "disappeared"), (2.001, "appeared"), (2.001, "moved"), (3.001, "disappeared")])


def test_truth_holds_from_the_next_frame(spark):
    f = spark.createDataFrame([(0, 9), (0, 10), (0, 11)], "video_id long, frame_id long")
    t = spark.createDataFrame([(0, 3, "old"), (0, 10, "new")], "video_id long, frame_id long, arg string")
    assert [r["truth"] for r in evaluate.truth_as_of(f, t).orderBy("frame_id").collect()] == ["old", "old", "new"]


def test_accuracy(spark):
    rows = [("a", "a"), ("none", ""), (None, None), ("a", "b"), ("a", None), ("", "b")]
    r = evaluate.retrieval_accuracy(spark.createDataFrame(rows, "found string, truth string")).first()
    assert (r["frames"], r["success"], r["true_negative"], r["false_positive"], r["false_negative"]) == (6, 3, 2, 1, 1) and r["ratio"] == 0.5


def planted(rng, inliers, outliers):
    h = np.array([[0.9, 0.1, 30], [-0.05, 1.1, 10], [1e-4, -5e-5, 1]])
    a = rng.uniform(0, 300, (inliers + outliers, 2))
    p = np.c_[a, np.ones(len(a))] @ h.T
    b = p[:, :2] / p[:, 2:]
    b[inliers:] += rng.uniform(40, 200, (outliers, 2))
    return h, a, b


def pair_rows(spark, a, b, obj=1):
    rows = [(0, obj, i, i, 1.0, *map(float, x), *map(float, y)) for i, (x, y) in enumerate(zip(a, b))]
    return spark.createDataFrame(rows, "frame_id long, obj_id long, seq long, kpt_id long, weight double, ox double, oy double, fx double, fy double")


def test_ransac_recovers_a_planted_map(spark):
    rng = np.random.default_rng(1)
    h, a, b = planted(rng, 40, 20)
    r = match.verify_homography(pair_rows(spark, a, b)).first()
    assert r["support"] == 40 and sorted(r["kpts"]) == list(range(40)) and np.allclose(r["h"], h.ravel(), atol=1e-6)
    assert match.verify_ratio(pair_rows(spark, a, b)).first()["ratio"] == pytest.approx(40 / 60)
    line = np.c_[np.arange(30.0), np.arange(30.0)]
    assert match.verify_homography(pair_rows(spark, line, line)).count() == 0
    assert match.verify_homography(pair_rows(spark, a[:4], b[:4])).count() == 0


def test_fundamental_of_two_views(spark):
    rng = np.random.default_rng(2)
    x = np.c_[rng.uniform(-1, 1, (60, 2)), rng.uniform(3, 6, 60)]
    turn = np.array([[math.cos(0.2), 0, math.sin(0.2)], [0, 1, 0], [-math.sin(0.2), 0, math.cos(0.2)]])
    see = lambda p: 500 * p[:, :2] / p[:, 2:] + 300
    a, b = see(x), see(x @ turn.T + np.array([0.5, 0.1, 0.2]))
    b[50:] += 80
    r = match.verify_fundamental(pair_rows(spark, a, b)).first()
    assert r["support"] >= 50


def test_maps_and_inverses(spark):
    d = spark.createDataFrame([([1.1, 0.02, 3.0, -0.03, 0.9, 2.0, 1e-4, 2e-4, 1.0], 17.0, 5.0), ([1.0, 2.0, 3.0, 2.0, 4.0, 6.0, 0.0, 0.0, 1.0], 1.0, 1.0)], "h array<double>, x double, y double")
    px, py = geometry.apply_homography(F.col("h"), F.col("x"), F.col("y"))
    bx, by = geometry.apply_homography(F.col("inv"), F.col("px"), F.col("py"))
    got = d.withColumns({"px": px, "py": py, "inv": geometry.invert_homography(F.col("h"))}).select(bx.alias("x"), by.alias("y"), geometry.is_plausible(F.col("h")).alias("ok")).collect()
    assert got[0]["x"] == pytest.approx(17) and got[0]["y"] == pytest.approx(5) and got[0]["ok"]
    assert got[1]["x"] is None


def test_undistort_undoes_distort(spark):
    lens = dict(k1=0.05, k2=-0.01, p1=0.001, p2=-0.002, fx=500.0, fy=480.0, cx=320.0, cy=240.0)
    d = spark.createDataFrame([(x / 10, y / 10) for x in range(-5, 6) for y in range(-4, 5)], "x double, y double")
    u, v = geometry.distort(F.col("x"), F.col("y"), **lens)
    for r in d.withColumn("p", geometry.undistort(**lens)(u, v)).collect():
        assert r["p"]["x"] == pytest.approx(r["x"], abs=1e-6) and r["p"]["y"] == pytest.approx(r["y"], abs=1e-6)


def test_tree_descends_like_brute_force(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(60, 5)) + 8 * rng.normal(size=5) for _ in range(8)])
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    tree = vocab.build_tree(d, k=3, max_level=3, min_elem=20, iterations=8)
    leaves = [n for n in tree if not n.kids]
    assert sorted(n.word for n in leaves) == list(range(1, len(leaves) + 1)) and sum(n.size for n in leaves) == len(x)
    nodes = {n.id: n for n in tree}
    for r in vocab.quantise(d, tree).collect():
        n = nodes[1]
        while n.kids:
            n = n.kids[int(np.argmin([((np.array(r["vector"]) - k.mean) ** 2).sum() for k in n.kids]))]
        assert (r["node"], r["word"]) == (n.id, n.word)
    again = vocab.tree_from_table(vocab.tree_table(spark, tree))
    assert [(n.id, n.word, n.ordinal) for n in again] == [(n.id, n.word, n.ordinal) for n in tree]


def test_fewer_distinct_rows_than_branches(spark):
    d = spark.createDataFrame([(i, [float(i % 2)]) for i in range(40)], "id long, vector array<double>")
    tree = vocab.build_tree(d, k=4, max_level=3, min_elem=5)
    assert len(tree) == 3 and sorted(n.size for n in tree if not n.kids) == [20, 20]
    same = spark.createDataFrame([(i, [1.0]) for i in range(40)], "id long, vector array<double>")
    assert len(vocab.build_tree(same, k=4, min_elem=5)) == 1


def test_trees_built_over_tasks_and_in_one_are_the_same(spark, tmp_path):
    rng = np.random.default_rng(8)
    x = np.concatenate([np.round(rng.normal(size=(150, 4)) * 3 + 40 * rng.normal(size=4)) for _ in range(8)])  # whole numbers: sums are exact
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9999, None)], "id long, vector array<double>").repartition(6)
    spark.sparkContext.setJobGroup("whole", "")
    whole = vocab.build_tree(d, k=3, max_level=6, min_elem=20)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("whole"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 10 and max(n.level for n in whole) > 3
    told = lambda t: [(n.id, n.parent, n.ordinal, n.level, n.word, n.size, n.mean.tolist()) for n in t]
    assert told(vocab.build_tree(d, k=3, max_level=6, min_elem=20, at_hand=300)) == told(whole)
    for n in whole:
        assert not n.kids or n.size == sum(c.size for c in n.kids)
    sizes = {r["node"]: r["count"] for r in vocab.quantise(d.where("vector is not null"), whole).groupBy("node").count().collect()}
    assert sizes == {n.id: n.size for n in whole if not n.kids}
    vocab.save_tree(vocab.tree_table(spark, whole), str(tmp_path / "t"))
    vocab.save_tree(vocab.tree_table(spark, whole), str(tmp_path / "t"))
    assert told(vocab.tree_from_table(vocab.load_tree(spark, str(tmp_path / "t")))) == told(whole)


def test_a_split_against_plain_k_means(spark):
    x = np.round(np.random.default_rng(9).normal(size=(400, 3)) * 20)
    d = spark.createDataFrame([(1, v.tolist()) for v in x], "node long, vector array<double>").repartition(5)
    means, sizes = vocab.split_nodes(d, [1], 4, 32)[1]
    c = vocab._starts(x, 1, 4)[1]
    assert len({tuple(v) for v in c}) == 4
    for _ in range(32):
        own = np.array([min(range(4), key=lambda j: (((v - c[j]) ** 2).sum(), j)) for v in x])
        c = np.array([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(4)])
    assert np.allclose(means, c) and sizes.tolist() == np.bincount(own, minlength=4).tolist()
    assert vocab.split_nodes(d.where("false"), [1]) == {} and len(vocab.build_tree(d.select(F.lit(0).alias("id"), "vector").where("false"))) == 1


def test_pca_with_all_modes_is_lossless(spark):
    x = np.random.default_rng(5).normal(size=(80, 6)) @ np.random.default_rng(6).normal(size=(6, 6)) + 3
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    modes, avg, values = vectors.pca_fit(d, "v", 6)
    assert np.allclose(avg, x.mean(0)) and np.allclose(values, np.linalg.svd(x - x.mean(0), compute_uv=False))
    back = d.select("id", "v", vectors.pca_unproject(vectors.pca_project(F.col("v"), modes, avg), modes, avg).alias("b")).collect()
    assert all(np.allclose(r["v"], r["b"]) for r in back)


def test_patches():
    ramp = np.tile(np.arange(16.0), (1, 16, 1))
    h = vectors.orientation_histograms(np.concatenate([ramp, ramp.transpose(0, 2, 1)]))
    angle = vectors.dominant_orientations(h)
    assert angle[0] == pytest.approx(0, abs=1e-9) and angle[1] == pytest.approx(np.pi / 2)
    sig = vectors.binary_signatures(h, angle)
    assert (sig >= 0).all() and (sig < 1 << 16).all()


def test_groups_of_points(spark):
    rows = [(1, 0, 0.0, 0.0, 5), (1, 1, 2.0, 0.0, 5), (1, 2, 10.0, 0.0, 6), (1, 3, 3.9, 0.0, 7), (2, 0, 0.0, 0.0, 5)]
    g = views.group_points(spark.createDataFrame(rows, "image_id long, seq long, x double, y double, word long"))
    got = {(r["image_id"], r["group"], r["word"]): r["cnt"] for r in g.collect()}
    assert got == {(1, 1, 5): 2, (1, 1, 7): 1, (1, 2, 6): 1, (2, 1, 5): 1}
    assert {(r["image_id"], r["group"]) for r in views.prune_points(g, 10, 0.3).collect()} == {(1, 1)}


def test_kalman_follows_a_straight_line(spark):
    p = spark.createDataFrame([(1, t, [0.0, 0.0, 0.0, float(t), 2.0 * t, 5.0]) for t in range(40)], "obj_id long, frame_id long, pose array<double>")
    out = {r["frame_id"]: r["x"] for r in events.kalman(p).collect()}
    assert out[39][3] == pytest.approx(39, abs=0.5) and out[39][4] == pytest.approx(78, abs=1.0)


def test_running_words(spark):
    rows = [(0, t, f, w) for t in range(5) for f, w in ((1, 3), (1, 3), (2, 0), (4, 9), (7, 3))]
    p = spark.createDataFrame(rows, "video_id long, track_id long, frame_id long, word long")
    key = lambda df: sorted(tuple(r[c] for c in ("video_id", "track_id", "frame_id", "word", "cnt")) for r in df.collect())
    want = [(0, t, f, w, n) for t in range(5) for f, w, n in ((1, 3, 2), (2, 3, 2), (4, 3, 2), (4, 9, 1), (7, 3, 3), (7, 9, 1))]
    assert key(track.running_histograms(p)) == sorted(want)


def test_files(spark, tmp_path):
    record = np.zeros(7, np.dtype([("ptr", "<i8"), ("x", "<f4", (3,))]))
    record["ptr"], record["x"] = [-1, 0, 20, -1, 0, 20, 40], np.arange(21).reshape(7, 3)
    (tmp_path / "a.bin").write_bytes(record.tobytes())
    got = tables.read_packets(spark, str(tmp_path / "a.bin"), 3).orderBy("packet_no").collect()
    assert [r["ptr"] for r in got] == record["ptr"].tolist() and got[6]["descriptor"] == [18.0, 19.0, 20.0]
    nan = spark.createDataFrame([("f", 0, [1.0, float("nan")]), ("f", 1, [float("inf"), 0.0])], "source string, packet_no long, descriptor array<float>")
    assert {(r["packet_no"], r["coord"]) for r in tables.bad_coordinates(nan).collect()} == {(0, 1), (1, 0)}
    with pytest.raises(ValueError, match="f#0"):
        tables.require_finite(nan)
    h = hist(spark, {1: {5: 2}, 2**20: {2**31: 7}})
    tables.save_clusters(h, str(tmp_path / "c"))
    assert sorted(map(tuple, tables.load_clusters(spark, str(tmp_path / "c")).collect())) == [(1, 5, 2), (2**20, 2**31, 7)]
    for k in (3, 4, 5, 9):
        (tmp_path / f"v{k:04d}.bmp").write_bytes(b"x" * k)
    assert [r["frame_id"] for r in tables.read_frames(spark, str(tmp_path), "v", first=4, last=8).orderBy("frame_id").collect()] == [4, 5]
    (tmp_path / "t.txt").write_text("10 check  a b \nx\n11 jump c\n 12 addH d")
    assert [tuple(r) for r in tables.read_truth_script(spark, str(tmp_path / "t.txt")).orderBy("frame_id").collect()] == [(10, "check", "a b"), (12, "addH", "d")]
    m = np.random.default_rng(0).normal(size=(4, 5))
    tables.write_matrix(spark, m, str(tmp_path / "m"))
    assert np.array_equal(tables.read_matrix(spark, str(tmp_path / "m"), 3), m[:3])


def test_two_forms_of_ncc_agree(spark):
    from vistrack.operators import track

    rng = np.random.default_rng(4)
    x = rng.normal(100, 30, (40, 64))
    x[7], x[8] = 5.0, x[6] * 1.01  # a flat patch, and a near copy
    rows = [(i // 20, i, 10.0, 10.0, 0, x[i].tolist()) for i in range(40)]
    p = spark.createDataFrame(rows, "frame_id long, kpt_id long, u double, v double, word long, patch array<double>")
    got = {(r.q_id, r.kpt_id): r.ncc for r in track.claimed(p, 20.0, accept=0.0, stop=2.0).collect()}
    q = p.where("frame_id = 0").select(F.col("kpt_id").alias("q_id"), F.col("patch").alias("other"))
    both = q.crossJoin(p.where("frame_id = 1")).select("q_id", "kpt_id", vectors.patch_ncc(F.col("patch"), F.col("other")).alias("ncc")).collect()
    best = {}
    for r in both:
        if r.ncc > best.get(r.q_id, (0.0, 0))[0]:
            best[r.q_id] = (r.ncc, r.kpt_id)
    assert {k for k, _ in got} == set(best) and 7 not in best
    assert all(best[a] == (pytest.approx(n, abs=1e-12), b) for (a, b), n in got.items())


def test_signatures_turn_with_the_patch():
    rng = np.random.default_rng(9)
    patches = np.full((30, 16, 16), 50.0)
    for p in patches:  # blobs around the middle (7, 7), which has no zone of its own; nothing there or at the rim
        for _ in range(4):
            y, x = 7, 7
            while max(abs(y - 7), abs(x - 7)) < 3:
                y, x = rng.integers(3, 12, 2)
            p[y - 1 : y + 2, x - 1 : x + 2] += rng.uniform(20, 150)
    turned = patches.copy()
    turned[:, :15, :15] = np.rot90(patches[:, :15, :15], -1, (1, 2))
    h, g = vectors.orientation_histograms(patches), vectors.orientation_histograms(turned)
    assert np.allclose(np.roll(np.roll(h, 1, 1), 4, 2), g)  # a quarter turn is one zone and four orientations
    a, b = vectors.dominant_orientations(h), vectors.dominant_orientations(g)
    assert np.allclose(np.mod(b - a, 2 * np.pi), np.pi / 2)
    s = vectors.binary_signatures(h, a)
    assert (s == vectors.binary_signatures(g, b)).all() and len(set(s.tolist())) > 10


def test_orientation_weights_against_a_plain_loop():
    rng = np.random.default_rng(2)
    p = rng.uniform(0, 255, (16, 16))
    want = np.zeros((4, 16))
    for y in range(1, 15):
        for x in range(1, 15):
            gx, gy = (p[y, x + 1] - p[y, x - 1]) / 2, (p[y + 1, x] - p[y - 1, x]) / 2
            o = math.atan2(gy, gx) / (2 * math.pi) * 16 % 16
            r4 = (4 * ((x - 7) ** 2 + (y - 7) ** 2) / 256) ** 2
            turn = math.atan2(y - 7, x - 7) / (2 * math.pi) * 4 % 4
            z, d = int(turn), abs(turn - int(turn) - 0.5) * 2
            other = z - 1 if turn - z < 0.5 else z + 1
            for zone, w in ((z, math.exp(-1.5 * d**4)), (other % 4, math.exp(-1.5 * (1 - d) ** 4))):
                for b, part in ((int(o) % 16, 1 - o % 1), ((int(o) + 1) % 16, o % 1)):
                    want[zone, b] += math.hypot(gx, gy) * math.exp(-1.8 * r4) * w * part
    assert np.allclose(vectors.orientation_histograms(p[None])[0], want)


def test_equalised_patches(spark):
    rows = [(1, [0.0, 0.0, 255.0, 300.0]), (2, None), (3, []), (4, [9.0, 1.0])]
    d = spark.createDataFrame(rows, "id long, p array<double>")
    got = {r.id: r.e for r in d.select("id", vectors.equalise_patch(F.col("p")).alias("e")).collect()}
    assert got[2] is None and got[3] == [] and got[4] == [1.0, 127 / 255] and got[1] == [127 / 255, 127 / 255, 1.0, 1.0]


def test_least_median_survives_nearly_half_outliers(spark):
    from vistrack.operators import match

    rng = np.random.default_rng(8)
    n, wrong = 100, 45
    x = np.c_[rng.uniform(-2, 2, (n, 2)), rng.uniform(4, 8, n)]  # points seen by two cameras
    turn = np.array([[np.cos(0.1), 0, np.sin(0.1)], [0, 1, 0], [-np.sin(0.1), 0, np.cos(0.1)]])
    a, b = x, x @ turn.T + [1.0, 0.2, 0.1]
    a, b = (500 * p[:, :2] / p[:, 2:] + 320 for p in (a, b))
    b[:wrong] = rng.uniform(0, 640, (wrong, 2))
    rows = [(1, 2, i, i, 100.0 if i % 2 else 1.0, *map(float, (*a[i], *b[i]))) for i in range(n)]
    pairs = spark.createDataFrame(rows, "frame_id long, obj_id long, seq long, kpt_id long, weight double, ox double, oy double, fx double, fy double")
    got = match.verify_fundamental(pairs).collect()
    assert len(got) == 1
    d = match.epipolar_distances(np.array(got[0].f).reshape(1, 3, 3).transpose(0, 2, 1), a[wrong:], b[wrong:])
    assert np.median(d) < 1e-3 and got[0].support >= n - wrong - 1
    assert match.verify_fundamental(pairs.where("seq < 15")).count() == 0


def test_kalman_starts_anew_after_a_gap(spark):
    from vistrack.operators import events

    p = [(1, f, [0.0, 0.0, 0.0, float(f), 2.0 * f, 0.0]) for f in (1, 2, 3, 4, 8, 9)]
    got = {r.frame_id: r.x for r in events.kalman(spark.createDataFrame(p, "obj_id long, frame_id long, pose array<double>")).collect()}
    assert len(got) == 6 and got[1] == p[0][2] and got[8] == p[4][2] and got[9][3] == 8.0


def test_consensus_over_tables_equals_the_form_in_one_group(spark):
    from vistrack.operators import match

    rng, rows = np.random.default_rng(6), []
    for g, n in enumerate((4, 5, 40, 3000)):
        a = rng.uniform(0, 400, (n, 2))
        h = np.array([[1.02, 0.01 * g, 5], [-0.02, 0.98, 3], [1e-5, 2e-5, 1]])
        p = np.c_[a, np.ones(n)] @ h.T
        b = p[:, :2] / p[:, 2:] + rng.normal(0, 0.2, (n, 2))
        b[rng.permutation(n)[: n // 3]] += 90
        rows += [(1, g, k + 1, *map(float, (*a[k], *b[k]))) for k in range(n)]
    pairs = spark.createDataFrame(rows, "frame_id long, obj_id long, seq long, ox double, oy double, fx double, fy double")
    for stop in (50.0, 1e9):
        got = {r.obj_id: r for r in match.consensus_homographies(pairs, 60, 3.0, stop, chunk=500).collect()}
        assert set(got) == {1, 2, 3} or set(got) == {2, 3}
        for g, r in got.items():
            own = np.array([x[3:] for x in rows if x[1] == g])
            h, support, inliers = match.ransac(own[:, :2], own[:, 2:], 60, 3.0, stop, match.group_seed((1, g)))
            assert r.support == pytest.approx(support) and np.allclose(r.h, h) and (r.n, r.inliers) == (len(own), inliers.sum())
    assert got[3].inliers > 1900
