"""Correspondences between frame and object keypoints, and their geometric verification."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import homography_from_fours, homography_from_points, is_reprojection_inlier
from ..plans.state import small, written
from . import track


def fanned(points: DataFrame, objects: DataFrame, key: str, rows: int = 16_000_000) -> DataFrame:
    """`points` joined to `objects` on `key` where this makes far more rows than there are on both sides.

    The pairs are counted first. A key's points are dealt into slices that make a fourth of `rows` pairs at most, and slices
    to as many tasks as `rows` goes into the whole, as sizes of the two sides don't tell what a task has to make. All
    pairs of a point leave one after another, the same objects in the same order for each, which packs well.
    """
    count = lambda t, c: t.groupBy(key).agg(F.count("*").cast("double").alias(c))
    pairs = count(points, "n").join(count(objects, "m"), key).select(key, (F.col("n") * F.col("m")).alias("pairs"))
    slices = written(pairs.select(key, "pairs", F.ceil(F.col("pairs") * 4 / rows).cast("long").alias("slices")), "slices")
    tasks = int((slices.agg(F.sum("pairs")).first()[0] or 0) / rows) + 1
    if tasks == 1:
        return points.join(objects, key)
    slices = small(slices.drop("pairs"))
    p = points.join(slices, key).withColumn("slice", F.pmod(F.xxhash64(*points.columns), "slices")).drop("slices")
    o = objects.join(slices, key).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).drop("slices")
    tasks = max(tasks, points.sparkSession.sparkContext.defaultParallelism)
    return p.repartition(tasks, key, "slice").join(o.repartition(tasks, key, "slice").hint("merge"), [key, "slice"]).drop("slice")


def by_word(points: DataFrame, objects: DataFrame, weight: float = 0.1, rows: int = 16_000_000) -> DataFrame:
    """frame_id, obj_id, kpt_id, obj_kpt_id, weight: keypoints that share a valid word with an object's keypoint."""
    p, o = points.select("frame_id", "kpt_id", "word").where("word <> 0"), objects.select("obj_id", "obj_kpt_id", "word").where("word <> 0")
    return fanned(p, o, "word", rows).select("frame_id", "obj_id", "kpt_id", "obj_kpt_id", F.lit(weight).alias("weight"))


def by_cid(points: DataFrame, ranked: DataFrame, objects: DataFrame, weights: DataFrame, candidates: DataFrame | None = None, digits: int | None = None, rows: int = 16_000_000) -> DataFrame:
    """The same through the ranked clusters (track_id, cid, score) of a keypoint's track; weight is score times idf,
    rounded to `digits` before it is copied to all objects.

    `candidates` (frame_id, obj_id) thin out the objects before the second join fans out.
    """
    o = objects.select("obj_id", "obj_kpt_id", "cid")
    weight = F.col("score") * F.col("idf")
    weight = (weight if digits is None else F.round(weight, digits)).alias("weight")
    r = ranked.join(weights.select(F.col("word").alias("cid"), "idf"), "cid").select("track_id", "cid", weight)
    p = points.select("frame_id", "kpt_id", "track_id").join(r, "track_id").drop("track_id")
    out = p.join(candidates, "frame_id").join(o, ["obj_id", "cid"]) if candidates is not None else fanned(p, o, "cid", rows)
    return out.select("frame_id", "obj_id", "kpt_id", "obj_kpt_id", "weight")


def coverage(matched: DataFrame, db: DataFrame, weights: DataFrame) -> DataFrame:
    """frame_id, obj_id, coverage: idf of the distinct matched cids over the idf of all the object's bins."""
    w = weights.select(F.col("word").alias("cid"), "idf")
    whole = db.select("obj_id", "cid").distinct().join(w, "cid").groupBy("obj_id").agg(F.sum("idf").alias("all"))
    got = matched.select("frame_id", "obj_id", "cid").distinct().join(w, "cid").groupBy("frame_id", "obj_id").agg(F.sum("idf").alias("got"))
    return got.join(whole, "obj_id").where(F.col("all") > 0).select("frame_id", "obj_id", (F.col("got") / F.col("all")).alias("coverage"))


def seen_coverage(seen: DataFrame, db: DataFrame, weights: DataFrame, rows: int = 4_000_000) -> DataFrame:
    """coverage() of all objects with a bin among the cids that a frame's points have (frame_id, cid): a frame meets an
    object's bin once, however many points show it."""
    bins = db.select("obj_id", "cid").distinct().join(weights.select(F.col("word").alias("cid"), "idf"), "cid")
    whole = bins.groupBy("obj_id").agg(F.sum("idf").alias("all")).where(F.col("all") > 0)
    bins = written(bins.join(whole, "obj_id").select("cid", "obj_id", "idf", "all"), "bins")
    met = fanned(written(seen.select("frame_id", "cid").distinct(), "seen"), bins, "cid", rows)
    return met.groupBy("frame_id", "obj_id").agg((F.sum("idf") / F.max("all")).alias("coverage"))


def tracked(points: DataFrame, assigned: DataFrame, min_track: int = 2) -> DataFrame:
    """frame_id, kpt_id, obj_id, obj_kpt_id, weight, use of points (frame_id, kpt_id, prev_kpt_id, length).

    A keypoint whose predecessor was assigned keeps its match with weight 100 (use `fixed`); others may be matched
    anew (`free`) on tracks of `min_track` points. Those fixed to one object are thereby out for any other.
    """
    a = assigned.select(F.col("kpt_id").alias("prev_kpt_id"), "obj_id", "obj_kpt_id")
    out = points.join(a, "prev_kpt_id", "left")
    use = F.when(F.col("obj_id").isNotNull(), "fixed").when(F.col("length") >= min_track, "free")
    return out.select("frame_id", "kpt_id", "obj_id", "obj_kpt_id", F.when(F.col("obj_id").isNotNull(), 100.0).alias("weight"), use.alias("use")).where("use is not null")


def candidates(previous: DataFrame, scores: DataFrame, k: int = 3) -> DataFrame:
    """frame_id, obj_id: the previous frame's objects, and the k + (number of these) best scores above 0."""
    n = previous.groupBy("frame_id").agg(F.count("*").alias("n"))
    order = Window.partitionBy("frame_id").orderBy(F.desc("score"), "obj_id")
    top = scores.where("score > 0").withColumn("rank", F.row_number().over(order)).join(n, "frame_id", "left")
    top = top.where(F.col("rank") <= k + F.coalesce("n", F.lit(0)))
    return previous.select("frame_id", "obj_id").union(top.select("frame_id", "obj_id")).distinct()


def order_for_sampling(pairs: DataFrame, visible: DataFrame) -> DataFrame:
    """Adds seq (from 1): by falling weight, tracked ones first where the object was visible on the frame before."""
    at = pairs.join(visible.select("frame_id", "obj_id", F.lit(True).alias("was")), ["frame_id", "obj_id"], "left")
    first = (F.coalesce("was", F.lit(False)) & (F.col("weight") >= 100)).cast("int")
    order = Window.partitionBy("frame_id", "obj_id").orderBy(F.desc(first), F.desc("weight"), "kpt_id", "obj_kpt_id")
    return at.withColumn("seq", F.row_number().over(order).cast("long")).drop("was")


#: Maps that an iteration tries, and maps that are drawn at a time.
MAPS, BATCH = 4, 64
#: Pairs that are held against maps at a time.
PAIRS = 4096


def drawn_maps(a: np.ndarray, b: np.ndarray, iterations: int, seed: int, batch: int = BATCH):
    """Batches (batch, 9) of maps from four pairs each: MAPS for each iteration, of which number i draws from the first
    min(6 + i, n) pairs. What lies beyond the first 6 + `iterations` pairs is never drawn."""
    n, rng = min(len(a), 6 + iterations), np.random.default_rng(seed)
    for i in range(0, MAPS * iterations, batch):
        m = min(batch, MAPS * iterations - i)
        size = np.minimum(6 + np.arange(i, i + m) // MAPS, n)
        draw = np.where(np.arange(n) < size[:, None], rng.random((m, n)), 2).argsort(1)[:, :4]
        yield homography_from_fours(a[draw], b[draw])


def supports(h: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Each map's support, the sum of 1 - 0.1 d2 / t2 over its inliers, and who these are (maps, pairs)."""
    maps, support, near = np.nan_to_num(h).reshape(-1, 3, 3), np.zeros(len(h)), np.zeros((len(h), len(a)), bool)
    for i in range(0, len(a), PAIRS):
        c = slice(i, i + PAIRS)
        with np.errstate(all="ignore"):
            p = maps @ np.c_[a[c], np.ones(len(a[c]))].T
            d2 = ((p[:, :2] / p[:, 2:] - b[c].T) ** 2).sum(1)
        near[:, c] = d2 < threshold * threshold
        support += np.where(near[:, c], 1 - 0.1 * d2 / threshold**2, 0).sum(1)
    support[np.isnan(h).any(1)] = 0
    return support, near


def ransac(a: np.ndarray, b: np.ndarray, iterations: int, threshold: float, stop: float, seed: int) -> tuple[np.ndarray | None, float, np.ndarray]:
    """(h, support, inliers) of the best of drawn_maps(), for pairs that come best first; drawing ends with the batch in
    which the support reaches `stop`."""
    best, top, inliers = None, 0.0, np.zeros(len(a), bool)
    if len(a) < 5:
        return best, top, inliers
    for h in drawn_maps(a, b, iterations, seed):
        support, near = supports(h, a, b, threshold)
        k = int(support.argmax())
        if support[k] > top:
            best, top, inliers = h[k], float(support[k]), near[k]
        if top >= stop:
            break
    return best, top, inliers


def group_seed(key: tuple) -> int:
    return abs(hash(tuple(int(k) for k in key))) % 2**32


def consensus_homographies(pairs: DataFrame, iterations: int = 1000, threshold: float = 3.0, stop: float = 50.0, chunk: int = 8192) -> DataFrame:
    """frame_id, obj_id, support, inliers, n, h: what ransac() finds in each group of pairs (frame_id, obj_id, seq from 1,
    ox, oy, fx, fy), for groups of any size; none with fewer than five pairs.

    Maps are drawn from the few pairs at the head of a group. Their supports are sums over all pairs, so each chunk of a
    group is held against all maps in a task of its own and sends a sum for each; the best map is then found among
    sums, and its inliers counted where the pairs lie.
    """
    key = ["frame_id", "obj_id"]
    sizes = pairs.groupBy(*key).agg(F.count("*").alias("n")).where("n >= 5")

    def draw(k: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("seq")
        maps = np.concatenate(list(drawn_maps(f[["ox", "oy"]].to_numpy(float), f[["fx", "fy"]].to_numpy(float), iterations, group_seed(k)))) if len(f) >= 5 else np.zeros((0, 9))
        return pd.DataFrame({"frame_id": [k[0]], "obj_id": [k[1]], "maps": [maps.ravel()]})

    def held(f: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        if f.empty or m.empty:
            return pd.DataFrame(columns=["frame_id", "obj_id", "supports"])
        h, a, b = m["maps"].iloc[0].reshape(-1, 9), f[["ox", "oy"]].to_numpy(float), f[["fx", "fy"]].to_numpy(float)
        s = np.concatenate([supports(h[i : i + BATCH], a, b, threshold)[0] for i in range(0, len(h), BATCH)])
        return pd.DataFrame({"frame_id": f["frame_id"].iloc[:1], "obj_id": f["obj_id"].iloc[:1], "supports": [s]})

    maps = written(pairs.where(F.col("seq") <= 6 + iterations).groupBy(*key).applyInPandas(draw, "frame_id long, obj_id long, maps array<double>"), "maps")
    each = maps.join(sizes, key).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / chunk)))).drop("n")
    rows = pairs.select(*key, F.floor((F.col("seq") - 1) / chunk).alias("chunk"), "ox", "oy", "fx", "fy")
    parts = rows.groupBy(*key, "chunk").cogroup(each.groupBy(*key, "chunk")).applyInPandas(held, "frame_id long, obj_id long, supports array<double>")
    sums = parts.select(*key, F.posexplode("supports").alias("map", "s")).groupBy(*key, "map").agg(F.sum("s").alias("support"))
    end = F.min(F.when(F.col("support") >= stop, F.floor(F.col("map") / BATCH))).over(Window.partitionBy(*key))
    tried = sums.withColumn("end", end).where(F.col("end").isNull() | (F.floor(F.col("map") / BATCH) <= F.col("end")))
    top = tried.groupBy(*key).agg(F.max(F.struct("support", (-F.col("map")).alias("m"))).alias("b")).where("b.support > 0")
    best = maps.join(top, key).join(sizes, key).select(*key, F.col("b.support").alias("support"), "n", F.slice("maps", (1 - F.col("b.m") * 9).cast("int"), 9).alias("h"))
    best = written(best, "best")
    hit = pairs.join(best.select(*key, "h"), key).where(is_reprojection_inlier(F.col("h"), *(F.col(c) for c in ("ox", "oy", "fx", "fy")), threshold))
    return best.join(hit.groupBy(*key).agg(F.count("*").alias("inliers")), key).select(*key, "support", "inliers", "n", "h")


def _plausible(h: np.ndarray) -> bool:
    c = np.array([(0, 0, 1), (200, 0, 1), (200, 200, 1), (0, 200, 1)], float) @ h.reshape(3, 3).T
    with np.errstate(all="ignore"):
        p = c[:, :2] / c[:, 2:]
        e = np.sqrt(((p - np.roll(p, -1, 0)) ** 2).sum(1))
        r = e / np.roll(e, -1)
    return bool(np.isfinite(r).all() and (e >= 20).all() and (e <= 2000).all() and (r >= 0.4).all() and (r <= 2.5).all())


def homography_of(pairs: pd.DataFrame, seed: int, threshold: float = 3.0, min_pairs: int = 10, min_support: float = 12.0) -> tuple[np.ndarray, np.ndarray] | None:
    """(h, inliers) of pairs (weight, ox, oy, fx, fy) in their order for sampling, if a map stands up. With ten tracked
    pairs 200 draws do, else 1000; a plausible map is fitted anew to its inliers until its support no longer rises."""
    if len(pairs) < min_pairs:
        return None
    a, b = pairs[["ox", "oy"]].to_numpy(float), pairs[["fx", "fy"]].to_numpy(float)
    kept = int((pairs["weight"] >= 100).sum())
    iterations, stop = (200, max(30, kept + 2)) if kept >= 10 else (1000, 50)
    h, support, inliers = ransac(a, b, iterations, threshold, stop, seed)
    if h is None or support < min_support or not _plausible(h):
        return None
    for _ in range(10):
        fit = homography_from_points(a[inliers][None], b[inliers][None])
        if np.isnan(fit).any():
            break
        s, near = supports(fit, a, b, threshold)
        if s[0] <= support:
            break
        h, support, inliers = fit[0], float(s[0]), near[0]
    return (h, inliers) if inliers.sum() >= min_support else None


def verify_homography(pairs: DataFrame, threshold: float = 3.0, min_pairs: int = 10, min_support: float = 12.0) -> DataFrame:
    """frame_id, obj_id, support, h, kpts: the objects that stand up to geometry on a frame, with the keypoints on them.

    Pairs are (frame_id, obj_id, seq, kpt_id, weight, ox, oy, fx, fy); maps are found by homography_of(). Draws are
    seeded by the group's key, so a rerun agrees. A group is bounded by a frame's keypoints and an object's quota.
    """

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("seq")
        found = homography_of(f, group_seed(key), threshold, min_pairs, min_support)
        if found is None:
            return pd.DataFrame(columns=["frame_id", "obj_id", "support", "h", "kpts"])
        h, inliers = found
        return pd.DataFrame({"frame_id": [key[0]], "obj_id": [key[1]], "support": [int(inliers.sum())], "h": [h.tolist()], "kpts": [f["kpt_id"].to_numpy()[inliers].tolist()]})

    return pairs.groupBy("frame_id", "obj_id").applyInPandas(run, "frame_id long, obj_id long, support int, h array<double>, kpts array<long>")


def fundamentals(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The normalised eight-point F (m, 3, 3) with b' F a = 0 of m stacks of points (m, k, 2); NaN where there is none."""

    def scaled(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mid = p.mean(1, keepdims=True)
        s = np.sqrt(2) / np.maximum(np.sqrt(((p - mid) ** 2).sum(2)).mean(1), 1e-12)
        t = np.zeros((len(p), 3, 3))
        t[:, 0, 0] = t[:, 1, 1] = s
        t[:, :2, 2], t[:, 2, 2] = -s[:, None] * mid[:, 0], 1
        return np.concatenate([p, np.ones((*p.shape[:2], 1))], 2) @ t.transpose(0, 2, 1), t

    (p, tp), (q, tq) = scaled(a), scaled(b)
    _, _, vt = np.linalg.svd((q[..., :, None] * p[..., None, :]).reshape(*p.shape[:2], 9))
    u, s, v = np.linalg.svd(vt[:, -1].reshape(-1, 3, 3))
    s[:, 2] = 0
    return tq.transpose(0, 2, 1) @ (u * s[:, None, :] @ v) @ tp


def epipolar_distances(f: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(m, n): how far each b lies from the line that each F gives its a."""
    out = np.empty((len(f), len(a)))
    for i in range(0, len(a), PAIRS):
        c = slice(i, i + PAIRS)
        line = f @ np.c_[a[c], np.ones(len(a[c]))].T
        off = np.einsum("mkn,nk->mn", line, np.c_[b[c], np.ones(len(b[c]))])
        with np.errstate(all="ignore"):
            out[:, c] = np.nan_to_num(np.abs(off) / np.maximum(np.hypot(line[:, 0], line[:, 1]), 1e-12), nan=np.inf)
    return out


def best_fundamental(a: np.ndarray, b: np.ndarray, threshold: float, seed: int, draws: int, median: bool, batch: int = 128) -> tuple[np.ndarray | None, np.ndarray]:
    """(F, inliers) out of `draws` from eight pairs: the most inliers below the threshold or, by `median`, the least
    median of squared distances, which holds with nearly half of all pairs wrong; its inliers are those within 2.5
    robust standard deviations, and at least within a rounding error."""
    rng, best, top, inliers = np.random.default_rng(seed), None, -np.inf, np.zeros(len(a), bool)
    batch = max(1, min(batch, 2_000_000 // len(a)))  # draws follow each other in one stream, however many are taken at once
    for i in range(0, draws, batch):
        draw = rng.random((min(batch, draws - i), len(a))).argsort(1)[:, :8]
        f = fundamentals(a[draw], b[draw])
        d = epipolar_distances(f, a, b)
        score = -np.median(d * d, axis=1) if median else (d < threshold).sum(1)
        k = int(score.argmax())
        if score[k] > top and np.isfinite(f[k]).all():
            best, top = f[k], float(score[k])
            inliers = d[k] <= max(1e-6, 2.5 * 1.4826 * (1 + 5 / max(1, len(a) - 8)) * np.sqrt(-top)) if median else d[k] < threshold
    return best, inliers


def fundamental_of(pairs: pd.DataFrame, seed: int, threshold: float = 3.0, min_inliers: int = 20, draws: int = 300, min_tracked: int = 16, median_draws: int = 1200) -> tuple[np.ndarray, np.ndarray] | None:
    """(F, inliers) of pairs (weight, ox, oy, fx, fy), if `min_inliers` stand up: by inliers, or by the least median with
    `min_tracked` tracked pairs (weight 100) or more."""
    if len(pairs) < max(8, min_inliers):
        return None
    a, b = pairs[["ox", "oy"]].to_numpy(float), pairs[["fx", "fy"]].to_numpy(float)
    median = int((pairs["weight"] >= 100).sum()) >= min_tracked
    f, inliers = best_fundamental(a, b, threshold, seed, median_draws if median else draws, median)
    return None if f is None or inliers.sum() < min_inliers else (f, inliers)


def verify_fundamental(pairs: DataFrame, threshold: float = 3.0, min_inliers: int = 20, draws: int = 300, min_tracked: int = 16, median_draws: int = 1200) -> DataFrame:
    """frame_id, obj_id, support, f: F from object to frame by fundamental_of(), whose seeded draws of eight are taken all
    at once in stacked decompositions. F is given transposed, so that object' F' frame is the check."""

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        found = fundamental_of(g.sort_values("seq"), group_seed(key), threshold, min_inliers, draws, min_tracked, median_draws)
        if found is None:
            return pd.DataFrame(columns=["frame_id", "obj_id", "support", "f"])
        f, inliers = found
        return pd.DataFrame({"frame_id": [key[0]], "obj_id": [key[1]], "support": [int(inliers.sum())], "f": [f.T.ravel().tolist()]})

    return pairs.groupBy("frame_id", "obj_id").applyInPandas(run, "frame_id long, obj_id long, support int, f array<double>")


def verify_ratio(pairs: DataFrame, threshold: float = 5.0, min_pairs: int = 16, iterations: int = 1000) -> DataFrame:
    """frame_id, obj_id, ratio: inliers over all pairs, 0 with fewer than `min_pairs`."""

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("seq")
        ratio = 0.0
        if len(f) >= min_pairs:
            _, _, inliers = ransac(f[["ox", "oy"]].to_numpy(float), f[["fx", "fy"]].to_numpy(float), iterations, threshold, 0.9 * len(f), group_seed(key))
            ratio = float(inliers.mean())
        return pd.DataFrame({"frame_id": [key[0]], "obj_id": [key[1]], "ratio": [ratio]})

    return pairs.groupBy("frame_id", "obj_id").applyInPandas(run, "frame_id long, obj_id long, ratio double")


def first_of_word(objects: DataFrame) -> DataFrame:
    """obj_id, obj_kpt_id, word: of the object keypoints with a word the one that comes first in `place`; no other can be
    assigned where all points of the word may be."""
    first = objects.groupBy("word").agg(F.min(F.struct("place", "obj_id", "obj_kpt_id")).alias("o"))
    return first.select("o.obj_id", "o.obj_kpt_id", "word")


def assign_keypoints(inliers: DataFrame) -> DataFrame:
    """One (obj_id, obj_kpt_id) per frame keypoint: the object that comes first in `place` claims it."""
    first = inliers.groupBy("frame_id", "kpt_id").agg(F.min(F.struct("place", "obj_id", "obj_kpt_id")).alias("o"))
    return first.select("frame_id", "kpt_id", "o.obj_id", "o.obj_kpt_id")


def closest_assigned(points: DataFrame, assigned: DataFrame, r: float = 30.0) -> DataFrame:
    """frame_id, q_id, kpt_id, d2: the nearest assigned keypoint (frame_id, kpt_id, u, v) within r of each point."""
    return track.closest_point(points, assigned, r)


def learn_points(points: DataFrame, near: DataFrame, instances: DataFrame, threshold: float = 3.0, min_track: int = 5, quota: int = 3000) -> DataFrame:
    """obj_id, track_id, ox, oy, n: tracks to add to an object.

    `points` (frame_id, kpt_id, track_id, u, v, cid) are unassigned; `near` (track_id, obj_id) says which object's
    keypoints they are close to; `instances` (frame_id, obj_id, h, h_inv) where the object is. A track of at least
    `min_track` points is learned at the mean of its back-projections if the object is there on each of its frames
    and each reprojection is within the threshold. A quota picks by a hash of the track.
    """
    from ..functions.geometry import apply_homography

    at = points.where("cid <> 0").join(near.distinct(), "track_id")
    at = at.withColumn("points", F.count("*").over(Window.partitionBy("obj_id", "track_id"))).where(F.col("points") >= min_track)
    at = at.join(instances, ["frame_id", "obj_id"])
    ox, oy = apply_homography(F.col("h_inv"), F.col("u"), F.col("v"))
    mean = at.withColumns({"bx": ox, "by": oy}).withColumns({c: F.avg(b).over(Window.partitionBy("obj_id", "track_id")) for c, b in (("ox", "bx"), ("oy", "by"))})
    px, py = apply_homography(F.col("h"), F.col("ox"), F.col("oy"))
    off = F.pow(px - F.col("u"), F.lit(2.0)) + F.pow(py - F.col("v"), F.lit(2.0))
    good = mean.withColumn("ok", off <= threshold * threshold).groupBy("obj_id", "track_id").agg(
        F.max("ox").alias("ox"), F.max("oy").alias("oy"), F.count("*").alias("n"), F.max("points").alias("points"), F.every("ok").alias("ok")
    )
    order = Window.partitionBy("obj_id").orderBy((F.col("track_id") * 2654435761) % 4294967296, "track_id")
    good = good.where("ok and n = points").withColumn("k", F.row_number().over(order))
    return good.where(F.col("k") <= quota).select("obj_id", "track_id", "ox", "oy", "n")


def on_previous_frame(instances: DataFrame) -> DataFrame:
    """Adds was: whether the object was there one frame before."""
    w = Window.partitionBy("obj_id").orderBy("frame_id")
    return instances.withColumn("was", F.coalesce(F.col("frame_id") - F.lag("frame_id").over(w) == 1, F.lit(False)))
