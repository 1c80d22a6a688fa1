"""Tracking objects over frames: retrieval, correspondences and verification put together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import follow, histo, match, retrieve
from .inputs import K, keypoints, maps, query
from .state import checkpointed
from .tracking import rounded


def _verified(points: DataFrame, objects: DataFrame, candidates: DataFrame, fixed: DataFrame | None, visible: DataFrame) -> DataFrame:
    """Instances (frame_id, obj_id, support, h, kpts) of the candidates, from fixed and word correspondences."""
    near = points.join(candidates, "frame_id")
    pairs = near.join(objects.select("obj_id", "obj_kpt_id", "word"), ["obj_id", "word"]).select("frame_id", "obj_id", "kpt_id", "obj_kpt_id", F.lit(0.1).alias("weight"))
    if fixed is not None:  # a keypoint that is fixed to one object is out for all others
        pairs = pairs.join(fixed.select("frame_id", "kpt_id"), ["frame_id", "kpt_id"], "left_anti").unionByName(fixed)
    pairs = match.order_for_sampling(pairs, visible)
    at = pairs.join(points.select("frame_id", "kpt_id", F.col("u").alias("fx"), F.col("v").alias("fy")), ["frame_id", "kpt_id"])
    at = at.join(objects.select("obj_id", "obj_kpt_id", F.col("x").alias("ox"), F.col("y").alias("oy")), ["obj_id", "obj_kpt_id"])
    return checkpointed(match.verify_homography(at))


def track_objects(points: DataFrame, objects: DataFrame, k: int = 3) -> DataFrame:
    """frame_id, obj_id, support, h of the objects seen on each frame.

    `points` are (frame_id, kpt_id, prev_kpt_id, u, v, word), `objects` (obj_id, obj_kpt_id, word, x, y). A first
    pass finds objects on every frame by itself; a second one adds the objects of the frame before as candidates and
    keeps a keypoint's match from its predecessor. Both passes take all frames at once, so a long video is no chain
    of jobs; a match is thereby handed on over one frame, and found anew from then on.
    """
    db = histo.histograms(objects.withColumnRenamed("obj_id", "cid"), "cid")
    scores = retrieve.query_scores(histo.histograms(points.withColumnRenamed("frame_id", "query_id"), "query_id"), db)
    scores = checkpointed(scores.select(F.col("query_id").alias("frame_id"), F.col("cid").alias("obj_id"), "score"))
    none = scores.select("frame_id", "obj_id").limit(0)
    first = _verified(points, objects, match.candidates(none, scores, k), None, none)
    before = first.select((F.col("frame_id") + 1).alias("frame_id"), "obj_id")
    owner = first.select("obj_id", F.explode("kpts").alias("prev_kpt_id")).join(points.select(F.col("kpt_id").alias("prev_kpt_id"), "word"), "prev_kpt_id")
    owner = owner.join(objects.select("obj_id", "word", "obj_kpt_id"), ["obj_id", "word"]).groupBy("prev_kpt_id").agg(F.min(F.struct("obj_id", "obj_kpt_id")).alias("o"))
    fixed = points.join(owner, "prev_kpt_id").select("frame_id", F.col("o.obj_id").alias("obj_id"), "kpt_id", F.col("o.obj_kpt_id").alias("obj_kpt_id"), F.lit(100.0).alias("weight"))
    return _verified(points, objects, match.candidates(before, scores, k), fixed, before).select("frame_id", "obj_id", "support", "h")


@query("g15_track_objects")
def g15(spark, sf):
    """Days as objects made of their events; each is shown on two frames, moved by a map of the day's."""
    p = keypoints(spark, sf).withColumn("day", F.floor(F.col("us") / 86400000000))
    objects = p.select(F.col("day").alias("obj_id"), F.col("kpt_id").alias("obj_kpt_id"), (F.col("kpt_id") + 1).alias("word"), F.col("u").alias("x"), F.col("v").alias("y"))
    x, y = geometry.apply_homography(F.col("h"), F.col("u"), F.col("v"))
    shown = maps(p, "day").withColumn("i", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        (F.col("day") * 3 + F.col("i")).alias("frame_id"), (F.col("kpt_id") * 2 + F.col("i")).alias("kpt_id"),
        F.when(F.col("i") == 1, F.col("kpt_id") * 2).alias("prev_kpt_id"), (x + 5 * F.col("i")).alias("u"), y.alias("v"), (F.col("kpt_id") + 1).alias("word"),
    )
    return track_objects(shown, objects)


@query("g15_follow_objects")
def g15_followed(spark, sf):
    """Days as objects made of their events, each shown on six frames of one of 32 videos, moved by a map of the day's; words
    are seen on the first two of the frames, then tracks alone carry it. Every third object is verified as a solid one."""
    p = keypoints(spark, sf).withColumn("day", F.floor(F.col("us") / 86400000000))
    objects = p.select(
        F.col("day").alias("obj_id"), F.col("kpt_id").alias("obj_kpt_id"), (F.col("kpt_id") + 1).alias("word"), F.col("u").alias("x"), F.col("v").alias("y"),
        F.when(F.col("day") % 3 == 0, follow.SOLID).otherwise(0).alias("flags"),
    )
    x, y = geometry.apply_homography(F.col("h"), F.col("u"), F.col("v"))
    shown = maps(p, "day").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(5)))).select(
        (F.col("day") % 32).alias("video_id"), (F.col("day") * 6 + F.col("i")).alias("frame_id"), (F.col("kpt_id") * 6 + F.col("i")).alias("kpt_id"),
        F.col("kpt_id").alias("track_id"), (x + 5 * F.col("i")).alias("u"), (y + 2 * F.col("i")).alias("v"), F.when(F.col("i") < 2, F.col("kpt_id") + 1).otherwise(0).alias("word"),
    )
    words = objects.select("word", F.lit(1.0).alias("idf"))
    return follow.follow_objects(follow.correspondences(shown, objects, words)).drop("h", "kpts")


@query("g13_incremental_learning", f"""with {K}, p as (select track_id, track_id % 5 as obj_id, cast(floor(us / 86400000000) as bigint) as frame_id, u, v from pts where word <> 0),
a as (select *, avg(u) over w as ox, avg(v) over w as oy from p window w as (partition by track_id)),
g as (select obj_id, track_id, any_value(ox) as ox, any_value(oy) as oy, count(*) as n, bool_and(pow(u - ox, 2) + pow(v - oy, 2) <= 160000 and (frame_id + obj_id) % 29 <> 0) as ok from a group by 1, 2)
select obj_id, track_id, round(ox, 6) as ox, round(oy, 6) as oy, n from g where ok and n >= 5""")
def g13(spark, sf):
    """Objects lie still, and are missing on some days."""
    p = keypoints(spark, sf).withColumn("frame_id", F.floor(F.col("us") / 86400000000)).withColumn("cid", F.col("word"))
    still = F.array(*(F.lit(float(x)) for x in (1, 0, 0, 0, 1, 0, 0, 0, 1)))
    days = p.select("frame_id").distinct().withColumn("obj_id", F.explode(F.array(*(F.lit(i).cast("long") for i in range(5)))))
    there = days.where("(frame_id + obj_id) % 29 <> 0").withColumns({"h": still, "h_inv": still})
    near = p.select("track_id", (F.col("track_id") % 5).alias("obj_id")).distinct()
    return rounded(match.learn_points(p.select("frame_id", "kpt_id", "track_id", "u", "v", "cid"), near, there, threshold=400.0), "ox", "oy")
