"""Following objects through videos, frame by frame, with what was seen before kept per video.

Correspondences are joins of all frames at once. What depends on the frames before is a small memory per video: the
objects in view with their age, and which track lies on which point of which object. `step` takes one frame and the
memory to its instances and the next memory; follow_objects() runs it over sorted frames, streaming.follow over a stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import match

#: Objects with this flag are not flat: they are verified by a fundamental matrix.
SOLID = 2
INSTANCES = "video_id long, frame_id long, obj_id long, support int, age int, tracked int, h array<double>, kpts array<long>"
#: What a frame's rows hold: a keypoint, and one of the object's keypoints that it may be, or nulls.
ROWS = "frame_id long, kpt_id long, track_id long, u double, v double, obj_id long, obj_kpt_id long, ox double, oy double, weight double, gain double, flags int"
COLUMNS = [c.split()[0] for c in ROWS.split(", ")]
PAIR = ["obj_id", "obj_kpt_id", "ox", "oy", "weight", "gain", "flags"]


@dataclass
class Memory:
    """A video's last frame; obj_id -> (first frame of this appearance, flags) of the objects in view there; and
    track_id -> (obj_id, obj_kpt_id, ox, oy, flags, last frame on which it was verified)."""

    frame: int | None = None
    seen: dict[int, tuple] = field(default_factory=dict)
    tracks: dict[int, tuple] = field(default_factory=dict)


def correspondences(points: DataFrame, objects: DataFrame, words: DataFrame, cids: DataFrame | None = None, weight: float = 0.1) -> DataFrame:
    """ROWS for each point (video_id, frame_id, kpt_id, track_id, u, v, word, and `ranked`, an array of (cid, score) of
    its track, if `cids` are given) and what else it holds; a point without a pair has one row with nulls.

    `objects` are (obj_id, obj_kpt_id, word, x, y, flags and, with `cids`, cid), `words` (word, idf) and `cids` (cid, idf).
    Words and clusters without weight leave before the join. No row depends on another, so points may be a stream.
    """
    size = objects.groupBy("obj_id").agg(F.count("*").alias("size"))
    o = objects.join(size, "obj_id").withColumnsRenamed({"x": "ox", "y": "oy"})
    pair = [c for c in PAIR if c not in ("weight", "gain")]
    by_word = o.where("word <> 0").join(words.where("idf > 0"), "word").select("word", *pair, F.lit(weight).alias("weight"), (F.col("idf") / F.col("size")).alias("gain"))
    keep = [c for c in points.columns if c not in ("word", "ranked")]
    out = points.join(by_word, "word", "left").select(*keep, *pair, "weight", "gain")
    if cids is not None:
        by_cid = o.join(cids.where("idf > 0"), "cid").select("cid", *pair, "idf")
        at = points.select(*keep, F.inline("ranked")).join(by_cid, "cid")
        out = out.unionByName(at.select(*keep, *pair, (F.col("score") * F.col("idf")).alias("weight"), F.lit(0.0).alias("gain")))
    return out.withColumn("flags", F.col("flags").cast("int"))


def step(memory: Memory, frame: int, rows: pd.DataFrame, k: int = 3, most: int = 16, keep: int = 512) -> tuple[list[tuple], Memory]:
    """The frame's instances (obj_id, support, age, tracked, h, kpts), and the memory after it.

    A point whose track lies on an object is that object's alone, with weight 100. Candidates are the objects in view
    on the frame before, then the k + (number of these) best by score; each is verified by its tracked pairs and those
    by word and cluster, if it is among the `k` + `most` best, and claims its inliers before the next. At most `most` objects are in view. A tracked point
    that is no inlier of its object on view is let go; tracks of an object that isn't found are kept for `keep` frames.
    """
    same = ["kpt_id", "obj_id", "obj_kpt_id"]
    scores = rows[rows["gain"] > 0].drop_duplicates(same).groupby("obj_id")["gain"].sum().reset_index().sort_values(["gain", "obj_id"], ascending=[False, True])
    rows = rows.sort_values("weight", ascending=False, kind="stable").drop_duplicates(same)
    points = rows.drop_duplicates("kpt_id").sort_values("kpt_id")
    tracks = {t: m for t, m in memory.tracks.items() if frame - m[5] <= keep}
    before = memory.seen if memory.frame is not None and frame - memory.frame == 1 else {}
    own = points[points["track_id"].isin(list(tracks))]
    fixed = pd.DataFrame([(*p, *tracks[p[1]][:4], 100.0, tracks[p[1]][4]) for p in own[["kpt_id", "track_id", "u", "v"]].itertuples(index=False, name=None)],
                         columns=["kpt_id", "track_id", "u", "v", "obj_id", "obj_kpt_id", "ox", "oy", "weight", "flags"])
    free = rows[rows["obj_id"].isin(scores["obj_id"].head(k + most)) & ~rows["kpt_id"].isin(fixed["kpt_id"])]
    order = [*before, *(int(o) for o in scores["obj_id"].head(k + len(before)) if int(o) not in before)]
    pairs = pd.concat([fixed, free[fixed.columns]]) if len(fixed) else free[list(fixed.columns)]
    claimed, out, seen, gone = set(), [], {}, set()
    for obj in order:
        if len(out) == most:
            break
        f = pairs[(pairs["obj_id"] == obj) & ~pairs["kpt_id"].isin(claimed)].sort_values(["weight", "kpt_id", "obj_kpt_id"], ascending=[False, True, True])
        if f.empty:
            continue
        f = f.rename(columns={"u": "fx", "v": "fy"})
        flags = int(f["flags"].iloc[0]) if pd.notna(f["flags"].iloc[0]) else 0
        found = (match.fundamental_of if flags & SOLID else match.homography_of)(f, match.group_seed((frame, obj)))
        if found is None:
            continue
        h, inliers = found
        on = f[inliers].drop_duplicates("kpt_id")
        gone |= {t for t in f["track_id"][~inliers & (f["weight"] >= 100).to_numpy()]}
        for t, q, x, y in on[["track_id", "obj_kpt_id", "ox", "oy"]].itertuples(index=False, name=None):
            if pd.notna(t):
                tracks[int(t)] = (obj, int(q), float(x), float(y), flags, frame)
                gone.discard(t)
        claimed |= set(on["kpt_id"])
        seen[obj] = (before[obj][0] if obj in before else frame, flags)
        kpts = sorted(int(p) for p in on["kpt_id"])
        out.append((obj, len(kpts), frame - seen[obj][0], int((on["weight"] >= 100).sum()), (h.T if flags & SOLID else h).ravel().tolist(), kpts))
    return out, Memory(frame, seen, {t: m for t, m in tracks.items() if t not in gone})


def follow_objects(rows: DataFrame, k: int = 3, most: int = 16, keep: int = 512) -> DataFrame:
    """INSTANCES on every frame of every video, from correspondences(): the objects verified there, for how many frames
    each has been in view, how many of its points were carried over by their tracks, and its map (homography, or F
    transposed for objects with flag 2).

    Pairs of objects that a frame can't ask for go first: its k + `most` best by score. Videos are dealt to tasks and
    each task streams its frames in order, so it holds a frame and the memories of one video; rows without a video or
    frame take no part.
    """
    rows = rows.where("video_id is not null and frame_id is not null and kpt_id is not null").select("video_id", *COLUMNS)
    at = ["video_id", "frame_id"]
    scores = rows.where("gain > 0").groupBy(*at, "obj_id").agg(F.sum("gain").alias("score"))
    best = scores.groupBy(*at).agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "obj_id"))), 1, k + most).obj_id.alias("best"))
    near = rows.join(best, at, "left").withColumn("asked", F.array_contains("best", F.col("obj_id")))
    near = near.select("video_id", *(F.when(F.col("asked"), F.col(c)).alias(c) if c in PAIR else F.col(c) for c in COLUMNS))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video, memory, held = None, Memory(), None

        def settle(now: tuple, f: pd.DataFrame) -> pd.DataFrame:
            nonlocal video, memory
            if now[0] != video:
                video, memory = now[0], Memory()
            got, memory = step(memory, int(now[1]), f, k, most, keep)
            return pd.DataFrame([(*map(int, now), *g) for g in got], columns=[c.split()[0] for c in INSTANCES.split(", ")])

        for f in batches:
            f = f if held is None else pd.concat([held, f])
            parts = [(key, g) for key, g in f.groupby(["video_id", "frame_id"], sort=True)]
            for key, g in parts[:-1]:  # the last frame may go on in the next batch
                yield settle(key, g)
            held = parts[-1][1] if parts else held
        if held is not None:
            yield settle((held["video_id"].iloc[0], held["frame_id"].iloc[0]), held)

    return near.repartition("video_id").sortWithinPartitions(*at).mapInPandas(run, INSTANCES)
