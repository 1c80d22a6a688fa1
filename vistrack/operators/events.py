"""Appearance events, speeds and poses of objects over time.

Detections are (obj_id, t, ...) with t in seconds (double) or any ordered number. All state is per object: windows
partition by object, and gaps cut an object's life into sessions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry
from . import scan


def _life(*order: str):
    return Window.partitionBy("obj_id").orderBy(*(order or ("t",)))


def with_sessions(detections: DataFrame, timeout: float, *order: str) -> DataFrame:
    """Adds session (from 1 for each object): a gap of more than `timeout` starts a new one."""
    w = _life(*order)
    gap = F.coalesce(F.col("t") - F.lag("t").over(w) > timeout, F.lit(True))
    at = detections.withColumn("__new", gap.cast("long"))
    return at.withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def visibility_sessions(detections: DataFrame, timeout: float, *order: str) -> DataFrame:
    """obj_id, session, start, end, n: the intervals between appearing and disappearing."""
    return with_sessions(detections, timeout, *order).groupBy("obj_id", "session").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("n"))


def appearance_events(detections: DataFrame, timeout: float, now: float | None = None) -> DataFrame:
    """obj_id, t, event: `moved` at each detection, `appeared` at the first and after a gap of more than `timeout`,
    `disappeared` once, `timeout` after the last detection of a session, if no later one or `now` comes sooner."""
    s = visibility_sessions(detections, timeout)
    up = s.select("obj_id", F.col("start").alias("t"), F.lit("appeared").alias("event"))
    moved = detections.select("obj_id", "t", F.lit("moved").alias("event"))
    gone = s.select("obj_id", (F.col("end") + timeout).alias("t"), F.lit("disappeared").alias("event"))
    return up.unionByName(moved).unionByName(gone if now is None else gone.where(F.col("t") < now))


def since_last(asked: DataFrame, detections: DataFrame, timeout: float) -> DataFrame:
    """asked (obj_id, t) with since_seen and since_appeared: time since the last detection, and since the last
    appearance, at or before t; -1 if never. A union and one running window, not a range join."""
    d = with_sessions(detections.select("obj_id", "t"), timeout)
    first = F.min("t").over(Window.partitionBy("obj_id", "session"))
    d = d.select("obj_id", "t", F.col("t").alias("seen"), first.alias("up"), F.lit(0).alias("q"))
    a = asked.select("obj_id", "t", *(F.lit(None).cast("double").alias(c) for c in ("seen", "up")), F.lit(1).alias("q"))
    w = _life("t", "q").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.coalesce(F.col("t") - F.last(c, ignorenulls=True).over(w), F.lit(-1.0))
    out = d.unionByName(a).withColumns({"since_seen": last("seen"), "since_appeared": last("up")})
    return out.where("q = 1").select("obj_id", "t", "since_seen", "since_appeared")


def speeds(detections: DataFrame, max_frames: int = 10, *order: str) -> DataFrame:
    """Adds vx, vy to (obj_id, frame_id, t, x, y): the move since the detection before, if at most `max_frames` back
    and at another time; else null."""
    w = _life(*(order or ("frame_id",)))
    near = (F.col("frame_id") - F.lag("frame_id").over(w) <= max_frames) & (F.col("t") > F.lag("t").over(w))
    v = lambda c: F.when(near, F.try_divide(F.col(c) - F.lag(c).over(w), F.col("t") - F.lag("t").over(w)))
    return detections.withColumns({"vx": v("x"), "vy": v("y")})


def target_speeds(detections: DataFrame, x: Column, y: Column, max_frames: int = 10, *order: str) -> DataFrame:
    """Adds px, py, vx, vy to (obj_id, frame_id, t, h): where the object's point (x, y) is on the frame by its map h, and
    how fast it moves there since the detection before, under that one's own map; limits as in speeds()."""
    px, py = geometry.apply_homography(F.col("h"), x, y)
    at = detections.withColumns({"px": px, "py": py})
    s = speeds(at.withColumns({"__x": F.col("px"), "__y": F.col("py")}).withColumnsRenamed({c: f"__{c}0" for c in ("x", "y") if c in at.columns}).withColumnsRenamed({"__x": "x", "__y": "y"}), max_frames, *order)
    return s.drop("x", "y").withColumnsRenamed({f"__{c}0": c for c in ("x", "y") if c in at.columns})


def motion_state(vx: Column, vy: Column, least: float = 150.0) -> Column:
    """right, left, down, up or none, in that order of precedence."""
    return F.when(vx > least, "right").when(vx < -least, "left").when(vy > least, "down").when(vy < -least, "up").otherwise("none")


def state_changes(rows: DataFrame, state: str = "state", *order: str) -> DataFrame:
    """The rows whose state differs from the one before (an object's first counts)."""
    before = F.lag(state).over(_life(*(order or ("frame_id",))))
    return rows.withColumn("before", before).where(~F.col(state).eqNullSafe(F.col("before")))


def smoothing_maps(alpha: float) -> scan.Maps:
    """A step is x -> (1 - alpha) x + alpha z for each number; a session starts with its measurement."""

    def maps(k: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = np.where(k == 0, 0.0, 1 - alpha)[:, None]
        return np.repeat(keep, z.shape[1], 1)[..., None, None], ((1 - keep) * z)[..., None]

    return maps


def smoothed(poses: DataFrame, columns: list[str], alpha: float = 0.4, chunk: int = scan.CHUNK) -> DataFrame:
    """Exponential smoothing of the columns per obj_id, started anew where the object was absent on the frame before.

    scan.affine_scan() composes the steps by chunks: a session may be of any length. A row with a null among the columns
    counts as an absence and has null results. Stream form: streaming.poses.smoothed().
    """
    out = scan.affine_scan(poses, columns, smoothing_maps(alpha), len(columns), 1, chunk)
    return out.withColumns({f"{c}_smooth": F.col("__x")[i] for i, c in enumerate(columns)}).drop("__x", "__k")


#: Noise of the filter: process noise of place and of speed, and measurement noise, for the first three pose numbers and the others.
NOISE = ((1e-7, 1.0, 1.0), (1.0, 1.0, 10.0))


def kalman_gains(place: float, speed: float, measured: float, most: int = 100_000) -> np.ndarray:
    """(n, 2): the gains of place and speed at each step of a constant-velocity filter that starts from covariance 1, up
    to the step from which they stay as they are. Gains depend on no measurement."""
    p, a, gains = np.eye(2), np.array([[1.0, 1.0], [0.0, 1.0]]), []
    for k in range(most):
        if k:
            p = a @ p @ a.T + np.diag([place, speed])
        g = p[:, 0] / (p[0, 0] + measured)
        p = p - np.outer(g, p[0])
        gains.append(g)
        if k > 1 and np.abs(gains[-1] - gains[-2]).max() < 1e-15:
            return np.array(gains)
    raise ValueError("the gains do not settle")


def kalman_maps() -> scan.Maps:
    """Maps of (place, speed, the place that was predicted) for each of six numbers. The numbers do not mix, and gains
    depend on the place in the session alone."""
    gains = [kalman_gains(*n) for n in NOISE]

    def maps(k: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        g = np.stack([gains[i >= 3][np.minimum(k, len(gains[i >= 3]) - 1)] for i in range(6)], 1)
        g[k == 0] = (1, 0)  # a session starts with its measurement, at rest
        a = np.zeros((*g.shape[:2], 3, 3))
        a[..., 0, :2], a[..., 1, 0], a[..., 1, 1], a[..., 2, :2] = (1 - g[..., :1]), -g[..., 1], 1 - g[..., 1], 1
        a[k == 0] = 0
        return a, np.stack([g[..., 0] * z, g[..., 1] * z, np.where(k[:, None] == 0, z, 0)], -1)

    return maps


def kalman(poses: DataFrame, corrected: bool = False, chunk: int = scan.CHUNK) -> DataFrame:
    """obj_id, frame_id, x (array of 6): a constant-velocity filter of the six numbers of `pose` over each obj_id's frames,
    started anew where the object was absent on the frame before.

    Emits the state predicted for each frame (a session's first frame: its measurement), or the corrected one. Noise is
    NOISE. A step is an affine map, and sessions are scanned by chunks. A pose that is null or holds a null is an absence,
    with null results. Stream form: streaming.poses.kalman().
    """
    numbers = [f"z{i}" for i in range(6)]
    rows = poses.select("obj_id", "frame_id", *(F.col("pose")[i].alias(c) for i, c in enumerate(numbers)))
    out = scan.affine_scan(rows, numbers, kalman_maps(), 6, 3, chunk)
    x = F.array(*(F.col("__x")[3 * i + (0 if corrected else 2)] for i in range(6)))
    return out.select("obj_id", "frame_id", F.when(F.col("__x").isNotNull(), x).alias("x"))


def windowed_counts(rows: DataFrame, t_us: Column, width_us: int = 500_000) -> DataFrame:
    """win (number of the tumbling window), n."""
    return rows.groupBy(F.floor(t_us / width_us).alias("win")).agg(F.count("*").alias("n"))
