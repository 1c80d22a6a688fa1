"""Smoothed and filtered poses of a stream, with the last state of each object kept (E7, E8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import events, scan

STATES = "obj_id long, frame_id long, x array<double>"


class Running(StatefulProcessor):
    """Holds measurements until the watermark has passed their frame, then takes the frames in order, by the maps of
    `operators.scan`: a session goes on if its last row is of the frame before."""

    def __init__(self, maps: scan.Maps, parts: int, size: int):
        self.maps, self.shape = maps, (parts, size)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms long, frame long, z array<double>")
        self.last = handle.getValueState("last", "frame long, k long, x array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done = self.last.get()[0] if self.last.exists() else None
        for f in rows:
            new = [(int(ms), int(n), [float(v) for v in z]) for ms, n, z in zip(f["ms"], f["frame_id"], f["z"]) if done is None or n > done]
            if new:
                self.waiting.appendList(new)
                for ms in {r[0] for r in new}:
                    self.handle.registerTimer(ms)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until, rows = expiredTimerInfo.getExpiryTimeInMs(), [(ms, n, list(z)) for ms, n, z in self.waiting.get()]
        frame, k, x = self.last.get() if self.last.exists() else (None, 0, [])
        ready = sorted({(n, *z) for ms, n, z in rows if ms <= until and (frame is None or n > frame)})  # rows sent again count once
        wait = [r for r in rows if r[0] > until]
        self.waiting.clear()
        if wait:
            self.waiting.put(wait)
        if not ready:
            yield pd.DataFrame()
            return
        frames, z = np.array([r[0] for r in ready]), np.array([r[1:] for r in ready])
        goes_on = frame is not None and frames[0] - frame <= 1
        fresh = np.r_[not goes_on, np.diff(frames) > 1]
        session, at = np.cumsum(fresh), np.arange(len(frames))
        begun = np.maximum.accumulate(np.where(fresh, at, -1))
        places = np.where(begun < 0, at + k + 1, at - begun)
        a, b = scan.compose(*self.maps(places, z), session)
        state = b + np.einsum("nkij,kj->nki", a, np.array(x).reshape(self.shape)) * (begun < 0)[:, None, None] if goes_on else b
        self.last.update((int(frames[-1]), int(places[-1]), state[-1].ravel().tolist()))
        yield pd.DataFrame({"obj_id": int(key[0]), "frame_id": frames, "x": [s.ravel().tolist() for s in state]})

    def close(self) -> None:
        pass


def _running(poses: DataFrame, z: Column, maps: scan.Maps, parts: int, size: int, late: str) -> DataFrame:
    at = poses.withColumn("z", z).where("obj_id is not null and frame_id is not null").where(~F.exists("z", F.isnull))
    at = at.withWatermark("ts", late).select("obj_id", "frame_id", "ts", F.unix_millis("ts").alias("ms"), "z")
    return at.groupBy("obj_id").transformWithStateInPandas(Running(maps, parts, size), STATES, "Append", "EventTime")


def smoothed(poses: DataFrame, columns: list[str], alpha: float = 0.4, late: str = "10 seconds") -> DataFrame:
    """obj_id, frame_id and {column}_smooth of operators.events.smoothed(), from a stream that holds ts, the time of the
    frame. A frame is taken once the watermark has passed it; rows of frames that are done, and rows sent again, are
    dropped; rows with a null among the columns have no result. State per object is what waits, and one row."""
    z = F.array(*(F.col(c).cast("double") for c in columns))
    out = _running(poses, z, events.smoothing_maps(alpha), len(columns), 1, late)
    return out.select("obj_id", "frame_id", *(F.col("x")[i].alias(f"{c}_smooth") for i, c in enumerate(columns)))


def kalman(poses: DataFrame, corrected: bool = False, late: str = "10 seconds") -> DataFrame:
    """obj_id, frame_id, x of operators.events.kalman(), from a stream, as in smoothed()."""
    z = F.array(*(F.col("pose")[i] for i in range(6)))
    out = _running(poses, z, events.kalman_maps(), 6, 3, late)
    return out.select("obj_id", "frame_id", F.array(*(F.col("x")[3 * i + (0 if corrected else 2)] for i in range(6))).alias("x"))
