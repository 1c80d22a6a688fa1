"""Following objects over a stream of correspondences, with the memory of each video in keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.follow import COLUMNS, INSTANCES, ROWS, Memory, step


#: A waiting row's columns, and how each is held: pandas turns whole numbers beside nulls into floats, which a state's long
#: does not take.
KINDS = {c: float if t == "double" else int for c, t in (x.split() for x in f"ms long, {ROWS}".split(", "))}


def _plain(rows: pd.DataFrame) -> list[tuple]:
    return [tuple(None if pd.isna(v) else kind(v) for v, kind in zip(r, KINDS.values())) for r in rows[list(KINDS)].itertuples(index=False, name=None)]


class Follower(StatefulProcessor):
    """Holds rows until the watermark has passed their frame, then takes the frames in order. Rows of frames that are done
    are dropped; rows sent again count once."""

    def __init__(self, k: int, most: int, keep: int):
        self.limits = (k, most, keep)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"ms long, {ROWS}")
        self.frame = handle.getValueState("frame", "frame long")
        self.seen = handle.getListState("seen", "obj_id long, since long, flags int")
        self.tracks = handle.getListState("tracks", "track_id long, obj_id long, obj_kpt_id long, ox double, oy double, flags int, frame long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.frame.get()[0] if self.frame.exists() else None
        for f in rows:
            f = f if last is None else f[f["frame_id"] > last]
            if len(f):
                self.waiting.appendList(_plain(f))
                for ms in f["ms"].unique():
                    self.handle.registerTimer(int(ms))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        rows = pd.DataFrame(list(self.waiting.get()), columns=list(KINDS))
        ready, wait = rows[rows["ms"] <= until], rows[rows["ms"] > until]
        memory, out = self._memory(), []
        for frame, f in ready.groupby("frame_id", sort=True):
            if memory.frame is None or frame > memory.frame:
                got, memory = step(memory, int(frame), f.astype({c: float for c in ("track_id", "obj_id", "obj_kpt_id", "ox", "oy", "weight", "gain", "flags")}), *self.limits)
                out += [(int(key[0]), int(frame), *g) for g in got]
        self._keep(memory)
        self.waiting.clear()
        if len(wait):
            self.waiting.put(_plain(wait))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in INSTANCES.split(", ")]) if out else pd.DataFrame()

    def _memory(self) -> Memory:
        if not self.frame.exists():
            return Memory()
        return Memory(self.frame.get()[0], {o: (s, g) for o, s, g in self.seen.get()}, {t: tuple(m) for t, *m in self.tracks.get()})

    def _keep(self, m: Memory) -> None:
        if m.frame is None:
            return
        self.frame.update((m.frame,))
        for state, rows in ((self.seen, [(o, *s) for o, s in m.seen.items()]), (self.tracks, [(t, *x) for t, x in m.tracks.items()])):
            state.clear()
            if rows:
                state.put(rows)

    def close(self) -> None:
        pass


def follow_objects(rows: DataFrame, k: int = 3, most: int = 16, keep: int = 512, late: str = "10 seconds") -> DataFrame:
    """INSTANCES of operators.follow.follow_objects() from a stream of correspondences() that hold ts, the time of the
    frame. A frame is taken once the watermark has passed it. State per video is what waits, and the memory."""
    at = rows.where("video_id is not null and frame_id is not null and kpt_id is not null").withWatermark("ts", late)
    at = at.select("video_id", F.unix_millis("ts").alias("ms"), "ts", *COLUMNS)
    return at.groupBy("video_id").transformWithStateInPandas(Follower(k, most, keep), INSTANCES, "Append", "EventTime")
