"""The event layer over streams: sessions, counts and lost tracks with watermarks and keyed state.

Input streams have video_id, obj_id or track_id, and ts (timestamp). Late rows beyond the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def detections(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each (video_id, frame_id, obj_id) once; frames sent again within the watermark are dropped."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["video_id", "frame_id", "obj_id"])


def visibility_sessions(stream: DataFrame, timeout: str, late: str = "10 minutes") -> DataFrame:
    """obj_id, start, end, n: closed intervals of visibility, in append mode. A session window ends `timeout` after
    its last detection, so end is that less the timeout; gaps of exactly the timeout start a new one."""
    w = stream.withWatermark("ts", late).groupBy("obj_id", F.session_window("ts", timeout)).agg(F.count("*").alias("n"), F.max("ts").alias("end"))
    return w.select("obj_id", F.col("session_window.start").alias("start"), "end", "n")


def windowed_counts(stream: DataFrame, width: str = "500 milliseconds", late: str | None = "10 minutes") -> DataFrame:
    """start, n of tumbling windows; `late` is None for a stream that has its watermark, as detections() gives."""
    w = (stream.withWatermark("ts", late) if late else stream).groupBy(F.window("ts", width)).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "n")


def appearance_events(stream: DataFrame, timeout_ms: int, late: str = "10 minutes") -> DataFrame:
    """obj_id, ts, event: `appeared` and `moved` as rows come, `disappeared` by a timer when the watermark has passed
    the last detection by the timeout. State per object is one timestamp."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        if state.hasTimedOut:
            out.append((key[0], last + timeout_ms, "disappeared"))
            state.remove()
        else:
            rows = sorted(int(t) for f in frames for t in f["ms"])
            for t in rows:
                if last is not None and t - last > timeout_ms:
                    out.append((key[0], last + timeout_ms, "disappeared"))
                    last = None
                if last is None:
                    out.append((key[0], t, "appeared"))
                out.append((key[0], t, "moved"))
                last = t if last is None else max(last, t)
            state.update((last,))
            state.setTimeoutTimestamp(max(last + timeout_ms, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["obj_id", "t_ms", "event"])

    rows = stream.withWatermark("ts", late).select("obj_id", F.unix_millis("ts").alias("ms"), "ts")
    return rows.groupBy("obj_id").applyInPandasWithState(step, "obj_id long, t_ms long, event string", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def lost_tracks(stream: DataFrame, frames_back_ms: int, min_len: int = 4, retain: int = 512, late: str = "10 minutes") -> DataFrame:
    """video_id, track_id, n, words: a track is emitted and forgotten once the watermark has passed its last point by
    `frames_back_ms`, if it has `min_len` points. Only its last `retain` words are held."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n, words = state.get if state.exists else (0, 0, [])
        if state.hasTimedOut:
            state.remove()
            if n >= min_len:
                yield pd.DataFrame({"video_id": [key[0]], "track_id": [key[1]], "n": [n], "words": [list(words)]})
            return
        rows = pd.concat(list(frames)).sort_values("ms")
        words = [*words, *rows["word"].tolist()][-retain:]
        last, n = max(last, int(rows["ms"].max())), n + len(rows)
        state.update((last, n, words))
        state.setTimeoutTimestamp(max(last + frames_back_ms, state.getCurrentWatermarkMs() + 1))

    rows = stream.withWatermark("ts", late).select("video_id", "track_id", F.unix_millis("ts").alias("ms"), "ts", "word")
    return rows.groupBy("video_id", "track_id").applyInPandasWithState(
        step, "video_id long, track_id long, n long, words array<long>", "last long, n long, words array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )


def matched_pipeline(stream: DataFrame, sink, checkpoint: str):
    """The two-stage pipeline as micro-batches: `sink(batch, batch_id)` matches a batch's frames while Spark reads the
    next; available input is worked off and the query ends."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
