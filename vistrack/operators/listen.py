"""Calling a user's code for each track: its points in order as they are added, then its end.

A listener is made anew for every track; Spark deals the tracks to tasks and sorts each one's points, so a listener
sees one point at a time and a track of any length is streamed through it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

#: What a track is, and how its points lie in it.
TRACK, ORDER = ("video_id", "track_id"), ("frame_id", "kpt_id")


class Listener:
    """What a track's code can do; both methods give rows (tuples), by default none."""

    def point_added(self, point: Row) -> Iterable[tuple]:
        return ()

    def point_removed(self, point: Row) -> Iterable[tuple]:
        """The track is over; called once, with its last point."""
        return ()


def register(spark: SparkSession, name: str, listener: Callable[[], Listener], schema: str) -> None:
    """Makes `listener` callable as `select * from name(table(points))`. Points hold TRACK and ORDER and what else the
    listener reads; those of one track without a video or an id are a track too. Rows follow `schema`."""
    rows = StructType.fromDDL(schema)

    class Tracks:
        def __init__(self):
            self._listener, self._last = None, None

        @staticmethod
        def analyze(points: AnalyzeArgument) -> AnalyzeResult:
            if not points.isTable:
                raise ValueError("give the points as table(...)")
            lacks = {*TRACK, *ORDER} - set(points.dataType.names)
            if lacks:
                raise ValueError(f"points lack {sorted(lacks)}")
            return AnalyzeResult(rows, partitionBy=[PartitioningColumn(c) for c in TRACK], orderBy=[OrderingColumn(c) for c in ORDER])

        def eval(self, point: Row) -> Iterator[tuple]:
            if self._listener is None:
                self._listener = listener()
            self._last = point
            yield from self._listener.point_added(point)

        def terminate(self) -> Iterator[tuple]:
            if self._listener is not None:
                yield from self._listener.point_removed(self._last)

    spark.udtf.register(name, udtf(Tracks))


def listen(points: DataFrame, listener: Callable[[], Listener], schema: str, name: str = "track_listener") -> DataFrame:
    """The rows that listeners of the tracks of `points` give."""
    register(points.sparkSession, name, listener, schema)
    return points.sparkSession.sql(f"select * from {name}(table({{points}}))", points=points)
