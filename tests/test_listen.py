"""Code called for each track."""

import pytest
from vistrack.operators import listen, track

SCHEMA = "track_id long, call string, frame_id long, nth int"


def calls():
    """A class that travels with the query: executors do not know this file."""

    class Calls(listen.Listener):
        def __init__(self):
            self.n = 0

        def point_added(self, point):
            self.n += 1
            yield point["track_id"], "added", point["frame_id"], self.n

        def point_removed(self, point):
            yield point["track_id"], "removed", point["frame_id"], self.n

    return Calls


def test_calls_come_in_order_and_once(spark):
    rows = [(v, t, f, 1000 * v + 100 * (t or 0) + f) for v in (0, 1) for t in (None, 1, 2, 3) for f in range(5 + (t or 0))]
    p = spark.createDataFrame(rows, "video_id long, track_id long, frame_id long, kpt_id long").repartition(7)
    got = [tuple(r) for r in listen.listen(p, calls(), SCHEMA).collect()]
    want = [(t, "added", f, f + 1) for v, t, f, _ in rows] + [(t, "removed", 4 + (t or 0), 5 + (t or 0)) for _ in (0, 1) for t in (None, 1, 2, 3)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert listen.listen(p.limit(0), calls(), SCHEMA).count() == 0
    with pytest.raises(Exception, match="points lack"):
        listen.listen(p.drop("frame_id"), calls(), SCHEMA)


def test_predicates(spark):
    p = spark.createDataFrame([(0, t, f, 10 * t + f, w) for t, f, w in ((1, 1, 0), (1, 2, 0), (2, 1, 5), (2, 2, 5), (3, 9, 5))], "video_id long, track_id long, frame_id long, kpt_id long, word long")
    assert {r.track_id for r in track.lost_tracks(p, 2).collect()} == {1, 2}
    assert {r.track_id for r in track.lost_tracks(p, 2, p.word != 0).collect()} == {2}
    assert {r.track_id for r in track.remove_unmatched(p, 2).collect()} == {3}
    assert {r.track_id for r in track.remove_unmatched(p, 2, p.word != 0).collect()} == {1, 3}
