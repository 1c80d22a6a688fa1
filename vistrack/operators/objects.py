"""The object database: objects, their keypoints, images and annotations as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import histo
from .numbering import numbered


def create_objects(objects: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """`objects` (obj_id, comment, flags) with the rows of `new` (comment, flags) appended under the next ids.

    """
    top = objects.agg(F.coalesce(F.max("obj_id"), F.lit(0)).alias("top"))
    ids = numbered(new, [], [order], "n", start=1).join(F.broadcast(top))
    return objects.unionByName(ids.select((F.col("top") + F.col("n")).alias("obj_id"), "comment", "flags"))


def frame_keypoints(points: DataFrame, with_clusters: bool = True) -> DataFrame:
    """A frame's keypoints as an object stores them: those with a cid, or with the word as cid without clusters."""
    cid = F.col("cid" if with_clusters else "word")
    return points.withColumn("cid", cid).where(histo.is_valid(F.col("cid")))


def added_keypoints(points: DataFrame, with_clusters: bool = True) -> DataFrame:
    """obj_id, img_id, kpt_id, cid, u, v of the points of frames (obj_id, img_id) that are added to objects. The image
    itself goes to the table of images, its counts to the objects' histograms."""
    return frame_keypoints(points, with_clusters).select("obj_id", "img_id", "kpt_id", "cid", "u", "v")


def added_counts(keypoints: DataFrame) -> DataFrame:
    """cid, word, cnt: what keypoints add to the histograms of their objects, for `histo.update_histograms`."""
    return keypoints.groupBy(F.col("obj_id").alias("cid"), F.col("cid").alias("word")).agg(F.count("*").alias("cnt"))


def train_from_video(points: DataFrame, obj: str = "video_id") -> tuple[DataFrame, DataFrame]:
    """One object per video: (obj_id, frame_id of the latest frame) and the histogram of all its keypoints."""
    image = points.groupBy(F.col(obj).alias("obj_id")).agg(F.max("frame_id").alias("frame_id"))
    return image, histo.histograms(points.withColumnRenamed(obj, "obj_id"), "obj_id", word="cid", into="cid")


def remove_objects(table: DataFrame, ids: DataFrame, column: str = "obj_id") -> DataFrame:
    """Any table of the database without the rows of the objects in `ids` (obj_id)."""
    return table.join(ids.select(F.col("obj_id").alias("__id")), F.col(column) == F.col("__id"), "left_anti")


def images_of(keypoints: DataFrame) -> DataFrame:
    return keypoints.select("obj_id", "img_id").distinct()


def find(keypoints: DataFrame, asked: DataFrame) -> DataFrame:
    """The object keypoints with the asked (obj_id, cid)."""
    return keypoints.join(asked.select("obj_id", "cid").distinct(), ["obj_id", "cid"])


def load_database(objects: DataFrame, keypoints: DataFrame, annotations: DataFrame) -> DataFrame:
    """obj_id, comment, flags, bins, points, img_id, notes: an object with the size of its histogram, the image of
    its last keypoint, and its number of annotations; objects without keypoints stay."""
    h = keypoints.groupBy("obj_id").agg(F.countDistinct("cid").alias("bins"), F.count("*").alias("points"), F.max(F.struct("kpt_id", "img_id"))["img_id"].alias("img_id"))
    notes = annotations.groupBy(F.col("obj").alias("obj_id")).agg(F.count("*").alias("notes"))
    out = objects.join(h, "obj_id", "left").join(notes, "obj_id", "left")
    return out.select("obj_id", "comment", "flags", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("bins", "points")), "img_id", F.coalesce("notes", F.lit(0)).alias("notes"))


def frames_to_index(frames: DataFrame, misses: int = 10, points: int = 30) -> DataFrame:
    """The frames (video_id, frame_id, matched, n_long) to make objects of: more than `misses` frames in a row without
    a match up to here, and at least `points` keypoints on long tracks."""
    w = Window.partitionBy("video_id").orderBy("frame_id").rowsBetween(Window.unboundedPreceding, 0)
    hits = frames.withColumn("island", F.sum(F.col("matched").cast("long")).over(w))
    run = Window.partitionBy("video_id", "island").orderBy("frame_id").rowsBetween(Window.unboundedPreceding, 0)
    missed = F.sum((~F.col("matched")).cast("long")).over(run)
    return hits.withColumn("missed", missed).where((F.col("missed") > misses) & (F.col("n_long") >= points)).drop("island")


def pack_key(cid: Column, word: Column) -> Column:
    """Cluster and word as one 64-bit key."""
    return F.shiftleft(cid.cast("long"), 32).bitwiseOR(word.cast("long"))


def unpack_key(key: Column) -> tuple[Column, Column]:
    return F.shiftright(key, 32), key.bitwiseAND(F.lit(0xFFFFFFFF))


def union_inputs(*collections: DataFrame) -> DataFrame:
    """Histograms (cid, word, cnt) of several sources as one collection with cids renumbered 1..n by source and cid.

    The distinct ids are numbered by ranges in many tasks, and the numbers joined back.
    """
    all_ = None
    for k, c in enumerate(collections):
        part = c.select(F.lit(k).alias("source"), "cid", "word", "cnt")
        all_ = part if all_ is None else all_.unionByName(part)
    ids = numbered(all_.select("source", "cid").distinct(), [], ["source", "cid"], "new", start=1)
    return all_.join(ids, ["source", "cid"]).select(F.col("new").alias("cid"), "word", "cnt")
