"""Retrieval accuracy against a truth script, and statistics of words along tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def truth_as_of(frames: DataFrame, truth: DataFrame, key: str = "video_id") -> DataFrame:
    """Adds truth: the arg of the last check (key, frame_id, arg) with a frame strictly before; null if none.

    One union and a running window per key: frames come before checks of the same number.
    """
    f = frames.select(key, "frame_id", F.lit(None).cast("string").alias("arg"), F.lit(0).alias("q"))
    t = truth.select(key, "frame_id", F.col("arg").cast("string").alias("arg"), F.lit(1).alias("q"))
    w = Window.partitionBy(key).orderBy("frame_id", "q").rowsBetween(Window.unboundedPreceding, 0)
    at = f.unionByName(t).withColumn("truth", F.last("arg", ignorenulls=True).over(w))
    return at.where("q = 0").select(key, "frame_id", "truth")


def named(c: Column) -> Column:
    """`none` and the empty name mean that there is nothing."""
    return F.when(c.isin("none", ""), None).otherwise(c)


def retrieval_accuracy(results: DataFrame) -> DataFrame:
    """frames, success, true_negative, false_positive, false_negative, ratio of (found, truth)."""
    hit, true = named(F.col("found")), named(F.col("truth"))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    ok = F.coalesce(hit == true, F.lit(False)) | (hit.isNull() & true.isNull())
    return results.agg(
        F.count("*").alias("frames"), n(ok).alias("success"), n(hit.isNull() & true.isNull()).alias("true_negative"),
        n(hit.isNotNull() & true.isNull()).alias("false_positive"), n(hit.isNull() & true.isNotNull()).alias("false_negative"),
        F.avg(ok.cast("double")).alias("ratio"),
    )


def time_by_feature_count(frames: DataFrame, width: int = 20) -> DataFrame:
    """bin, frames, mean_ms: processing time by the number of points in steps of `width`."""
    return frames.groupBy(F.floor(F.col("n_points") / width).alias("bin")).agg(F.count("*").alias("frames"), F.avg("ms").alias("mean_ms"))


def word_pairs(points: DataFrame) -> DataFrame:
    """word, previous of each point that follows another on its track."""
    w = Window.partitionBy("track_id").orderBy("frame_id", "kpt_id")
    return points.withColumn("previous", F.lag("word").over(w)).where("previous is not null").select("word", "previous")


def word_affinity(points: DataFrame) -> DataFrame:
    return word_pairs(points).groupBy("word", "previous").agg(F.count("*").alias("n"))


def word_stability(points: DataFrame) -> DataFrame:
    """word, good, bad, percent: pairs that keep the word, and pairs that change it, counted for both words.

    Counts per pair of words come first, so what is taken apart is no larger than the square of the vocabulary.
    """
    pairs = word_affinity(points)
    same = pairs.where("word = previous").select("word", F.col("n").alias("good"), F.lit(0).cast("long").alias("bad"))
    other = pairs.where("word <> previous").select(F.explode(F.array("word", "previous")).alias("word"), F.lit(0).cast("long").alias("good"), F.col("n").alias("bad"))
    out = same.unionByName(other).groupBy("word").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    return out.withColumn("percent", 100.0 * F.col("good") / (F.col("good") + F.col("bad")))


def accept_by_threshold(results: DataFrame, threshold: float, score: str = "coverage") -> DataFrame:
    """Adds accepted: the found entry where its score reaches the threshold, else null."""
    return results.withColumn("accepted", F.when(F.col(score) >= threshold, F.col("found")))
