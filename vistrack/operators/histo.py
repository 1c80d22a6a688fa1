"""Visual-word histograms as long rows (cid, word, cnt), their inverted index and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def assign_track_ids(packets: DataFrame, drop_last: bool = False) -> DataFrame:
    """Adds track_id: the running count of start markers (ptr = -1) in file order, from 1 in each source.

    Packets before the first marker are track 0. `drop_last` leaves out the last track of each source, as a reader
    that adds a track only at the next marker does.
    """
    by_file = Window.partitionBy("source").orderBy("packet_no").rowsBetween(Window.unboundedPreceding, 0)
    out = packets.withColumn("track_id", F.sum((F.col("ptr") == -1).cast("long")).over(by_file))
    if drop_last:
        last = F.max("track_id").over(Window.partitionBy("source"))
        out = out.withColumn("__last", last).where("track_id < __last").drop("__last")
    return out


def histograms(rows: DataFrame, *keys: str, word: str = "word", into: str = "word") -> DataFrame:
    """keys, `into`, cnt: how often each key has each valid (non-zero) word."""
    return rows.where(F.col(word) != 0).groupBy(*keys, F.col(word).alias(into)).agg(F.count("*").alias("cnt"))


def soft_histograms(keypoints: DataFrame, ranked: DataFrame, frame: str = "frame_id") -> DataFrame:
    """frame, word, cnt: every keypoint adds each cid that its track's ranked list (track_id, cid) names."""
    return keypoints.join(ranked.select("track_id", "cid"), "track_id").groupBy(frame, F.col("cid").alias("word")).agg(F.count("*").alias("cnt"))


def update_histograms(base: DataFrame, deltas: DataFrame) -> DataFrame:
    """Signed increments on (cid, word); bins that fall to zero or below go."""
    both = base.select("cid", "word", "cnt").unionByName(deltas.select("cid", "word", "cnt"))
    return both.groupBy("cid", "word").agg(F.sum("cnt").alias("cnt")).where("cnt > 0")


def merge_histograms(h: DataFrame, into: DataFrame) -> DataFrame:
    """Adds the bins of each `old` cid of `into` (old, new) to its `new` cid and drops the old one."""
    return (
        h.join(into, h["cid"] == into["old"], "left")
        .groupBy(F.coalesce("new", "cid").alias("cid"), "word")
        .agg(F.sum("cnt").alias("cnt"))
    )


def totals(h: DataFrame) -> DataFrame:
    return h.groupBy("cid").agg(F.sum("cnt").alias("total"))


def frequencies(asked: DataFrame, h: DataFrame) -> DataFrame:
    """cid, word, freq, proba of the asked (cid, word): 0 where the bin is absent; null share for an unknown cid."""
    got = asked.join(h, ["cid", "word"], "left").join(totals(h), "cid", "left")
    freq = F.coalesce("cnt", F.lit(0))
    return got.select("cid", "word", freq.cast("long").alias("freq"), (freq / F.col("total")).alias("proba"))


def inverted_index(h: DataFrame) -> DataFrame:
    """word, postings: clusters with their counts, by cid."""
    return h.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("cid", "cnt"))).alias("postings"))


def idf(h: DataFrame) -> DataFrame:
    """word, df, idf: ln of the whole number of clusters per cluster with the word; 1 with fewer than two clusters."""
    n = h.select("cid").distinct().agg(F.count("*").alias("clusters"))
    each = h.groupBy("word").agg(F.count("*").alias("df"))
    return each.join(F.broadcast(n)).select(
        "word", "df", F.when(F.col("clusters") < 2, 1.0).otherwise(F.log(F.floor(F.col("clusters") / F.col("df")).cast("double"))).alias("idf")
    )


def weighted_sums(h: DataFrame, weights: DataFrame | None = None, binary: bool = False) -> DataFrame:
    """cid, weighted_sum: counts (or 1 with `binary`) times idf if given; the plain total with neither."""
    x = F.lit(1.0) if binary else F.col("cnt").cast("double")
    if weights is not None:
        h, x = h.join(weights.select("word", "idf"), "word"), x * F.col("idf")
    return h.groupBy("cid").agg(F.sum(x).alias("weighted_sum"))


def best_cluster_per_word(h: DataFrame) -> DataFrame:
    """word, cid, cnt: the cluster with most of the word; ties to the smaller cid."""
    return h.groupBy("word").agg(F.max(F.struct("cnt", (-F.col("cid")).alias("c"))).alias("b")).select("word", (-F.col("b.c")).alias("cid"), F.col("b.cnt").alias("cnt"))


def ambiguity(h: DataFrame, least: float = 0.1) -> DataFrame:
    """word, clusters, strong: how many clusters have the word, and how many with more than `least` of their total."""
    share = h.join(totals(h), "cid").withColumn("p", F.col("cnt") / F.col("total"))
    return share.groupBy("word").agg(F.count("*").alias("clusters"), F.sum((F.col("p") > least).cast("long")).alias("strong"))


def ambiguity_summary(h: DataFrame) -> DataFrame:
    """words, unique_words, clusters of the whole collection."""
    per = h.groupBy("word").agg(F.count("*").alias("n"))
    n = h.agg(F.countDistinct("cid").alias("clusters"))
    return per.agg(F.count("*").alias("words"), F.sum((F.col("n") == 1).cast("long")).alias("unique_words")).join(F.broadcast(n))


def shares(h: DataFrame) -> DataFrame:
    """cid, word, cnt, share of the cluster's total."""
    return h.join(totals(h), "cid").select("cid", "word", "cnt", (F.col("cnt") / F.col("total")).alias("share"))


def word_listing(points: DataFrame, min_length: int = 10) -> DataFrame:
    """word, track_id, n for tracks of at least `min_length` points, with a total row (null track) for each word."""
    long_ = points.groupBy("track_id").count().where(F.col("count") >= min_length).select("track_id")
    return points.join(long_, "track_id", "left_semi").where("word <> 0").rollup("word", "track_id").agg(F.count("*").alias("n")).where("word is not null")


def is_valid(c: Column) -> Column:
    """Word and cluster id 0 mean none."""
    return c.isNotNull() & (c != 0)
