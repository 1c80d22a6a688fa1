"""Similarity, retrieval and ranking over histograms: equi-joins on the word, sums per pair, top-k windows.

A query side has (query_id, word, cnt), a collection (cid, word, cnt). Words with zero idf are dropped before the
join wherever idf counts: their products are zero and rows with zero scores are absent anyway.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import histo


def similarity_scores(q: DataFrame, c: DataFrame, norm: bool = True, weights: DataFrame | None = None) -> DataFrame:
    """query_id, cid, score: sum over shared words of the two weights; a query isn't compared with itself.

    A weight is the count, over its histogram's total with `norm`; the query's also times the idf if given. Words
    unknown to `weights` add nothing.
    """
    a = q.select("query_id", "word", F.col("cnt").cast("double").alias("wq"))
    b = c.select("cid", "word", F.col("cnt").cast("double").alias("wc"))
    if norm:
        a = a.join(a.groupBy("query_id").agg(F.sum("wq").alias("t")), "query_id").select("query_id", "word", (F.col("wq") / F.col("t")).alias("wq"))
        b = b.join(b.groupBy("cid").agg(F.sum("wc").alias("t")), "cid").select("cid", "word", (F.col("wc") / F.col("t")).alias("wc"))
    if weights is not None:
        a = a.join(weights.select("word", "idf"), "word").select("query_id", "word", (F.col("wq") * F.col("idf")).alias("wq"))
    return a.join(b, "word").where("query_id <> cid").groupBy("query_id", "cid").agg(F.sum(F.col("wq") * F.col("wc")).alias("score"))


def double_normalised_product(q: DataFrame, c: DataFrame) -> DataFrame:
    """query_id, cid, score: the dot product of shares, divided once more by both totals."""
    a = q.join(q.groupBy("query_id").agg(F.sum("cnt").alias("tq")), "query_id").withColumnRenamed("cnt", "cq")
    b = c.join(c.groupBy("cid").agg(F.sum("cnt").alias("tc")), "cid")
    x = (F.col("cq") / F.col("tq")) * (F.col("cnt") / F.col("tc")) / (F.col("tq") * F.col("tc"))
    return a.join(b, "word").groupBy("query_id", "cid").agg(F.sum(x).alias("score"))


def _common(cnt: Column, tf: Column, flags: frozenset[str] | set[str]) -> Column:
    """What a bin of a query and one of a cluster have in common."""
    if "BIN" in flags:
        return F.least(cnt, F.lit(1)) * F.least(tf, F.lit(1))
    return F.least(cnt, tf) if "MIN" in flags else cnt * tf


def query_scores(q: DataFrame, db: DataFrame, flags: frozenset[str] | set[str] = frozenset({"IDF", "NORM"})) -> DataFrame:
    """query_id, cid, score > 0 under a set of flags out of IDF, NORM, MIN, BIN (none: plain counts).

    A bin adds q * tf, min(q, tf) with MIN, or the product of presences with BIN, times its idf with IDF and over the
    cluster's weighted sum with NORM; with NORM but neither MIN nor BIN the sum is divided by the query's total.
    """
    w = histo.idf(db).where("idf > 0").select("word", "idf") if "IDF" in flags else None
    b = db.select("cid", "word", F.col("cnt").alias("tf"))
    a = q.join(q.groupBy("query_id").agg(F.sum("cnt").alias("total")), "query_id")
    if "NORM" in flags:
        b = b.join(histo.weighted_sums(db, w, "BIN" in flags), "cid").where("weighted_sum > 0")
    if w is not None:
        b = b.join(w, "word")
    x = _common(F.col("cnt"), F.col("tf"), flags).cast("double")
    x = x * F.col("idf") if w is not None else x
    x = x / F.col("weighted_sum") if "NORM" in flags else x
    x = x / F.col("total") if "NORM" in flags and not flags & {"MIN", "BIN"} else x
    return a.join(b, "word").groupBy("query_id", "cid").agg(F.sum(x).alias("score")).where("score > 0")


def histogram_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """query_id, word, before, after of the bins that differ."""
    a = old.select("query_id", "word", F.col("cnt").alias("before"))
    b = new.select("query_id", "word", F.col("cnt").alias("after"))
    both = a.join(b, ["query_id", "word"], "full_outer")
    return both.select("query_id", "word", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("before", "after"))).where("before <> after")


def update_scores(scores: DataFrame, old: DataFrame, new: DataFrame, db: DataFrame, flags: frozenset[str] | set[str] = frozenset({"MIN", "IDF", "NORM"})) -> DataFrame:
    """query_id, cid, score: stored scores under `flags` (those of query_scores), moved by the changed bins only.

    Equals query_scores of the new histograms; rows that fall back to zero go. Where scores are shares of the query's
    total, they are brought from the old total to the new one. A changed collection changes the weights, so its scores
    are computed anew instead.
    """
    w = histo.idf(db).where("idf > 0").select("word", "idf") if "IDF" in flags else None
    b = db.select("cid", "word", F.col("cnt").alias("tf"))
    if "NORM" in flags:
        b = b.join(histo.weighted_sums(db, w, "BIN" in flags), "cid").where("weighted_sum > 0")
    if w is not None:
        b = b.join(w, "word")
    moved = (_common(F.col("after"), F.col("tf"), flags) - _common(F.col("before"), F.col("tf"), flags)).cast("double")
    moved = moved * F.col("idf") if w is not None else moved
    moved = moved / F.col("weighted_sum") if "NORM" in flags else moved
    delta = histogram_diff(old, new).join(b, "word").select("query_id", "cid", moved.alias("score"))
    stored = scores.select("query_id", "cid", "score")
    if shares := "NORM" in flags and not flags & {"MIN", "BIN"}:
        total = lambda h, name: h.groupBy("query_id").agg(F.sum("cnt").alias(name))
        stored = stored.join(total(old, "was"), "query_id").select("query_id", "cid", (F.col("score") * F.col("was")).alias("score"))
    out = stored.unionByName(delta).groupBy("query_id", "cid").agg(F.sum("score").alias("score")).where("score > 1e-12")
    return out.join(total(new, "is_now"), "query_id").select("query_id", "cid", (F.col("score") / F.col("is_now")).alias("score")) if shares else out


def top_k(scores: DataFrame, k: int = 1) -> DataFrame:
    """Adds rank; the k best of each query, ties to the smaller cid."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "cid")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_match(scores: DataFrame) -> DataFrame:
    return top_k(scores, 1).drop("rank")


def min_ratio(scores: DataFrame, ratio: float) -> DataFrame:
    """Scores strictly above `ratio` times the query's best; a best of zero leaves nothing."""
    best = scores.groupBy("query_id").agg(F.max("score").alias("best"))
    return scores.join(best, "query_id").where(F.col("score") > ratio * F.col("best")).drop("best")


def retrieve_frames(points: DataFrame, db: DataFrame, comments: DataFrame, k: int = 3) -> DataFrame:
    """query_id, rank, cid, score, comment: the k objects that a frame's words score best on."""
    q = histo.histograms(points, "query_id")
    return top_k(query_scores(q, db), k).join(comments, "cid").select("query_id", "rank", "cid", "score", "comment")
