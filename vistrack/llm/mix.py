"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Each source gets a target number of words. Every document first gets the whole copies that are certain; what is left
of the target is a sample of fixed size (in words) in which documents are ranked by random odds divided by the odds
of their inclusion probability, and the lowest ranks are taken. Inclusion probabilities are unequal: they rise with
a power of the size of the document's size class and are scaled so that the expected words meet the target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .common import WORD, small, unit_hash, written

EVERYTHING = (Window.unboundedPreceding, Window.unboundedFollowing)


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """source, source_size, target: the share of all sizes, divided by weight; no source gets more than `cap` times
    its size, and what is above goes to the others by weight. One row a source, so its windows are small."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    per = per.withColumn("k", (F.row_number().over(by_name) - 1) % len(weights))
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("k") + 1).cast("int")).cast("double"))
    per = per.withColumn("most", cap * F.col("source_size"))
    by_room = Window.orderBy("room", F.asc_nulls_last("source"))
    before, all_ = by_room.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(0)).rowsBetween(*EVERYTHING)
    per = per.withColumn("room", F.col("most") / F.col("w"))
    left = share * F.sum("source_size").over(all_) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    per = per.withColumn("level", F.try_divide(left, F.sum("w").over(all_) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    level = F.max(F.when(F.col("room") > F.col("level"), F.col("level"))).over(all_)
    per = per.withColumn("target", F.least("most", F.coalesce(level, F.lit(float("inf"))) * F.col("w")))
    return per.select("source", "source_size", F.col("target").cast("double").alias("target"))


def pareto_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, cap: float = 3.0, size_power: float = 0.5, buckets: int = 1024, seed: int = 17, carry: tuple[str, ...] = ()) -> DataFrame:
    """How often the mix takes each document.

    Returns doc_id, size, source_size, target, copies, taken (copies x size) and the columns `carry` of the documents,
    one row per input row. Sources are
    ordered by code point, null last, and weigh `weights` in turn. A null or empty text has size 0 and is never
    taken beyond the whole copies; rows that share a doc_id, or have none, are numbered by source and size and draw
    one by one; an empty table gives an empty result; columns other than doc_id, source and text are
    not looked at (those of `carry` are passed on). The random number depends on doc_id, that number and the seed alone, so reruns agree.

    The ranks are cut at a bucket of ranks found from (source, bucket) sums, and only the documents of the one
    bucket at the boundary are sorted: no source is ever gathered in one task.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count().alias("size"), *carry)
    sized = written(sized.withColumn("row__", F.monotonically_increasing_id()), "sizes")
    sized = written(numbered(sized, ["doc_id"], ["source", "size", "row__"], "nth__").drop("row__"), "numbered")
    targets = source_targets(sized, weights, share, cap)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.withColumn("whole", F.floor(ratio).cast("int")).withColumn(
        "rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))
    )
    targets = written(targets, "targets")

    # Inclusion probabilities by size class: min(1, c * mean size ** power), with c such that the words add up.
    sized = sized.withColumn("class", F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")) * 4)).otherwise(-1).cast("int"))
    strata = sized.where("size > 0").groupBy("source", "class").agg(F.sum("size").cast("double").alias("words"), F.avg("size").alias("mean"))
    strata = strata.join(targets.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    strata = strata.withColumn("pull", F.pow("mean", F.lit(size_power)))
    big_first = Window.partitionBy("source").orderBy(F.desc("pull"), F.desc("class"))
    before, own = big_first.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("source")
    over = F.sum(F.col("words") * F.col("pull"))
    strata = strata.withColumn(
        "c", F.try_divide(F.col("rest") - F.coalesce(F.sum("words").over(before), F.lit(0.0)), over.over(own) - F.coalesce(over.over(before), F.lit(0.0)))
    )
    strata = strata.withColumn("c", F.max(F.when(F.col("c") * F.col("pull") < 1, F.col("c"))).over(own))
    strata = strata.withColumn("p", F.when(F.col("c").isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("c") * F.col("pull")))))
    sure = F.sum(F.when(F.col("p") >= 1, F.col("words")).otherwise(0.0)).over(own)
    strata = strata.withColumn("left", F.greatest(F.lit(0.0), F.col("rest") - sure)).select(F.col("source").alias("s"), F.col("class").alias("k"), "p", "left")
    strata = written(strata, "strata")

    # Pareto ranks, as q / (1 + q) in [0, 1).
    u = F.when(F.col("nth__") == 0, unit_hash("doc_id", F.lit(seed))).otherwise(unit_hash("doc_id", "nth__", F.lit(seed)))
    q = (u / (1 - u)) * (1 - F.col("p")) / F.col("p")
    ranked = (
        sized.join(small(strata), F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("k")), "left")
        .drop("s", "k", "class")
        .withColumn("rank", F.when((F.col("p") > 0) & (F.col("p") < 1), q / (1 + q)))
        .withColumn("bucket", F.floor(F.col("rank") * buckets).cast("int"))
    )
    ranked = written(ranked, "ranks")
    sums = ranked.where("rank is not null").groupBy("source", "bucket", "left").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edge = (
        sums.withColumn("below", F.coalesce(F.sum("words").over(upto), F.lit(0)))
        .where("below + words > left")
        .groupBy("source")
        .agg(F.min(F.struct("bucket", "below")).alias("e"))
        .select(F.col("source").alias("s"), F.col("e.bucket").alias("edge"), F.col("e.below").alias("below"))
    )
    edge = written(edge, "edge")
    ranked = ranked.join(small(edge), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    at_edge = F.col("bucket") == F.col("edge")
    run = Window.partitionBy("source").orderBy("rank", "doc_id", "nth__").rowsBetween(Window.unboundedPreceding, 0)
    cut = ranked.where(at_edge).withColumn("mid", F.sum("size").over(run) - F.col("size") / 2.0)
    picked = ranked.where(~F.coalesce(at_edge, F.lit(False))).withColumn("mid", F.lit(None).cast("double")).unionByName(cut)
    sampled = F.when(F.col("p") >= 1, 1).when(F.col("rank").isNull(), 0).when(F.col("edge").isNull() | (F.col("bucket") < F.col("edge")), 1)
    sampled = sampled.when(at_edge & (F.col("mid") <= F.col("left") - F.col("below")), 1).otherwise(0)
    picked = picked.withColumn("sampled", sampled).select("doc_id", F.col("source").alias("s"), "size", "sampled", *carry)
    out = picked.join(small(targets), F.col("source").eqNullSafe(F.col("s")))
    copies = F.least(F.col("whole") + F.col("sampled"), F.lit(int(cap)))
    return out.select("doc_id", "source", "size", "source_size", "target", copies.cast("int").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), *carry)


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents themselves, each row repeated as often as the mix takes it; columns as given.

    Rows are numbered and written once, so rows without a doc_id or with a repeated one get their own copies.
    """
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    copies = pareto_mix(rows, carry=("__row",), **how).where("copies > 0").select("__row", F.col("copies").alias("__copies"))
    return rows.join(copies, "__row").select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy")).drop("__copy")
