"""Sharding: k-d tree partitioning by distributed weighted medians.

The tree splits the node with the widest dimension at the weighted quantile that gives each side its share of the
bytes, until every leaf holds the target bytes (total / shards). A quantile is found from a histogram per node, and
once more within the bin that holds it. Bins also carry the least and greatest value of each dimension, so the two
halves of a split node are known without another look at the rows: a level takes two passes. The driver only ever
sees nodes x bins sums. Rows never move until the slots are numbered, and there a shard is cut into chunks that are
numbered apart.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.numbering import numbered as dense
from .common import unit_hash, written

LAW, NOWHERE = "bytes", 1e300


@dataclass
class _Node:
    """A leaf of `shards` shards from `first`, or a split at `cut` of dimension number `dim`; `left` and the node after
    it are the halves, and a leaf is its own left half. lo and hi are the range that is searched for the cut."""

    id: int
    first: int
    shards: int
    left: int
    dim: int = 0
    cut: float = NOWHERE
    lo: float = 0.0
    hi: float = 1.0


def _of(values: list, node: Column | str) -> Column:
    """Each row's value by its node. Values go in as a literal array, so all passes share one compiled plan."""
    kind = "D" if isinstance(values[0], float) else ""
    return F.get(F.expr(f"array({', '.join(f'{x!r}{kind}' for x in values)})"), F.col(node) if isinstance(node, str) else node)


def _placed(rows: DataFrame, nodes: list[_Node], depth: int) -> DataFrame:
    """Adds `node`: the leaf each row falls into. Takes `depth` steps from the root, the last of them in place.

    The steps are a fold: as columns of their own, each of which names the one before three times, they would grow to
    3 ** depth terms wherever the optimizer moves a condition on `node`, or on what is made from it, before them.
    """
    left, dim, cut = ([getattr(x, what) for x in nodes] for what in ("left", "dim", "cut"))
    step = lambda node, _: _of(left, node) + (F.get("dims", _of(dim, node)) >= _of(cut, node)).cast("int")
    return rows.withColumn("node", F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step))


def document_dimensions() -> dict[str, Column]:
    """Metadata of a document as numbers in [0, 1): source, language, size.

    Every value is spread over its own interval by `tie` (16 bits of the text's checksum, then the id), so that no
    value is an atom: copies of one text stay neighbours, yet a group of them can still be cut.
    """
    slot = lambda c, n: F.floor(unit_hash(F.coalesce(F.col(c), F.lit("")), F.lit(c)) * n)
    return {
        "d_source": (slot("source", 256) + F.col("tie")) / 256.0,
        "d_lang": (slot("lang", 64) + F.col("tie")) / 64.0,
        "d_size": F.log2(F.col("size") + F.col("tie")) / 64.0,
    }


def _histograms(placed: DataFrame, nodes: list[_Node], ids: list[int], bins: int, bounds: list[Column]) -> dict[int, list]:
    """By node of `ids` its bins in order (bin, w, lo_*, hi_*): weight and bounds of the values of the node's dimension
    in its range; what lies below or above is in bins -1 and `bins`."""
    # no condition on the node, as it would be worked out twice: nodes that aren't asked have all rows in bin -1
    lo, hi = _of([x.lo if x.id in ids else NOWHERE for x in nodes], "node"), _of([x.hi for x in nodes], "node")
    d = F.get("dims", _of([x.dim for x in nodes], "node"))
    inside = F.least(F.floor((d - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
    bin_ = F.when(d < lo, -1).when(d >= hi, bins).otherwise(inside)
    found = placed.groupBy("node", bin_.alias("bin")).agg(F.sum("w").cast("double").alias("w"), *bounds)
    out: dict[int, list] = {i: [] for i in ids}
    for r in found.collect():  # at most nodes x bins
        if r["node"] in out:
            out[r["node"]].append(r)
    return {i: sorted(x, key=lambda r: r["bin"]) for i, x in out.items()}


def _stats(bins: list, dims: int) -> dict:
    """Weight and bounds of some bins together."""
    ends = {f"lo_{d}": min((r[f"lo_{d}"] for r in bins), default=0.0) for d in range(dims)} | {f"hi_{d}": max((r[f"hi_{d}"] for r in bins), default=0.0) for d in range(dims)}
    return ends | {"w": sum(r["w"] for r in bins)}


def kd_partition(rows: DataFrame, weight: str, dims: list[str], shards: int, bins: int = 4096, passes: int = 4, tolerance: float = 5e-4) -> DataFrame:
    """`rows` with their shard (0 to shards - 1) by the columns `dims` (double).

    A side of k shards gets k shares of the weight. The bin that holds a node's quantile is cut into bins again until
    it holds one value or weighs at most `tolerance` of a shard, at most `passes` times. An empty table stays empty.
    """
    at, n = rows.select(F.col(weight).alias("w"), F.array(*dims).alias("dims")), len(dims)
    bounds = [f(F.get("dims", F.lit(d))).alias(f"{k}_{d}") for d in range(n) for k, f in (("lo", F.min), ("hi", F.max))]
    nodes, depth = [_Node(0, 0, shards, 0)], max(1, math.ceil(math.log2(shards)))
    stats = {0: at.agg(F.sum("w").cast("double").alias("w"), *bounds).first().asDict()}
    while stats[0]["w"] and (open_ := [x for x in nodes if x.shards > 1 and x.left == x.id]):
        whole = [*nodes, *(_Node(k, 0, 0, k) for k in range(len(nodes), 2 * shards - 1))]  # of one length in all passes
        placed, todo, halves = _placed(at, whole, depth), [], {}
        for x in open_:
            s = stats[x.id]
            x.dim = max(range(n), key=lambda d: (s[f"hi_{d}"] - s[f"lo_{d}"], d))
            x.lo, x.hi, halves[x.id] = s[f"lo_{x.dim}"], s[f"hi_{x.dim}"] + max(1e-15, abs(s[f"hi_{x.dim}"]) * 1e-12), ([], [])
            todo += [x] if s["w"] else []
        for last in range(passes, 0, -1):
            if not todo:
                break
            found, more = _histograms(placed, whole, [x.id for x in todo], bins, bounds), []
            for x in todo:
                want, step, own = stats[x.id]["w"] * (x.shards // 2) / x.shards, (x.hi - x.lo) / bins, found[x.id]
                below, k = 0.0, 0
                while k < len(own) - 1 and below + own[k]["w"] < want:
                    below += own[k]["w"]
                    k += 1
                w = own[k]["w"]
                apart = own[k][f"lo_{x.dim}"] < own[k][f"hi_{x.dim}"]
                if last > 1 and apart and w > tolerance * stats[x.id]["w"] / x.shards and step > 1e-15 and 0 <= own[k]["bin"] < bins:
                    x.lo += own[k]["bin"] * step
                    x.hi = x.lo + step
                    more.append(x)
                    continue
                k += want - below >= below + w - want  # the nearer edge of the bin
                halves[x.id] = own[:k], own[k:]
            todo = more
        for x in open_:
            half, (left, right) = x.shards // 2, halves[x.id]
            # the cut is a value that was seen, as bins come from rounded quotients
            x.cut = right[0][f"lo_{x.dim}"] if right else NOWHERE
            x.left = len(nodes)
            nodes += [_Node(x.left, x.first, half, x.left), _Node(x.left + 1, x.first + half, x.shards - half, x.left + 1)]
            stats[x.left], stats[x.left + 1] = _stats(left, n), _stats(right, n)
    return _placed(rows.withColumn("dims", F.array(*dims)), nodes, depth).withColumn("shard", _of([x.first for x in nodes], "node")).drop("node", "dims")


def numbered(rows: DataFrame, shard: str, order: list[str], chunks: int) -> DataFrame:
    """Adds `slot`: gapless from 0 in each shard. Chunks of a shard are numbered apart and offset by the counts of
    those before, a table of at most shards x chunks rows, so no shard is sorted in one task."""
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)).cast("int"))
    before = Window.partitionBy(shard).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(shard, "chunk").count().select(shard, "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy(shard, "chunk").orderBy(*order)
    return (
        rows.withColumn("n", F.row_number().over(own).cast("long"))
        .join(F.broadcast(offsets), [shard, "chunk"])
        .withColumn("slot", F.col("offset") + F.col("n") - 1)
        .drop("n", "offset", "chunk")
    )


def shard_documents(docs: DataFrame, shards: int = 24, chunks: int = 256, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Every document's shard under the law `bytes`: shard sizes (UTF-8 bytes of the text plus 8) are near equal.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard (null: only the law `key` has one), one row per
    input row. A null text has no bytes and checksum 0; null source or lang is a value of its own kind; equal rows
    are spread like any others and get different slots; an empty table gives an empty result; other columns are not looked at.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", "lang",
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    # equal rows have numbers, so that no group of them is an atom
    base = written(base.withColumn("row", F.monotonically_increasing_id()), "sizes")
    base = dense(base, ["doc_id", "text_crc32"], ["source", "lang", "row"], "nth").drop("row")
    own = F.when(F.col("nth") == 0, unit_hash(F.coalesce("doc_id", F.lit(0)), "text_crc32")).otherwise(unit_hash(F.coalesce("doc_id", F.lit(0)), "text_crc32", "nth"))
    base = base.withColumn("tie", (F.floor(F.col("text_crc32") / 65536.0) + own) / 65536.0)
    dims = document_dimensions() | dict(extra or {})
    base = written(base.withColumns(dims).select("doc_id", "size", "text_crc32", "nth", *dims), "kd")
    out = kd_partition(base, "size", list(dims), shards).select("doc_id", "size", "text_crc32", "nth", "shard")
    return numbered(out, "shard", ["doc_id", "text_crc32", "nth"], chunks).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
