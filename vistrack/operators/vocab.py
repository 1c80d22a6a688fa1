"""The vocabulary tree: hierarchical k-means over descriptors, and quantisation by descent.

A tree is a list of nodes (node_id, parent_id, ordinal, level, word, mean): one row a node, bounded by
branches ** depth, so it travels to every task. While nodes are large, rows of descriptors don't move: a level's nodes
are all refined in one pass, and only sums per task, node and child are shuffled. Rows of a node that fits a task move
once, to the task that builds all below it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.state import written

SCHEMA = "node_id long, parent_id long, ordinal int, level int, word int, size long, mean array<double>"


@dataclass
class Node:
    id: int
    parent: int
    ordinal: int
    level: int
    mean: np.ndarray
    size: int
    word: int = 0
    kids: list[Node] = field(default_factory=list)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centre of each row by squared distance; ties to the lowest."""
    d = ((x[:, None, :] - centres[None, :, :]) ** 2).sum(2) if len(x) * len(centres) * x.shape[1] < 4e6 else (centres**2).sum(1) - 2 * x @ centres.T
    return d.argmin(1)


def _marks(x: np.ndarray, node: int) -> np.ndarray:
    """A number per row, from its values and a node's id: rows that are equal have the same one."""
    odd = np.random.default_rng(node).integers(0, 1 << 63, x.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    bits = np.ascontiguousarray(x + 0.0).view(np.uint64)  # -0.0 and 0.0 are one value
    mark = ((bits ^ (bits >> np.uint64(32))) * odd).sum(1)
    return ((mark ^ (mark >> np.uint64(31))) * odd[0] >> np.uint64(1)).astype(np.int64)


def _starts(x: np.ndarray, node: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k lowest marks of different rows, and those rows."""
    marks, at = np.unique(_marks(x, node), return_index=True)
    return marks[:k], x[at[:k]]


def _sums(x: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """For each of k clusters the number of its rows, and their sum."""
    member = (own[None, :] == np.arange(k)[:, None]).astype(float)
    return np.c_[member.sum(1), member @ x]


def _moved(centres: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Clusters without rows keep their centre."""
    return np.where(sums[:, :1] > 0, sums[:, 1:] / np.maximum(sums[:, :1], 1), centres)


def split_nodes(rows: DataFrame, nodes: list[int], k: int = 4, iterations: int = 32) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """k-means of every listed node's rows (node, vector) at once: node -> (means, sizes) of its clusters.

    Starts from the rows with the lowest marks that differ (so fewer rows than k give fewer clusters), of which each
    task sends k a node; a cluster that loses all rows keeps its mean, and goes if it is empty in the last pass. A pass
    moves one sum of vectors per task, node and child.
    """
    keyed = rows.where(F.col("node").isin(nodes)).select("node", "vector")

    def lowest(frames):
        best: dict[int, np.ndarray] = {}
        for f in frames:
            for n, part in f.groupby("node"):
                x = np.array(part["vector"].tolist(), float)
                best[n] = _starts(np.concatenate([best[n], x]) if n in best else x, n, k)[1]
        for n, x in best.items():
            yield pd.DataFrame({"node": n, "mark": _marks(x, n), "vector": list(x)})

    first = keyed.mapInPandas(lowest, "node long, mark long, vector array<double>").groupBy("node", "mark").agg(F.first("vector").alias("vector"))
    first = first.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("mark"))).where(F.col("r") <= k)
    picked: dict[int, list] = {}
    for r in first.orderBy("node", "r").collect():  # k rows a node
        picked.setdefault(r["node"], []).append(r["vector"])
    centres = {n: np.array(c, float) for n, c in picked.items()}
    if not centres:
        return {}
    width = 1 + next(iter(centres.values())).shape[1]
    total: dict[int, np.ndarray] = {}
    for _ in range(iterations):
        now = centres

        def sums(frames, now=now):
            total: dict[int, np.ndarray] = {}
            for f in frames:
                for n, part in f.groupby("node"):
                    x = np.array(part["vector"].tolist(), float)
                    total[n] = total.get(n, 0) + _sums(x, _nearest(x, now[n]), len(now[n]))
            for n, s in total.items():
                yield pd.DataFrame({"node": n, "child": np.arange(len(s)), "s": list(s)})

        part = keyed.mapInPandas(sums, "node long, child int, s array<double>")
        got = part.groupBy("node", "child").agg(F.array(*(F.sum(F.col("s")[i]) for i in range(width))).alias("s"))
        total = {n: np.zeros((len(c), width)) for n, c in now.items()}
        for r in got.collect():  # k rows a node
            total[r["node"]][r["child"]] = r["s"]
        centres = {n: _moved(c, total[n]) for n, c in now.items()}
        if all(np.array_equal(c, now[n]) for n, c in centres.items()):  # further passes would change nothing
            break
    return {n: (c[total[n][:, 0] > 0], total[n][total[n][:, 0] > 0, 0].astype(int)) for n, c in centres.items()}


def _kid(node: int, ordinal: int, k: int) -> int:
    """Nodes of a full k-ary tree, numbered level by level from 1."""
    return k * (node - 1) + ordinal + 2


def _grown(x: np.ndarray, node: int, level: int, k: int, max_level: int, min_elem: int, iterations: int):
    """(node, level, size, mean) of all nodes below one whose rows are at hand."""
    todo = [(node, level, x)]
    while todo:
        node, level, x = todo.pop()
        if level >= max_level or len(x) <= max(4, min_elem):
            continue
        centres = _starts(x, node, k)[1]
        for _ in range(iterations):
            sums, last = _sums(x, _nearest(x, centres), len(centres)), centres
            centres = _moved(centres, sums)
            if np.array_equal(centres, last):
                break
        centres = centres[sums[:, 0] > 0]
        if len(centres) < 2:
            continue
        own = _nearest(x, centres)
        for i, mean in enumerate(centres):
            part = x[own == i]
            yield _kid(node, i, k), level + 1, len(part), mean
            todo.append((_kid(node, i, k), level + 1, part))


def build_tree(vectors: DataFrame, k: int = 4, max_level: int = 8, min_elem: int = 1000, iterations: int = 32, at_hand: int = 100_000) -> list[Node]:
    """Splits leaves below `max_level` with more than `min_elem` (and more than four) rows.

    `vectors` has (id, vector); rows without a vector take no part. Nodes of more than `at_hand` rows are split level
    by level over all tasks; what is left of the tree below a smaller node is built whole in one task, which its rows
    are sent to once. Both ways start from the same rows and give the same tree, up to rounding. A node's size is the
    number of rows that a descent leaves there or passes on. A split into a single cluster leaves the node a leaf.
    """
    rows = written(vectors.where("vector is not null").select(F.lit(1).cast("long").alias("node"), F.col("vector").cast("array<double>").alias("vector")), "vectors")
    found = {1: (0, rows.count(), np.zeros(0))}
    level, fresh, handed = 0, [1], []
    while True:
        open_ = [n for n in fresh if level < max_level and found[n][1] > max(4, min_elem)]
        small, big = [n for n in open_ if found[n][1] <= at_hand], [n for n in open_ if found[n][1] > at_hand]
        if small:
            handed.append(rows.where(F.col("node").isin(small)).withColumn("level", F.lit(level)))
        if not big:
            break
        means = {n: m for n, (m, _) in split_nodes(rows, big, k, iterations).items() if len(m) > 1}
        kids = {n: (m, np.array([_kid(n, i, k) for i in range(len(m))])) for n, m in means.items()}
        rows = written(rows.where(F.col("node").isin(list(kids))).withColumn("node", _step(kids)("node", "vector")), "vectors")
        sizes = {r["node"]: r["count"] for r in rows.groupBy("node").count().collect()}  # a row for each node of the level
        level, fresh = level + 1, [int(i) for _, ids in kids.values() for i in ids]
        for m, ids in kids.values():
            found |= {int(i): (level, sizes.get(int(i), 0), mean) for i, mean in zip(ids, m)}
    if handed:

        def below(f: pd.DataFrame) -> pd.DataFrame:
            x = np.array(f["vector"].tolist(), float)
            got = list(_grown(x, int(f["node"].iloc[0]), int(f["level"].iloc[0]), k, max_level, min_elem, iterations))
            return pd.DataFrame(got, columns=["node", "level", "size", "mean"])

        parts = reduce(DataFrame.unionByName, handed).groupBy("node").applyInPandas(below, "node long, level int, size long, mean array<double>")
        found |= {r["node"]: (r["level"], r["size"], np.array(r["mean"])) for r in parts.collect()}  # the tree
    ids = {n: i for i, n in enumerate(sorted(found), 1)}
    tree = [Node(ids[n], ids.get((n - 2) // k + 1, 0) if n > 1 else 0, (n - 2) % k if n > 1 else 0, found[n][0], found[n][2], found[n][1]) for n in ids]
    for x in tree[1:]:
        tree[x.parent - 1].kids.append(x)
    number_leaves(tree[0])
    return tree


def _step(kids: dict[int, tuple[np.ndarray, np.ndarray]]):
    """From a node to its nearest child, by the children's means and ids."""

    @F.pandas_udf("long")
    def run(node: pd.Series, vector: pd.Series) -> pd.Series:
        out = node.to_numpy().copy()
        for n in np.unique(out):
            if n in kids:
                at = np.flatnonzero(node.to_numpy() == n)
                means, ids = kids[n]
                out[at] = ids[_nearest(np.array(vector.iloc[at].tolist(), float), means)]
        return pd.Series(out)

    return run


def number_leaves(root: Node) -> None:
    """Words 1..n depth first; inner nodes have 0."""
    todo, n = [root], 0
    while todo:
        x = todo.pop()
        if x.kids:
            x.word = 0
            todo += reversed(x.kids)
        else:
            n += 1
            x.word = n


def tree_table(spark, tree: list[Node]) -> DataFrame:
    return spark.createDataFrame([(x.id, x.parent, x.ordinal, x.level, x.word, x.size, x.mean.tolist()) for x in tree], SCHEMA)


def tree_from_table(table: DataFrame) -> list[Node]:
    """Nodes of a tree table, children in order of their ordinals, which are made gapless."""
    rows = {r["node_id"]: Node(r["node_id"], r["parent_id"], r["ordinal"], r["level"], np.array(r["mean"], float), r["size"], r["word"]) for r in table.collect()}
    for x in sorted(rows.values(), key=lambda x: (x.parent, x.ordinal)):
        if x.parent in rows:
            x.ordinal = len(rows[x.parent].kids)
            rows[x.parent].kids.append(x)
    return [rows[i] for i in sorted(rows)]


def save_tree(table: DataFrame, path: str) -> None:
    """Node and edge tables under `path`; a tree saved before is replaced."""
    table.select("node_id", "word", "level", "size", "mean").write.mode("overwrite").parquet(f"{path}/tree_nodes")
    table.select("parent_id", "node_id", "ordinal").write.mode("overwrite").parquet(f"{path}/tree_structure")


def load_tree(spark, path: str) -> DataFrame:
    nodes, edges = spark.read.parquet(f"{path}/tree_nodes"), spark.read.parquet(f"{path}/tree_structure")
    return nodes.join(edges, "node_id").select("node_id", "parent_id", "ordinal", "level", "word", "size", "mean")


def quantise(rows: DataFrame, tree: list[Node], column: str = "vector") -> DataFrame:
    """Adds node and word: the leaf that a descent to the nearest child at each node ends in. A batch descends level
    by level; null vectors have no leaf (word 0)."""
    kids = {x.id: (np.array([k.mean for k in x.kids]), np.array([k.id for k in x.kids])) for x in tree if x.kids}
    words = {x.id: x.word for x in tree}

    @F.pandas_udf("node long, word int")
    def run(vector: pd.Series) -> pd.DataFrame:
        ok = vector.notna().to_numpy()
        x = np.array(vector[ok].tolist(), float)
        at = np.full(len(x), 1, np.int64)
        live = np.arange(len(x))
        while len(live):
            nxt = []
            for n in np.unique(at[live]).tolist():
                if n in kids:
                    part = live[at[live] == n]
                    at[part] = kids[n][1][_nearest(x[part], kids[n][0])]
                    nxt.append(part)
            live = np.concatenate(nxt) if nxt else np.zeros(0, int)
        node, word = np.zeros(len(vector), np.int64), np.zeros(len(vector), np.int32)
        node[ok], word[ok] = at, [words[n] for n in at.tolist()]
        return pd.DataFrame({"node": node, "word": word})

    out = rows.withColumn("__q", run(F.col(column)))
    return out.select(*rows.columns, F.col("__q.node").alias("node"), F.col("__q.word").alias("word"))


def rank_children(rows: DataFrame, centres: DataFrame, distance) -> DataFrame:
    """Every (id) with every child (ordinal, mean) of one node by rising distance; ties to the lower ordinal.

    The children of a node are a handful, sent to all tasks.
    """
    both = rows.join(F.broadcast(centres)).withColumn("d2", distance(F.col("vector"), F.col("mean")))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("d2", "ordinal"))).select("id", "rank", "ordinal", "d2")


def leaf_numbers(paths: DataFrame) -> DataFrame:
    """path (array of ordinals), word: leaves numbered depth first; a tree's leaves fit one sort."""
    return paths.withColumn("word", F.row_number().over(Window.orderBy("path")).cast("long"))


def tree_summary(table: DataFrame) -> DataFrame:
    """level, nodes, leaves, rows (in leaves), largest leaf."""
    leaf = F.col("word") > 0
    return table.groupBy("level").agg(
        F.count("*").alias("nodes"), F.sum(leaf.cast("long")).alias("leaves"),
        F.sum(F.when(leaf, F.col("size")).otherwise(0)).alias("rows"), F.max(F.when(leaf, F.col("size"))).alias("largest"),
    )


def node_exemplars(rows: DataFrame, n: int = 3, node: str = "node") -> DataFrame:
    """The first n members (by id) of each node."""
    order = Window.partitionBy(node).orderBy("id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def rescaled(mean: Column) -> Column:
    """A mean stretched to 0..1; all 0 if it is flat."""
    lo, hi = F.array_min(mean), F.array_max(mean)
    return F.transform(mean, lambda x: F.when(hi > lo, F.try_divide(x - lo, hi - lo)).otherwise(0.0))
