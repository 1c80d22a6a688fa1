"""Exact top-k inner-product search with two cover trees.

Data is hashed into shards of bounded size and each shard gets a cover tree; queries come in blocks that get one too.
A block meets every shard. The query tree is walked from its root with the data nodes that are still open: a node is
dropped when no pair of points under the two can score as much as the worst kth score of the query group. For centres
c and d, radii r and s, greatest norms m and n and greatest angles to the centre f and g no pair scores more than
c.d + |c|s + |d|r + rs (balls), nor more than m n cos(angle(c, d) - f - g) (cones). Scores are exact integers, and a tie
keeps a pair, so nothing is lost. Where points don't cluster no radius covers less than nearly all of them; then the
trees are one leaf, and the search is a product of blocks.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: The radius shrinks by BASE a level; a node of up to LEAF points (QUERY_LEAF of a query tree) isn't cut further.
BASE, LEAF, QUERY_LEAF, BLOCK, QUERIES = 1.3, 64, 32, 2048, 4096
#: Whole numbers are exact in a double up to 2**53; beyond this bound on a sum scores are Python integers.
EXACT = 2.0**52


@dataclass
class Tree:
    """Nodes as columns. Node k holds the rows order[start[k]:end[k]], all within `radius` and `angle` of its centre;
    its children (first[k] to last[k] - 1, none for a leaf) cover them at smaller radii."""

    order: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    last: np.ndarray
    centre: np.ndarray
    norm: np.ndarray
    radius: np.ndarray
    angle: np.ndarray
    most: np.ndarray


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> Tree:
    """Top-down: centres of a level are chosen far from each other until they cover the node's points. Where a sample
    shows that it would take more than a quarter of the points, a finer cover is no use, and the node stays a leaf."""
    norms = np.sqrt((x * x).sum(1))

    def cover(at: np.ndarray, first: int, near: np.ndarray, reach: float, most: int) -> tuple[list[int], np.ndarray] | None:
        """Centres and each point's nearest one; `near` has the distances to the first."""
        centres, own = [first], np.zeros(len(at), int)
        while near.max() > reach:
            if len(centres) > most:
                return None
            far = int(near.argmax())
            e = np.sqrt(((x[at] - x[at[far]]) ** 2).sum(1))
            closer = e < near
            own[closer], near[closer] = len(centres), e[closer]
            centres.append(int(at[far]))
        return centres, own

    nodes, todo, order = [], [(np.arange(len(x)), 0)], []
    # breadth first, so that the children of a node are neighbours
    for at, first in todo:
        d = np.sqrt(((x[at] - x[first]) ** 2).sum(1))
        cos = np.divide(x[at] @ x[first], norms[at] * norms[first], out=np.full(len(at), -1.0), where=norms[at] * norms[first] > 0)
        node = [first, float(d.max()), float(np.arccos(np.clip(cos.min(), -1, 1))) + 1e-7, float(norms[at].max()), at, 0, 0]
        nodes.append(node)
        if len(at) <= leaf or node[1] == 0:
            continue
        sample = np.linspace(0, len(at) - 1, min(len(at), 256)).astype(int)
        reach = node[1] / BASE
        if cover(at[sample], first, d[sample].copy(), reach, len(sample) // 4) is None:
            continue
        found = cover(at, first, d.copy(), reach, len(at) // 4)
        if found and len(found[0]) > 1:
            centres, own = found
            kids = [(at[own == k], c) for k, c in enumerate(centres) if (own == k).any()]
            node[5], node[6] = len(todo), len(todo) + len(kids)
            todo += kids
    start, end = np.zeros(len(nodes), int), np.zeros(len(nodes), int)

    at, stack = 0, [0]
    while stack:  # leaves in depth-first order, so that every node is one stretch of rows
        k = stack.pop()
        start[k], end[k] = at, at + len(nodes[k][4])
        if nodes[k][5] == nodes[k][6]:
            order.append(nodes[k][4])
            at = end[k]
        stack += range(nodes[k][6] - 1, nodes[k][5] - 1, -1)
    col = lambda i, t=float: np.array([n[i] for n in nodes], t)
    centre = x[col(0, int)]
    return Tree(np.concatenate(order), start, end, col(5, int), col(6, int), centre, np.sqrt((centre * centre).sum(1)), col(1), col(2), col(3))


def _bounds(t: Tree, u: int, s: Tree, nodes: np.ndarray) -> np.ndarray:
    """What no pair of a point under node u of `t` and one under each of the nodes of `s` can exceed."""
    dot = s.centre[nodes] @ t.centre[u]
    ball = dot + t.norm[u] * s.radius[nodes] + s.norm[nodes] * t.radius[u] + t.radius[u] * s.radius[nodes]
    both = t.norm[u] * s.norm[nodes]
    apart = np.arccos(np.clip(np.divide(dot, both, out=np.ones(len(nodes)), where=both > 0), -1, 1)) - t.angle[u] - s.angle[nodes]
    cone = t.most[u] * s.most[nodes] * np.maximum(0.0, np.cos(np.clip(apart, 0.0, np.pi)))
    top = np.minimum(ball, cone)
    return top + 1e-9 * np.abs(top) + 1e-6


def _open_to_one(q: np.ndarray, worst: np.ndarray, s: Tree, nodes: np.ndarray) -> np.ndarray:
    """Which of the nodes may hold a point for at least one of the queries `q`, by each one's own kth score."""
    norm, dot = np.sqrt((q * q).sum(1))[:, None], q @ s.centre[nodes].T
    both = norm * s.norm[nodes]
    apart = np.arccos(np.clip(np.divide(dot, both, out=np.ones(dot.shape), where=both > 0), -1, 1)) - s.angle[nodes] - 1e-7
    top = np.minimum(dot + norm * s.radius[nodes], norm * s.most[nodes] * np.maximum(0.0, np.cos(np.clip(apart, 0.0, np.pi))))
    return (top + 1e-9 * np.abs(top) + 1e-6 >= worst[:, None]).any(0)


class Best:
    """The k best (id, score) of each query so far."""

    def __init__(self, q_id: np.ndarray, k: int):
        self.q_id, self.k = q_id, k
        self.score = np.full((len(q_id), k), -np.inf)
        self.id = np.full((len(q_id), k), np.iinfo(np.int64).max, np.int64)

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Takes in the scores (rows x ids); those that can't be among a row's k best are left out first."""
        own = self.q_id[rows][:, None] == ids[None, :]
        score = np.where(own, -np.inf, score) if own.any() else score
        least = self.score[rows, -1]
        if len(ids) > self.k:
            least = np.maximum(least, -np.partition(-score, self.k - 1, axis=1)[:, self.k - 1])
        r, c = np.nonzero((score >= least[:, None]) & ~own)
        if not len(r):
            return
        hit = np.unique(r)
        row = np.concatenate([r, np.repeat(hit, self.k)])
        s = np.concatenate([score[r, c], self.score[rows[hit]].ravel()])
        i = np.concatenate([ids[c], self.id[rows[hit]].ravel()])
        order = np.lexsort((i, -s, row))
        row, s, i = row[order], s[order], i[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < self.k
        self.score[rows[row[keep]], rank[keep]], self.id[rows[row[keep]], rank[keep]] = s[keep], i[keep]


def top_scores(q: np.ndarray, q_id: np.ndarray, q_tree: Tree, x: np.ndarray, x_id: np.ndarray, x_tree: Tree, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query row, id, score) of each query's k best among `x`, its own id left out, ties to the smaller id; and how
    many pairs were scored. Components are whole numbers whose sums of products stay below EXACT."""
    best, scored = Best(q_id, k), 0
    xs, ids = x[x_tree.order], x_id[x_tree.order]

    def score(u: int, rows: np.ndarray) -> None:
        nonlocal scored
        at = q_tree.order[q_tree.start[u] : q_tree.end[u]]
        for i in range(0, len(at), BLOCK):  # blocks of bounded size
            for j in range(0, len(rows), BLOCK):
                part = rows[j : j + BLOCK]
                best.add(at[i : i + BLOCK], q[at[i : i + BLOCK]] @ xs[part].T, ids[part])
        scored += len(at) * len(rows)

    todo = [(0, np.zeros(1, int))]
    while todo:
        u, nodes = todo.pop()
        at = q_tree.order[q_tree.start[u] : q_tree.end[u]]
        # open the data nodes that are wider than the query group, all of them once the group is a leaf
        leaf = q_tree.first[u] == q_tree.last[u]
        closed = []
        while len(nodes):
            top = _bounds(q_tree, u, x_tree, nodes)
            keep = top >= best.score[at, -1].min()
            nodes = nodes[keep]
            inner = (x_tree.first[nodes] < x_tree.last[nodes]) & (leaf | (x_tree.radius[nodes] >= q_tree.radius[u]))
            closed.append(nodes[~inner])
            nodes = np.concatenate([np.arange(x_tree.first[v], x_tree.last[v]) for v in nodes[inner]] or [np.zeros(0, int)])
        nodes = np.concatenate(closed or [np.zeros(0, int)])
        if not leaf:
            todo += [(w, nodes) for w in range(q_tree.last[u] - 1, q_tree.first[u] - 1, -1)]
            continue
        top = _bounds(q_tree, u, x_tree, nodes)
        nodes, top = nodes[np.argsort(-top)], np.sort(top)[::-1]
        at_node, batch = 0, 4 * LEAF
        while at_node < len(nodes) and top[at_node] >= best.score[at, -1].min():  # the most promising first
            sizes = np.cumsum(x_tree.end[nodes[at_node:]] - x_tree.start[nodes[at_node:]])
            to = at_node + 1 + int(np.searchsorted(sizes, batch))
            part = nodes[at_node:to][top[at_node:to] >= best.score[at, -1].min()]
            part = part[_open_to_one(q[at], best.score[at, -1], x_tree, part)]
            score(u, np.concatenate([np.arange(x_tree.start[v], x_tree.end[v]) for v in part] or [np.zeros(0, int)]))
            at_node, batch = to, 2 * batch
    r, c = np.nonzero(best.id < np.iinfo(np.int64).max)
    return r, best.id[r, c], best.score[r, c].astype(np.int64), scored


def large_scores(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As top_scores, in whole numbers of any size (an object array) and without pruning."""
    out, big = [], [[int(v) for v in p] for p in x]
    for r, (p, i) in enumerate(zip(q, q_id)):
        p = [int(v) for v in p]
        s = sorted((-sum(a * b for a, b in zip(p, o)), int(j)) for o, j in zip(big, x_id) if j != i)[:k]
        out += [(r, j, -v) for v, j in s]
    row, id_, score = zip(*out) if out else ((), (), ())
    return np.array(row, np.int64), np.array(id_, np.int64), np.array(score, object)


def _build(f: pd.DataFrame) -> pd.DataFrame:
    x = np.floor(np.array(f["z"].tolist(), np.float64))
    plain = np.abs(x).max(1) < 2.0**20  # the few rows of larger numbers are kept aside
    x, ids = np.concatenate([x[plain], x[~plain]]), np.concatenate([f["vec_id"].to_numpy()[plain], f["vec_id"].to_numpy()[~plain]])
    n = int(plain.sum())
    blob = pickle.dumps({"x": x, "id": ids, "plain": n, "tree": cover_tree(x[:n]) if n else None})
    return pd.DataFrame({"size": [f["size"].iloc[0]], "shard": [f["shard"].iloc[0]], "tree": [blob]})


def _search(k: int):
    def run(q: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(q) and len(trees):
            s, z, ids = pickle.loads(trees["tree"].iloc[0]), np.floor(np.array(q["z"].tolist(), np.float64)), q["vec_id"].to_numpy()
            n, x, x_id = s["plain"], s["x"], s["id"]
            fits = z.shape[1] * np.abs(z).max(1) * np.abs(x[:n]).max(initial=1) < EXACT
            if n and fits.any():
                row, id_, score, _ = top_scores(z[fits], ids[fits], cover_tree(z[fits], QUERY_LEAF), x[:n], x_id[:n], s["tree"], k)
                found.append((ids[fits][row], id_, score))
            for asked, of in ((fits, slice(n, None)), (~fits, slice(None))):
                if asked.any() and len(x_id[of]):
                    row, id_, score = large_scores(z[asked], ids[asked], x[of], x_id[of], k)
                    found.append((ids[asked][row], id_, score))
        query, id_, score = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
        # a score in two halves, so that those beyond 64 bits are in order as well
        high = np.clip(score >> 62, -(2**62), 2**62).astype(np.int64)
        return pd.DataFrame({"query_id": query, "vec_id": id_, "high": high, "low": (score & (2**62 - 1)).astype(np.int64)})

    return run


def nearest(vectors: DataFrame, queries: str = "vec_id % 50 = 0", k: int = 5, scale: int = 256, shard_rows: int = 16384) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all rows for each row that meets `queries`.

    Components x become floor(scale * x); the score is the integer inner product (beyond 64 bits in its place, but
    shown as the nearest limit). A null or empty vector, one with a null or non-finite component, or a row without
    vec_id takes no part; vectors of different length are not compared. Of repeated query rows one asks; a repeated candidate row counts each time it occurs, except under the
    query's own id. Fewer than k candidates are all returned; an empty table gives an empty result; columns other
    than vec_id and embedding are not looked at.
    """
    x = F.col("x")
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    v = v.where(F.col("vec_id").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    v = v.select("vec_id", F.size(x).alias("size"), F.transform(x, lambda c: c * scale).alias("z"))
    sizes = v.groupBy("size").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"), F.ceil(F.count(F.expr(f"case when {queries} then 1 end")) / QUERIES).cast("int").alias("blocks"))
    v = v.join(sizes, "size")
    spread = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.greatest(F.lit(1), n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    v = written(v.withColumn("shard", spread(F.col("shards"), "shard")).withColumn("block", spread(F.col("blocks"), "block")), "vectors")
    trees = v.select("size", "shard", "vec_id", "z").groupBy("size", "shard").applyInPandas(_build, "size int, shard int, tree binary")
    trees = written(trees, "trees").join(sizes.where("blocks > 0").select("size", "blocks"), "size").select("size", "shard", "tree", every(F.col("blocks")).alias("block"))
    asked = v.where(queries).dropDuplicates(["vec_id", "z"]).select("size", "block", "vec_id", "z", every(F.col("shards")).alias("shard"))
    by = ["size", "shard", "block"]
    found = asked.groupBy(*by).cogroup(trees.groupBy(*by)).applyInPandas(_search(k), "query_id long, vec_id long, high long, low long")
    score = F.when(F.col("high") > 1, 2**63 - 1).when(F.col("high") < -2, -(2**63)).otherwise(F.shiftleft("high", 62) + F.col("low"))
    order = Window.partitionBy("query_id").orderBy(F.desc("high"), F.desc("low"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", score.alias("score"))
