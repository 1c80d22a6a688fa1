"""Embedding near-dedup by hierarchical navigable small-world graphs.

Vectors of one label are hashed into shards of bounded size, and each shard gets a graph. Blocks of queries meet every
shard of their label: a beam search descends the layers, beams that hold nothing but links widen together until they
are complete, and all beams double until an audit of the block against the whole shard passes. Pairs are verified by
cosine in double precision; a block sends counts and a spanning forest of its links, never the pairs of a group.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, small, written

M, EF_BUILD, EF, QUERIES = 16, 64, 64, 4096
#: Audited queries of a block; what share of their nearest vectors must be found, besides every link.
AUDIT, NEAREST = 48, 0.9


class Graph:
    """A layered small-world graph over unit vectors `x`; nodes are numbered by falling level, so a layer's nodes come
    first. Built in batches that are searched together: a batch's nodes see the graph before it and each other."""

    def __init__(self, x: np.ndarray, m: int = M, ef: int = EF_BUILD):
        n = len(x)
        level = np.floor(-np.log(np.random.default_rng(n).uniform(1e-12, 1, n)) / np.log(m)).astype(int)
        self.order = np.argsort(-level, kind="stable")
        self.x = np.ascontiguousarray(x[self.order], np.float32)
        self.counts = [int((level >= k).sum()) for k in range(level.max(initial=0) + 1)]
        self.links = [np.full((c, 2 * m if k == 0 else m), -1, np.int32) for k, c in enumerate(self.counts)]
        at, batch = 1, 1
        while at < n:
            to = min(n, at + batch)
            self._insert(at, to, m, ef)
            at, batch = to, min(256, 2 * batch)
        self._adopt()

    def _adopt(self, spare: int = 8) -> None:
        """Nodes that pruning has left without a link to them get one, in spare places, from a node they link to."""
        links = self.links[0]
        orphans = np.setdiff1d(np.arange(1, len(self.x)), links)
        free = np.zeros(len(self.x), int)
        more = np.full((len(self.x), spare), -1, np.int32)
        for v in orphans.tolist():
            to = links[v][links[v] >= 0]
            u = to[np.argmin(free[to])] if len(to) else 0
            if free[u] < spare:
                more[u, free[u]] = v
                free[u] += 1
        self.links[0] = np.concatenate([links, more[:, : max(1, free.max(initial=0))]], 1)

    def _insert(self, at: int, to: int, m: int, ef: int) -> None:
        entry = np.zeros((to - at, 1), np.int64)
        for k in range(len(self.counts) - 1, -1, -1):
            here = np.arange(at, min(to, self.counts[k]))
            known = min(at, self.counts[k])
            if not len(here):
                entry = self._beam(k, self.x[at:to], entry, 4, known)[0]
                continue
            # nodes above this layer come first, so a batch is either wholly here or its head is
            found, sim = self._beam(k, self.x[at:to], entry, ef, known)
            entry = found[:, :8]
            found, sim = found[: len(here)], sim[: len(here)]
            own = self.x[here] @ self.x[here].T
            np.fill_diagonal(own, -np.inf)
            found = np.concatenate([found, np.broadcast_to(here, own.shape)], 1)
            sim = np.concatenate([sim, own], 1)
            top = np.argsort(-sim, 1, kind="stable")[:, :ef]
            found, sim = np.take_along_axis(found, top, 1), np.take_along_axis(sim, top, 1)
            chosen = self._select(found, sim, m)
            self.links[k][here, :m] = chosen
            u, v = np.repeat(here, m), chosen.ravel()
            u, v = u[v >= 0], v[v >= 0]
            self._back(k, u, v)

    def _select(self, found: np.ndarray, sim: np.ndarray, m: int) -> np.ndarray:
        """Up to m of each row's candidates (by falling similarity): those closer to the node than to any chosen one."""
        out = np.full((len(found), m), -1, np.int64)
        for i in range(0, len(found), 512):
            f, s = found[i : i + 512], sim[i : i + 512]
            good = (f >= 0) & np.isfinite(s)
            v = self.x[np.maximum(f, 0)]
            cross = v @ v.transpose(0, 2, 1)
            kept = np.zeros(f.shape, bool)
            for j in range(f.shape[1]):
                near = np.where(kept, cross[:, j, :], -np.inf).max(1)
                kept[:, j] = good[:, j] & (s[:, j] > near) & (kept.sum(1) < m)
            spare = good & ~kept  # fill up with the nearest others
            rank = np.where(kept, 0, np.where(spare, 1, 2)) * f.shape[1] + np.arange(f.shape[1])
            top = np.argsort(rank, 1, kind="stable")[:, :m]
            got = np.take_along_axis(np.where(good, f, -1), top, 1)
            out[i : i + 512, : got.shape[1]] = got
        return out

    def _back(self, k: int, u: np.ndarray, v: np.ndarray) -> None:
        """Adds u to v's links; a full list is chosen anew."""
        links = self.links[k]
        width = links.shape[1]
        sim = np.einsum("ij,ij->i", self.x[u], self.x[v])
        order = np.lexsort((-sim, v))
        u, v = u[order], v[order]
        node, start = np.unique(v, return_index=True)
        rank = np.arange(len(v)) - np.repeat(start, np.diff(np.r_[start, len(v)]))
        ok = rank < width
        more = np.full((len(node), width), -1, np.int64)
        more[np.searchsorted(node, v[ok]), rank[ok]] = u[ok]
        all_ = np.concatenate([links[node].astype(np.int64), more], 1)
        full = (all_ >= 0).sum(1) > width
        sorted_ = np.take_along_axis(all_, np.argsort(all_ < 0, 1, kind="stable"), 1)
        links[node[~full]] = sorted_[~full, :width]
        if full.any():
            f, q = all_[full], self.x[node[full]]
            s = np.where(f >= 0, np.einsum("id,ijd->ij", q, self.x[np.maximum(f, 0)]), -np.inf)
            top = np.argsort(-s, 1, kind="stable")
            links[node[full]] = self._select(np.take_along_axis(f, top, 1), np.take_along_axis(s, top, 1), width)

    def _beam(self, k: int, q: np.ndarray, entry: np.ndarray, ef: int, known: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities (falling, -1 and -inf where there are fewer) of the `ef` nearest that the search finds
        among the first `known` nodes of layer k."""
        b, width = len(q), max(4, ef // 8)
        seen = np.zeros((b, known), bool)
        ids, sim = np.full((b, ef), -1, np.int64), np.full((b, ef), -np.inf, np.float32)
        done = np.ones((b, ef), bool)
        row, node = np.repeat(np.arange(b), entry.shape[1]), entry.ravel()
        while True:
            good = (node >= 0) & (node < known)
            code = np.unique(row[good] * known + node[good])
            row, node = code // known, code % known
            new = ~seen[row, node]
            row, node = row[new], node[new]
            if len(row):
                seen[row, node] = True
                s = np.einsum("ij,ij->i", q[row], self.x[node])
                per = np.bincount(row, minlength=b)
                at = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
                more_i, more_s = np.full((b, per.max()), -1, np.int64), np.full((b, per.max()), -np.inf, np.float32)
                more_i[row, at], more_s[row, at] = node, s
                ids, sim = np.concatenate([ids, more_i], 1), np.concatenate([sim, more_s], 1)
                done = np.concatenate([done, more_i < 0], 1)
                top = np.argpartition(-sim, ef - 1, 1)[:, :ef]
                ids, sim, done = (np.take_along_axis(x, top, 1) for x in (ids, sim, done))
            open_ = np.where(done, -np.inf, sim)
            w = min(width, ef)
            pick = np.argpartition(-open_, w - 1, 1)[:, :w]
            valid = np.take_along_axis(open_, pick, 1) > -np.inf
            if not valid.any():
                top = np.argsort(-sim, 1, kind="stable")
                return np.take_along_axis(ids, top, 1), np.take_along_axis(sim, top, 1)
            r, c = np.nonzero(valid)
            c = pick[r, c]
            done[r, c] = True
            nb = self.links[k][ids[r, c]]
            row, node = np.repeat(r, nb.shape[1]), nb.ravel().astype(np.int64)

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        entry = np.zeros((len(q), 1), np.int64)
        for k in range(len(self.counts) - 1, 0, -1):
            entry = self._beam(k, q, entry, 8, self.counts[k])[0]
        return self._beam(0, q, entry, min(ef, len(self.x)), len(self.x))

    def within(self, q: np.ndarray, least: float, ef: int, slack: float = 0.03) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of all that the search finds at `least` or above. Queries whose beam is full of them widen
        together: theirs becomes one common beam that takes in every neighbour of a node near to any of them, until
        no such node is left. So a group of thousands of near copies costs block products, not a beam each."""
        rows, nodes, full = [], [], []
        for i in range(0, len(q), 512):
            ids, sim = self.search(q[i : i + 512], ef)
            wide = (sim[:, -1] >= least) & (ids.shape[1] < len(self.x))
            r, c = np.nonzero((sim >= least) & ~wide[:, None])
            rows.append(i + r)
            nodes.append(ids[r, c])
            full += [(int(a), i + int(k)) for a, k in zip(ids[wide].min(1), np.flatnonzero(wide))]
        full = np.array([k for _, k in sorted(full)], np.int64)
        for i in range(0, len(full), 512):
            part = full[i : i + 512]
            ids, sim = self.search(q[part], 8)
            seen, front = np.zeros(len(self.x), bool), np.unique(ids[(ids >= 0) & (sim >= least - slack)])
            while len(front):
                seen[front] = True
                near = []
                for j in range(0, len(front), 4096):
                    s = q[part] @ self.x[front[j : j + 4096]].T
                    r, c = np.nonzero(s >= least)
                    rows.append(part[r])
                    nodes.append(front[j + c])
                    near.append(front[j : j + 4096][(s >= least - slack).any(0)])
                nb = np.unique(self.links[0][np.concatenate(near)])
                nb = nb[nb >= 0]
                front = nb[~seen[nb]]
        return (np.concatenate(rows), np.concatenate(nodes)) if rows else (np.zeros(0, np.int64),) * 2


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1. A row is first brought to magnitude 1, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def found_links(graph: Graph, x: np.ndarray, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, node of x) with cosine of `least` or more in double precision; `q` and `x` are unit rows in double.

    The beam starts at EF and doubles until the audit passes: for a spread sample of the queries, every link and 9 of
    10 nearest vectors that comparing with the whole shard shows must be found. At the shard's size all are compared.
    """
    q32, ef = q.astype(np.float32), EF
    sample = np.unique(np.linspace(0, len(q) - 1, min(AUDIT, len(q))).astype(int))
    exact = q[sample] @ x.T
    truth = {(int(sample[i]), int(j)) for i, j in zip(*np.nonzero(exact >= least))}
    own = np.where(exact > 1 - 1e-12, -np.inf, exact)  # a query that is itself in the shard says little
    while ef < len(x):
        ids, _ = graph.search(q32[sample], ef)
        node = np.where(ids >= 0, graph.order[np.maximum(ids, 0)], -1)
        if (node == own.argmax(1)[:, None]).any(1).mean() >= NEAREST:
            row, node = graph.within(q32, least - 1e-4, ef)
            node = graph.order[node]
            ok = np.einsum("ij,ij->i", q[row], x[node]) >= least
            row, node = row[ok], node[ok]
            audited = np.isin(row, sample)
            if truth <= set(zip(row[audited].tolist(), node[audited].tolist())):
                return row, node
        ef *= 2
    parts = [(i + r, c) for i in range(0, len(q), 256) for r, c in [np.nonzero(q[i : i + 256] @ x.T >= least)]]
    return np.concatenate([r for r, _ in parts]), np.concatenate([c for _, c in parts])


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of the links (a, b), some that connect the same."""
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while root.setdefault(i, i) != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in zip(a.tolist(), b.tolist()):
        p, r = find(i), find(j)
        if p != r:
            root[max(p, r)] = min(p, r)
            out.append((i, j))
    return out


def _build(f: pd.DataFrame) -> pd.DataFrame:
    x = unit(np.array(f["vector"].tolist(), np.float64))
    blob = pickle.dumps({"x": x, "graph": Graph(x), "id": f["id"].to_numpy(), "copies": f["copies"].to_numpy()})
    return pd.DataFrame({"part": [f["part"].iloc[0]], "shard": [f["shard"].iloc[0]], "index": [blob]})


def _query(least: float):
    def run(q: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"id": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "dst": pd.array([], "Int64")})
        if q.empty or index.empty:
            return none
        s, ids = pickle.loads(index["index"].iloc[0]), q["id"].to_numpy()
        row, node = found_links(s["graph"], s["x"], unit(np.array(q["vector"].tolist(), np.float64)), least)
        other = s["id"][node] != ids[row]
        row, node = row[other], node[other]
        n = np.bincount(row, s["copies"][node], len(q)).astype(np.int64)
        links = _forest(ids[row], s["id"][node])
        counts = pd.DataFrame({"id": ids, "n": n, "dst": pd.array([None] * len(q), "Int64")})
        edges = pd.DataFrame({"id": [a for a, _ in links], "n": 0, "dst": pd.array([b for _, b in links], "Int64")})
        return pd.concat([counts, edges]).astype({"id": "int64", "n": "int64"}) if links else counts

    return run


def near_vectors(vectors: DataFrame, least: float = 0.98, shard_rows: int = 16384) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector, one row per input row.

    Vectors are compared if their labels are equal and not null (and they have as many components). A null, empty or
    zero vector, or one with a null or non-finite component, links with nothing. Equal vectors of a label are one
    class from the start, with as many links to each other; an empty table gives an empty result; columns other than
    vec_id, embedding and label are not looked at. Rows that share a vec_id are vectors of their own, but one node.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), "label")
    fine = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(
        (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0), F.lit(False)
    )
    v = v.withColumn("part", F.when(fine, F.concat_ws(":", F.col("label").cast("string"), F.size("vector"))))
    classes = v.where("part is not null").groupBy("part", "vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    sizes = written(classes.groupBy("part").agg(F.count("*").alias("m")), "sizes")
    classes = classes.join(small(sizes), "part").withColumn("shards", F.ceil(F.col("m") / shard_rows).cast("int")).withColumn("blocks", F.ceil(F.col("m") / QUERIES).cast("int"))
    spread = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    classes = written(classes.withColumn("shard", spread(F.col("shards"), "shard")).withColumn("block", spread(F.col("blocks"), "block")), "classes")
    index = classes.select("part", "shard", "id", "copies", "vector").groupBy("part", "shard").applyInPandas(_build, "part string, shard int, index binary")
    index = written(index, "index").join(classes.select("part", "blocks").distinct(), "part").select("part", "shard", "index", every(F.col("blocks")).alias("block"))
    asked = classes.select("part", "block", "id", "vector", every(F.col("shards")).alias("shard"))
    by = ["part", "shard", "block"]
    found = asked.groupBy(*by).cogroup(index.groupBy(*by)).applyInPandas(_query(least), "id long, n long, dst long")
    found = written(found, "links")
    parts = components(found.where("dst is not null").select(F.col("id").alias("src"), "dst"))
    per = found.groupBy("id").agg(F.sum("n").alias("n"))
    per = per.join(parts.withColumnRenamed("node", "id"), "id", "left").select("id", "n", F.coalesce("component", "id").alias("component"))
    known = written(classes.select("part", "vector", "id", "copies").join(per, "id").drop("id"), "known")
    out = v.join(known, ["part", "vector"], "left").withColumn("component_id", F.coalesce("component", "vec_id"))
    links = F.coalesce(F.col("n") + F.col("copies") - 1, F.lit(0)).cast("long")
    return out.select("vec_id", links.alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
