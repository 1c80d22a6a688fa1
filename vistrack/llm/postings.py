"""Approximate nearest neighbours by inner product over balanced posting lists.

Vectors are lifted to the unit sphere, where the largest inner product is the smallest distance: x becomes
(x, sqrt(M^2 - |x|^2)) / M with M the greatest norm, a query q becomes (q, 0) / |q|. Centroids are fitted on a sample by
halving it again and again into equal parts. Every vector goes to the list of its nearest centroid, and one near a
boundary to the lists of other centroids as well, unless such a centroid lies closer to one that it is in already than
to the vector. Centroids are found by a small-world graph in the memory of each task. A query looks into the lists whose
centroids are within a ratio of its nearest one's distance; the ratio is what an audit against all vectors asks for.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, unit_hash, written
from .hnsw import Graph

#: Vectors of a list aimed at; sampled vectors that a centroid is the mean of, at least; rows of a sample at most.
LIST, SHARE, SAMPLE = 512, 16, 65_536
#: Lists that a vector is in at most, and by how much farther than the nearest a centroid may be for that.
REPLICAS, BOUNDARY = 3, 1.1
#: Audited queries; the share of their neighbours that the chosen ratio must reach.
AUDITED, RECALL = 256, 0.95
#: Lists of the first wave of a search; by how many times every further wave reaches beyond the one before.
WAVE = (2, 8)
#: Vectors and queries that one task compares at a time.
CHUNK, BLOCK = 4096, 4096


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    x = np.clip(x / most, -1, 1)
    y = np.c_[x, np.sqrt(np.maximum(0.0, 1 - (x * x).sum(1)))]
    return y / np.linalg.norm(y, axis=1, keepdims=True)


def lifted_queries(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return np.c_[x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))]


def balanced_centroids(y: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of `lists` parts of y whose sizes differ by two at most: a part is cut into two halves (of sizes
    in proportion to the lists they still become) along the line between two means, which settle in a few rounds."""
    rng, done, todo = np.random.default_rng(len(y)), [], [(np.arange(len(y)), lists)]
    while todo:
        at, k = todo.pop()
        if k == 1:
            done.append(y[at].mean(0))
            continue
        cut = round(len(at) * (k // 2) / k)
        a, b = y[rng.choice(at, 2, replace=False)]
        for _ in range(rounds):
            order = np.argsort(-(y[at] @ (a - b)), kind="stable")
            left, right = at[order[:cut]], at[order[cut:]]
            a, b = y[left].mean(0), y[right].mean(0)
        todo += [(left, k // 2), (right, k - k // 2)]
    c = np.array(done)
    length = np.linalg.norm(c, axis=1, keepdims=True)
    return np.where(length > 1e-12, c / np.maximum(length, 1e-12), y[: len(c)])


def distance(sim: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * sim))


class Lists:
    """The centroids with their graph."""

    def __init__(self, centroids: np.ndarray):
        self.graph, self.n = Graph(centroids), len(centroids)

    def near(self, y: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(list, distance) of up to `ef` centroids for each row, nearest first; list -1 beyond what was found."""
        out = [self.graph.search(y[i : i + 512].astype(np.float32), max(ef, 16)) for i in range(0, len(y), 512)]
        ids, sim = np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])
        return np.where(ids >= 0, self.graph.order[np.maximum(ids, 0)], -1), np.where(ids >= 0, distance(np.maximum(sim, -1)), np.inf)

    def places(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, list, whether it is the row's first) of every row's lists."""
        ids, d = self.near(y, 16)
        chosen = np.full((len(y), REPLICAS), -1)
        chosen[:, 0], n = ids[:, 0], np.ones(len(y), int)
        c = self.graph.x[np.argsort(self.graph.order)]
        for j in range(1, ids.shape[1]):
            ok = (ids[:, j] >= 0) & (d[:, j] <= BOUNDARY * d[:, 0]) & (n < REPLICAS)
            for r in range(REPLICAS):
                have = ok & (r < n)
                ok[have] &= distance(np.einsum("ij,ij->i", c[chosen[have, r]], c[ids[have, j]])) > d[have, j]
            chosen[ok, n[ok]] = ids[ok, j]
            n += ok
        row, r = np.nonzero(chosen >= 0)
        return row, chosen[row, r], r == 0

    def probes(self, y: np.ndarray, ratio: float, first: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, list, place): the lists within `ratio` of each row's nearest, and more until their first places hold
        `need` vectors, with their places by distance. A beam that ends too early is widened."""
        rows, lists, places, todo, ef = [], [], [], np.arange(len(y)), 64
        while len(todo):
            ids, d = self.near(y[todo], min(ef, self.n))
            held = np.where(ids >= 0, first[np.maximum(ids, 0)], 0).cumsum(1)
            want = (ids >= 0) & ((d <= ratio * np.maximum(d[:, :1], 1e-9)) | (held - np.where(ids >= 0, first[np.maximum(ids, 0)], 0) < need[todo, None]))
            full = want.all(1) & (ef < self.n)
            r, c = np.nonzero(want & ~full[:, None])
            rows.append(todo[r])
            lists.append(ids[r, c])
            places.append(c)
            todo, ef = todo[full], ef * 4
        return np.concatenate(rows), np.concatenate(lists), np.concatenate(places)


def best(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, score) of each query's k largest products with rows of another id, ties to the smaller
    id; none below the query's `bound`. A block product picks who is near enough; scores are then summed in one order for every pair."""
    rows, cols, scores = [], [], []
    for i in range(0, len(q), 512):
        with np.errstate(all="ignore"):
            s = np.nan_to_num(q[i : i + 512] @ x.T, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        s[q_id[i : i + 512, None] == x_id[None, :]] = -np.inf
        kth = np.partition(s, -min(k, len(x)), 1)[:, -min(k, len(x))]
        with np.errstate(all="ignore"):
            slack = 1e-12 * np.linalg.norm(q[i : i + 512], axis=1) * np.linalg.norm(x, axis=1).max()
            least = np.where(np.isfinite(kth) & np.isfinite(slack), kth - slack, -np.inf)
            if bound is not None:
                least = np.maximum(least, np.where(np.isfinite(slack), bound[i : i + 512] - slack, -np.inf))
            r, c = np.nonzero((s >= least[:, None]) & (s > -np.inf))
            exact = (q[i + r] * x[c]).sum(1)
        if bound is not None:
            ok = exact >= bound[i + r]
            r, c, exact = r[ok], c[ok], exact[ok]
        order = np.lexsort((x_id[c], -exact, r))
        r, c, exact = r[order], c[order], exact[order]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < k
        rows.append(i + r[keep])
        cols.append(c[keep])
        scores.append(exact[keep])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(scores)


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def _against_all(asked: tuple[np.ndarray, np.ndarray], k: int):
    """For each part of the vectors, what of it is among the k best of the audited queries."""

    def run(frames):
        for f in frames:
            if len(f):
                r, c, s = best(*asked, matrix(f["vector"]), f["vec_id"].to_numpy(), k)
                yield pd.DataFrame({"query": r.astype(np.int32), "rid": f["rid"].to_numpy()[c], "vec_id": f["vec_id"].to_numpy()[c], "score": s})

    return run


def _search(k: int):
    """A chunk of a list with a block of the queries that look into it."""

    def run(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if q.empty or x.empty:
            return pd.DataFrame({c: [] for c in ("query_id", "qid", "rid", "vec_id", "copies", "score")})
        r, c, s = best(matrix(q["vector"]), q["vec_id"].to_numpy(), matrix(x["vector"]), x["vec_id"].to_numpy(), k, q["bound"].to_numpy())
        q, x = q.iloc[r], x.iloc[c]
        return pd.DataFrame({"query_id": q["vec_id"].to_numpy(), "qid": q["rid"].to_numpy(), "rid": x["rid"].to_numpy(), "vec_id": x["vec_id"].to_numpy(), "copies": x["copies"].to_numpy(), "score": s})

    return run


def fine_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and vector of the rows that take part; of vectors of several lengths those of the commonest."""
    x = F.col("vector")
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    good = (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    v = v.where(F.col("vec_id").isNotNull() & good)
    length = v.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return v.where(F.size("vector") == (length["d"] if length else 0))


def nearest(vectors: DataFrame, queries: str = "vec_id % 20 = 0", k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score, recall: the k largest inner products found for each row that meets `queries`.

    Scores are in double precision on the original vectors. `recall` is the share of their exact neighbours that up to
    AUDITED queries, spread over all, find in the lists that the ratio lets them look into; it is RECALL or more.
    A null, empty or zero vector, one with a null or non-finite component, or a row without vec_id takes no part; where
    vectors differ in length, those of the commonest length do (of the longest of these). Of equal query rows one asks;
    a repeated candidate row counts each time, except under the query's own id. Of equal vectors the k + 1 smallest ids
    are kept, as no other can be in a result. Fewer than k candidates are all returned; an empty table gives an empty
    result; columns other than vec_id and embedding are not looked at. Products beyond doubles are infinite, and none
    where they cancel.
    """
    schema = "query_id long, rank int, vec_id long, score double, recall double"
    v = fine_vectors(vectors)
    rows = v.groupBy("vector", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("copies"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    numbered = lambda t: t.withColumn("rid", F.monotonically_increasing_id())
    rows = written(numbered(rows.drop("nth")), "rows")
    asked = written(numbered(v.where(queries).dropDuplicates(["vec_id", "vector"])), "asked")
    size = rows.agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("vector", lambda c: F.abs(c.cast("double"))))).alias("top")).first()
    asks = asked.count()
    if not size["n"] or not asks:
        return vectors.sparkSession.createDataFrame([], schema)
    spread = lambda c, salt: F.xxhash64(F.col(c), F.lit(salt))
    sampled = lambda t, salt, share: t.where(unit_hash(F.col("rid"), F.lit(salt)) < share).select("vec_id", "vector").toPandas()
    audit = sampled(asked, "audit", AUDITED / asks)

    # the index: centroids from a bounded sample, broadcast with their graph (at most SAMPLE / SHARE of them)
    square = F.aggregate("vector", F.lit(0.0), lambda a, c: a + F.pow(c.cast("double") / size["top"], F.lit(2.0)))  # no overflow
    most = size["top"] * float(np.sqrt(rows.agg(F.max(square)).first()[0]))
    sample = lifted(matrix(sampled(rows, "sample", SAMPLE / size["n"])["vector"]), most)
    count = int(max(1, min(size["n"] // LIST, len(sample) // SHARE)))
    index = vectors.sparkSession.sparkContext.broadcast(pickle.dumps(Lists(balanced_centroids(sample, count))))

    def place(frames):
        lists = pickle.loads(index.value)
        for f in frames:
            if len(f):
                r, c, first = lists.places(lifted(matrix(f["vector"]), most))
                yield f.iloc[r].assign(list=c.astype(np.int32), first=first)

    kind = rows.schema["vector"].dataType.simpleString()
    member = f"rid long, vec_id long, copies int, vector {kind}, list int, first boolean"
    members = written(rows.select("rid", "vec_id", "copies", "vector").mapInPandas(place, member), "members")
    sizes = members.groupBy("list").agg(F.count("*").alias("m"), F.sum(F.col("first").cast("long")).alias("firsts"))
    first = np.zeros(count, np.int64)
    for r in sizes.collect():  # a row per centroid
        first[r["list"]] = r["firsts"]

    # the audit: how far the lists of the exact neighbours of some queries are
    q, q_id = matrix(audit["vector"]), audit["vec_id"].to_numpy()
    of = rows.select("rid", "vec_id", "vector").mapInPandas(_against_all((q, q_id), k), "query int, rid long, vec_id long, score double")
    true = of.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "rid"))).where(F.col("rank") <= k)
    where = members.select("rid", "list").join(F.broadcast(true.select("query", "rid")), "rid").toPandas()  # AUDITED x k x REPLICAS rows
    c = pickle.loads(index.value).graph
    c = c.x[np.argsort(c.order)]
    far = distance(np.clip(lifted_queries(q) @ c.T, -1, 1))
    near = np.maximum(far.min(1), 1e-9)
    reach = far[where["query"], where["list"]] / near[where["query"]]
    reach = pd.Series(reach).groupby([where["query"].to_numpy(), where["rid"].to_numpy()]).min()
    ratio = float(np.sort(reach.to_numpy())[int(np.ceil(RECALL * len(reach))) - 1]) * (1 + 1e-6) if len(reach) else 1.0
    recall = float((reach <= ratio).mean()) if len(reach) else 1.0

    # the search: lists in chunks, and the queries that look into a list in blocks. Lists are looked into in waves, the
    # nearest first; what scores below a query's kth so far stays in its task, so that a query gets some k rows a wave
    own = rows.groupBy("vec_id").agg(F.sum("copies").alias("own"))
    need = asked.join(own, "vec_id", "left").withColumn("need", F.coalesce("own", F.lit(0)) + k)

    def probe(frames):
        lists = pickle.loads(index.value)
        for f in frames:
            if len(f):
                r, c, place = lists.probes(lifted_queries(matrix(f["vector"])), ratio, first, f["need"].to_numpy())
                wave = np.where(place < WAVE[0], 0, 1 + np.log(np.maximum(1, place / WAVE[0]) * (1 + 1e-9)) // np.log(WAVE[1])).astype(np.int32)
                yield f.iloc[r][["rid", "vec_id", "vector"]].assign(list=c.astype(np.int32), wave=wave)

    looks = written(need.select("rid", "vec_id", "vector", "need").mapInPandas(probe, f"rid long, vec_id long, vector {kind}, list int, wave int"), "looks")
    part = lambda n, salt: F.pmod(spread("rid", salt), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    by = ["list", "chunk", "block"]
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id", "rid")
    kept = None
    for wave in range((looks.agg(F.max("wave")).first()[0] or 0) + 1):
        now = looks.where(F.col("wave") == wave)
        if kept is None:
            now = now.withColumn("bound", F.lit(float("-inf")))
        else:  # the kth score so far
            bound = kept.where(F.col("nth") == k).select(F.col("qid").alias("rid"), F.col("score").alias("bound"))
            now = now.join(bound, "rid", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
        parts = sizes.join(now.groupBy("list").agg(F.count("*").alias("asks")), "list")
        parts = small(written(parts.select("list", F.ceil(F.col("m") / CHUNK).cast("int").alias("chunks"), F.ceil(F.col("asks") / BLOCK).cast("int").alias("blocks")), "parts"))
        x = members.join(parts, "list").select("list", part("chunks", "chunk").alias("chunk"), every("blocks").alias("block"), "rid", "vec_id", "copies", "vector")
        y = now.join(parts, "list").select("list", part("blocks", "block").alias("block"), every("chunks").alias("chunk"), "rid", "vec_id", "vector", "bound")
        found = y.groupBy(*by).cogroup(x.groupBy(*by)).applyInPandas(_search(k), "query_id long, qid long, rid long, vec_id long, copies int, score double")
        found = found if kept is None else kept.select(found.columns).unionByName(found)
        once = found.groupBy("qid", "rid").agg(*(F.first(c).alias(c) for c in ("query_id", "vec_id", "copies", "score")))
        kept = written(once.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k), f"wave{wave}")
    ranked = kept.withColumn("from", F.coalesce(F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("from") < k)
    rank = F.explode(F.sequence((F.col("from") + 1).cast("int"), F.least(F.col("from") + F.col("copies"), F.lit(k)).cast("int"))).alias("rank")
    return ranked.select("query_id", rank, "vec_id", "score", F.lit(recall).alias("recall"))
