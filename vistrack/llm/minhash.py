"""MinHash near-dedup by bottom-k sketches.

One hash function orders all shingles; a document's sketch is its k smallest values. Values that several documents
retain form inverted lists. A pair whose sketches must overlap in t values shares one of the rarest (retained - t + 1)
values of either, so only these prefixes are listed: a passage that a third of all documents share is in no prefix
unless there is little else in the document. Pairs from the lists are filtered by the Jaccard similarity that the
bottom-k of the sketches' union estimates, and every survivor is verified on the full sets.

Lists are never expanded into all pairs. A first round compares each list with two pivots, which joins most of a
group of near copies. Then only pairs between different components are left: members outside a list's largest
component are compared with the whole list, in blocks of bounded size. A pass over sketches alone finds the members
that have any such pair which passes the estimate; only theirs are the full sets that a second pass verifies, unless
links found meanwhile join them. So components come out as if all pairs that pass the estimate had been verified.

Sums per key are written before they are joined to the rows they were taken from, so that adaptive execution can
split a value, a list or a set that a third of all documents hold.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alone, components, freed, give_back, pieces, tidy, written

WORDS_PER_SHINGLE, K = 5, 64
#: Members of a block of a list, and the values of full sets in one, at most (a single larger set aside).
BLOCK, BLOCK_VALUES = 256, 2_000_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def shingle_set(text: str | None, width: int = WORDS_PER_SHINGLE) -> np.ndarray:
    """Sorted distinct 63-bit hashes of a text's shingles: `width` words, or all words if there are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.int64)
    alone(_hashes)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = min(width, len(words))
    x = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        x = x * np.uint64(0x9E3779B97F4A7C15) + h[i : len(words) - n + 1 + i]
        x ^= x >> np.uint64(29)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.unique((x ^ (x >> np.uint64(31))) >> np.uint64(1)).astype(np.int64)


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)]), pa.int64()))


def _digest(s: np.ndarray) -> str:
    return hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest()


def sketches(docs: DataFrame, k: int = K) -> DataFrame:
    """row, doc_id, n, key, sketch of every document: size and digest of its set, and the set's k smallest values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            n, key, low = [], [], []
            for t in b.column("text").to_pylist():
                s = shingle_set(t)
                n.append(len(s))
                key.append(_digest(s))
                low.append(s[:k])
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(n, pa.int64()), pa.array(key), _lists(low)], ["row", "doc_id", "n", "key", "sketch"])

    return docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "row long, doc_id long, n long, key string, sketch array<long>")


def full_sets(docs: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """id, n, set (sorted) of the classes in `ids` (id), made anew from the text of a document of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            sets = [shingle_set(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets]), _lists(sets)], ["key", "set"])

    asked = classes.select("id", "key", "n", "doc").join(ids.select("id").distinct(), "id", "left_semi")
    asked = written(asked, "asked")
    doc = F.col("doc_id").cast("long")
    rows = docs.select(doc.alias("doc"), "text").join(asked.select("doc").where("doc is not null").distinct(), "doc", "left_semi").select("text")
    rows = rows.unionByName(docs.where(doc.isNull()).select("text"))  # these are known by their sets only
    made = rows.mapInArrow(tidy(run), "key string, set array<long>")
    return made.join(asked.drop("doc"), "key").select("id", "n", "set").dropDuplicates(["id"])


def needed_overlap(n, k: int, percent: int):
    """How many retained values two documents at the bound share at least, for one of size `n`.

    A set small enough that its partners are retained whole: exactly its share. A larger one: five standard
    deviations below the expectation for k draws, so a pair at the bound is missed once in some millions.
    """
    p = percent / 100
    floor_ = int(k * p - 5 * math.sqrt(k * p * (1 - p)))
    return F.when(n <= int(k * p), F.ceil(n * percent / 100)).otherwise(F.lit(floor_)).cast("int")


def least_share(k: int, percent: int) -> float:
    """The share of a full union sketch that both documents must hold: the floor of `needed_overlap`."""
    p = percent / 100
    return int(k * p - 5 * math.sqrt(k * p * (1 - p))) / k


def prefixes(reps: DataFrame, k: int, percent: int) -> DataFrame:
    """id, n, prefix: the retained values to list, of the documents that can have a partner at all."""
    values = reps.select("id", "n", F.explode("sketch").alias("v"))
    shared = written(values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "shared")
    mine = values.join(shared, "v").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("s"))
    spare = F.size("s") - needed_overlap(F.col("n"), k, percent) + 1
    return mine.where(spare > 0).select("id", "n", F.slice(F.col("s.v"), F.lit(1), spare).alias("prefix"))


def estimated(pairs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b: the pairs whose sizes allow the similarity and whose union sketch passes. A union of fewer than k values
    is whole, so there the estimate is the similarity itself."""
    a = classes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    b = classes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    near = pairs.join(a, "a").join(b, "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, k)
    near = near.withColumn("union", union).withColumn("both", F.size(F.array_intersect(F.array_intersect("union", "sa"), "sb")))
    least = F.when(F.size("union") < k, F.size("union") * percent / 100 - 1e-9).otherwise(F.size("union") * least_share(k, percent))
    return near.where(F.col("both") >= least).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """src, dst: the pairs (a, b) whose full sets are similar enough."""
    a = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("set").alias("sa"))
    b = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("set").alias("sb"))
    near = pairs.join(a, "a").join(b, "b").withColumn("shared", F.size(F.array_intersect("sa", "sb")))
    return near.where((F.col("shared") * 100 >= (F.col("na") + F.col("nb") - F.col("shared")) * percent)).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def labelled(lists: DataFrame, parts: DataFrame) -> DataFrame:
    return lists.join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")


def open_members(lists: DataFrame, parts: DataFrame) -> DataFrame:
    """v, id, c, lead, minor: members of the lists that still hold several components; `lead` is the list's largest one,
    `minor` are those outside it."""
    at = written(labelled(lists, parts), "labelled")
    sizes = at.groupBy("v", "c").count()
    lead = sizes.groupBy("v").agg(F.max(F.struct("count", "c")).alias("top"), F.sum("count").alias("m"), F.count("*").alias("kinds")).where("kinds > 1")
    lead = lead.select("v", "m", (F.col("m") - F.col("top.count")).alias("few"), F.col("top.c").alias("lead"))
    # Near copies share many values: of lists with the same members one is enough.
    digest = at.groupBy("v").agg(F.bit_xor(F.xxhash64("id", F.lit(1))).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(2))).alias("y"))
    lead = lead.join(digest, "v").groupBy("m", "few", "lead", "x", "y").agg(F.min("v").alias("v")).drop("x", "y")
    lead = written(lead, "lead")
    return at.join(lead, "v").select("v", "id", "c", "lead", (F.col("c") != F.col("lead")).alias("minor"))


def _marks(sketches: list[np.ndarray], values: np.ndarray) -> np.ndarray:
    """Which of `values` (sorted) each sketch has."""
    out = np.zeros((len(sketches), len(values)), np.float32)
    for i, s in enumerate(sketches):
        at = np.searchsorted(values, s)
        at[at == len(values)] = 0
        out[i, at[values[at] == s]] = 1
    return out


def _candidates(v: int, x: pd.DataFrame, y: pd.DataFrame, k: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, share) of the pairs of different components whose sizes and sketches allow the similarity
    and that meet in list `v` first: a pair is looked at in the list of the smallest value that both have listed.

    The overlap of two sketches is at least what the sketch of their union holds of both, so no pair that passes the
    estimate is left out.
    """
    xs, ys = x["sketch"].tolist(), y["sketch"].tolist()
    both = np.intersect1d(np.concatenate(xs), np.concatenate(ys))
    overlap = _marks(xs, both) @ _marks(ys, both).T
    (nx, cx, ix), (ny, cy, iy) = ([f[c].to_numpy() for c in ("n", "c", "id")] for f in (x, y))
    low, high = np.minimum(nx[:, None], ny), np.maximum(nx[:, None], ny)
    part = overlap / np.minimum(k, low)
    ok = (part >= least_share(k, percent) - 1e-6) & (low * 100 >= high * percent) & (cx[:, None] != cy)
    ok &= ~(y["minor"].to_numpy() & (ix[:, None] > iy))  # two minor members meet twice
    xp, yp = ([p[p < v] for p in f["prefix"]] for f in (x, y))
    before = np.intersect1d(np.concatenate(xp), np.concatenate(yp))
    if len(before):
        ok &= _marks(xp, before) @ _marks(yp, before).T == 0
    i, j = np.nonzero(ok)
    return i, j, part[i, j]


def _list_links(v: int, x: pd.DataFrame, y: pd.DataFrame, k: int, percent: int, root: dict[int, int]) -> list[tuple[int, int]]:
    """Links (id of x, id of y) that connect components of one list, verified on the full sets. Candidates are tried
    from the most similar on; those whose components `root` already joins are not, as nothing would change."""

    def find(c: int) -> int:
        while (up := root.setdefault(c, c)) != c:
            root[c] = c = root[up]
        return c

    i, j, part = _candidates(v, x, y, k, percent)
    xs, ys, cx, cy, ix, iy = x["set"].tolist(), y["set"].tolist(), x["c"].tolist(), y["c"].tolist(), x["id"].to_numpy(), y["id"].to_numpy()
    order, out = np.lexsort((iy[j], ix[i], -part)), []
    for r, c in zip(i[order].tolist(), j[order].tolist()):
        a, b = find(cx[r]), find(cy[c])
        if a == b:
            continue
        shared = len(np.intersect1d(xs[r], ys[c], assume_unique=True))
        if shared * 100 >= (len(xs[r]) + len(ys[c]) - shared) * percent:
            root[max(a, b)] = min(a, b)
            out.append((ix[r].item(), iy[c].item()))
    return out


def _dealt(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """v, kind, g, qs, ds: the group that each list is looked at in, and the blocks of its minor and of all its members.

    A list that needs one block is looked at in a call with others of its largest component (kind 0). Near copies share
    many larger lists: those of one largest component are cut into blocks together (kind 1), unless that sends more
    rows than each by itself (kind 2). `sizes` has the values (w) that each id is sent with.
    """
    minor = lambda c: F.when(F.col("minor"), c)
    load = [F.count("*").alias("m"), F.count(minor(F.col("w"))).alias("few"), F.sum("w").alias("all"), F.coalesce(F.sum(minor(F.col("w"))), F.lit(0)).alias("part")]
    blocks = lambda n, w: F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(w) / BLOCK_VALUES)).cast("int")
    cut = ["*", blocks("few", "part").alias("qs"), blocks("m", "all").alias("ds")]
    sent = (F.col("m") * F.col("qs") + F.col("few") * F.col("ds")).alias("sent")

    sized = members.join(sizes, "id")
    per = written(sized.groupBy("v", "lead").agg(*load).select(*cut).select("*", sent), "per")
    one = per.where("qs <= 1 and ds <= 1")
    total = one.agg(F.sum("m").alias("m"), F.sum("all").alias("all")).first()
    calls = max(1, (total["m"] or 0) // (4 * BLOCK), (total["all"] or 0) // BLOCK_VALUES)
    pieces = one.groupBy("lead").agg(F.sum("m").alias("m"), F.sum("all").alias("all")).select("lead", blocks("m", "all").alias("pieces"))
    piece = F.pmod(F.xxhash64("v"), F.col("pieces"))
    one = one.join(pieces, "lead").select("v", F.lit(0).alias("kind"), F.pmod(F.xxhash64("lead", piece), F.lit(calls)).alias("g"), F.lit(1).alias("qs"), F.lit(1).alias("ds"))

    large = per.where("qs > 1 or ds > 1")
    family = sized.join(large.select("v"), "v").select("lead", "id", "minor", "w").distinct().groupBy("lead").agg(*load).select(*cut).select("lead", "qs", "ds", sent)
    family = family.join(large.groupBy("lead").agg(F.sum("sent").alias("apart")), "lead").select("lead", F.struct("qs", "ds").alias("cut"), (F.col("sent") <= F.col("apart")).alias("together"))
    pick = lambda yes, no: F.when(F.col("together"), yes).otherwise(no)
    large = large.join(family, "lead").select("v", pick(1, 2).alias("kind"), pick(F.col("lead"), F.col("v")).alias("g"), pick(F.col("cut.qs"), F.col("qs")).alias("qs"), pick(F.col("cut.ds"), F.col("ds")).alias("ds"))
    return written(one.unionByName(large), "dealt")


def _by_list(lists: pd.Series, asked: np.ndarray) -> dict[int, list[int]]:
    """The places of the rows that each list has, of those that are `asked`."""
    out: dict[int, list[int]] = {}
    for i in np.flatnonzero(asked).tolist():
        for v in lists.iat[i]:
            out.setdefault(int(v), []).append(i)
    return out


def _meeting(members: DataFrame, known: DataFrame, sizes: DataFrame, run: Callable, schema: str) -> DataFrame:
    """`run` on the minor members and on all members of each list that meet in a block, with what is `known` of their ids.

    Minor members meet every block of their group of lists (`_dealt`). A group has as many blocks as its members or
    their values need, so a block is of bounded size whatever the table's. What is known of an id is sent to a block
    once, for all lists that the block looks at.
    """
    rows = members.join(_dealt(members, sizes), "v").groupBy("kind", "g", "id").agg(F.first("c").alias("c"), F.first("qs").alias("qs"), F.first("ds").alias("ds"), F.collect_list("v").alias("vs"), F.collect_list(F.when(F.col("minor"), F.col("v"))).alias("few"))
    spread = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int").alias(salt)
    rows = rows.select("*", spread("qs", "q"), spread("ds", "d")).join(known, "id")
    minor, n = F.size("few") > 0, F.lit(1)
    data = F.transform(F.sequence(n, F.col("qs")), lambda i: F.struct((i - 1).alias("q"), F.col("d").alias("d"), (minor & (i - 1 == F.col("q"))).alias("x"), F.lit(True).alias("y")))
    asks = F.transform(F.filter(F.sequence(n, F.col("ds")), lambda i: minor & (i - 1 != F.col("d"))), lambda i: F.struct(F.col("q").alias("q"), (i - 1).alias("d"), F.lit(True).alias("x"), F.lit(False).alias("y")))
    rows = rows.withColumn("cell", F.explode(F.concat(data, asks))).select("kind", "g", F.col("cell.q").alias("q"), F.col("cell.d").alias("d"), F.col("cell.x").alias("x"), F.col("cell.y").alias("y"), "c", "vs", "few", *known.columns)

    def lists(p: pd.DataFrame) -> pd.DataFrame:
        minors = _by_list(p["few"], np.ones(len(p), bool))
        ask, every = _by_list(p["few"], p["x"].to_numpy()), _by_list(p["vs"], p["y"].to_numpy())
        part = lambda v, at: p.iloc[at].assign(minor=np.isin(at, minors[v]))
        out = run((v, part(v, ask[v]), part(v, every[v])) for v in sorted(ask) if v in every)
        give_back()  # the marks and sets of a block are large
        return out

    return rows.groupBy("kind", "g", "q", "d").applyInPandas(lists, schema)


def cross_links(members: DataFrame, docs: DataFrame, classes: DataFrame, prefix: DataFrame, k: int, percent: int) -> DataFrame:
    """src, dst: links that connect the components which lists still hold apart; enough of them to do so."""
    known = classes.select("id", "n", "sketch").join(prefix.select("id", "prefix"), "id")
    known = written(known.join(members.select("id").distinct(), "id", "left_semi"), "known")

    def near(lists: Iterable) -> pd.DataFrame:
        out = []
        for v, x, y in lists:
            i, j, _ = _candidates(v, x, y, k, percent)
            ids = np.unique(np.r_[x["id"].to_numpy()[i], y["id"].to_numpy()[j]])
            out.append(pd.DataFrame({"v": np.full(len(ids), v), "id": ids}))
        return pd.concat(out) if out else pd.DataFrame({"v": np.zeros(0, np.int64), "id": np.zeros(0, np.int64)})

    flagged = written(_meeting(members, known, known.select("id", F.least("n", F.lit(k)).alias("w")), near, "v long, id long").distinct(), "flagged")
    if flagged.isEmpty():
        return flagged.select(F.col("v").alias("src"), F.col("id").alias("dst"))
    sets = written(full_sets(docs, classes, flagged), "sets")

    def links(lists: Iterable) -> pd.DataFrame:
        root: dict[int, int] = {}
        cut = lambda x: x.assign(sketch=[s[:k] for s in x["set"]])
        found = [p for v, x, y in lists for p in _list_links(v, cut(x), cut(y), k, percent, root)]
        return pd.DataFrame(found, columns=["src", "dst"]).astype("int64")

    members = written(members.join(flagged, ["v", "id"], "left_semi"), "members")
    whole = known.select("id", "prefix").join(sets, "id")
    return _meeting(members, whole, known.select("id", F.col("n").alias("w")), links, "src long, dst long")


def _classes_found(docs: DataFrame, percent: int, k: int) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows, and key, best of their classes of equal sets: the first row of the class's component."""
    all_ = written(sketches(docs, k), "sketches")
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    classes = all_.where("n > 0").groupBy("key").agg(lead.alias("lead"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("id"), "key", "lead", F.col("lead.doc_id").alias("doc"), "n", "sketch"), "classes")
    prefix = written(prefixes(classes, k, percent), "prefixes")
    lists = prefix.select("id", F.explode("prefix").alias("v"))
    several = written(lists.groupBy("v").count().where("count > 1").select("v"), "several")
    lists = written(lists.join(several, "v"), "lists")

    order = F.struct(F.xxhash64("id", "v"), "id")
    pivots = lists.groupBy("v").agg(F.array_distinct(F.array(F.min("id"), F.min(order)["id"])).alias("p")).select("v", F.explode("p").alias("p"))
    pairs = lists.join(written(pivots, "pivots"), "v").where("id <> p").select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).distinct()
    pairs = written(estimated(pairs, classes, k, percent), "pairs")
    sets = written(full_sets(docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("id"))), "sets")
    links = written(verified(pairs, sets, percent), "links")
    parts = written(components(links), "parts")
    members = written(open_members(lists, parts), "open")
    if not members.isEmpty():
        more = written(cross_links(members, docs, classes, prefix, k, percent), "links")
        if not more.isEmpty():
            parts = written(components(links.unionByName(more)), "parts")

    node = classes.join(parts.withColumnRenamed("node", "id"), "id", "left").select("key", "lead", F.coalesce("component", "id").alias("part"))
    node = written(node, "nodes")
    best = written(node.groupBy("part").agg(F.min("lead").alias("best")), "best")
    return all_, written(node.join(best, "part").select("key", "best"), "found")


def grouped(docs: DataFrame, percent: int, k: int) -> DataFrame:
    """row, doc_id, n, component, first of every row of `docs` (row, doc_id, text): the smallest doc_id of the row's
    component (null if no row of it has one), and whether the row is the component's first by (doc_id, row), null last.
    """
    with freed(docs.sparkSession):
        all_, found = _classes_found(docs, percent, k)
    out = all_.select("row", "doc_id", "n", F.when(F.col("n") > 0, F.col("key")).alias("key")).join(found, "key", "left")
    component = F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id"))
    return out.select("row", "doc_id", "n", component.alias("component"), (F.coalesce(F.col("best.row"), F.col("row")) == F.col("row")).alias("first"))


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document, one row per input row.

    Words are lower-cased for A-Z; the set of a text with fewer than five words is the whole sequence. A null or
    empty text has no set and links with nothing; equal sets are one class from the start; ties in the order of
    values are broken by value; an empty table gives an empty result; columns other than doc_id and text are not
    looked at. Rows are judged by their own texts, so rows that share a doc_id may be in different components, and
    all rows with the component's doc_id are kept. A row without a doc_id belongs to its component like any other,
    and is not kept where that has a doc_id.
    """
    got = grouped(docs.select(F.lit(0).cast("long").alias("row"), "doc_id", "text"), percent, k)
    kept = F.coalesce(F.col("doc_id") == F.col("component"), F.col("component").isNull())
    return got.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))


def distinct_documents(docs: DataFrame, percent: int = 85, k: int = K) -> DataFrame:
    """One row of every component: the first by doc_id (null last), of several with that id any one; columns as given.

    Rows are numbered and written once, so copies that share a doc_id or have none go like any others. Rows without
    words are kept.
    """
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    first = written(grouped(rows.select(F.col("__row").alias("row"), "doc_id", "text"), percent, k).where("first").select(F.col("row").alias("__row")), "first")
    return rows.join(first, "__row", "left_semi").select(*docs.columns)
