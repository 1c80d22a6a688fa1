"""A Merkle manifest of a dataset, and membership proofs of its rows by multiproofs.

Rows are leaves of one tree per language; the roots of those are the leaves of the tree above. Trees are built in bands
of BAND levels, a block of 2**BAND neighbours in one task, so a tree of any size takes a few rounds and its nodes are
written once. Proofs are made a leaf partition (the asked leaves of a block) at a time: the partition finds the
smallest set of nodes that its leaves lack altogether, these are fetched by one join, every shared inner node is derived
once from what is below it, and the proofs of single leaves are read off inside the task.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .common import small, written

BAND = 12
#: The tree above the languages' trees; a language's tree is named "-" for null and "=" with its name else.
TOP = "top"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@dataclass
class Manifest:
    """leaves (doc_id, leaf, tampered, tree, pos, n), inner nodes by band of levels (tree, level, pos, h), trees (tree,
    subroot, root, path: the siblings from the subroot up, each with its side, or "-" where there is none)."""

    leaves: DataFrame
    bands: list[DataFrame]
    trees: DataFrame


def joined(*texts: str) -> str:
    """H: the lowercase hexadecimal SHA-256 of the texts one after another."""
    return sha256("".join(texts).encode()).hexdigest()


def _field(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, tree, leaf, tampered (null where the row isn't tampered with); texts are hashed where they lie."""
    digest = lambda **other: F.sha2(F.concat(*(_field(other.get(c, F.col(c))) for c in FIELDS)), 256)
    more = F.try_add(F.col("n_chars").cast("long"), F.lit(1).cast("long"))
    hit = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & more.isNotNull()
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-"))
    return docs.select("doc_id", tree.alias("tree"), digest().alias("leaf"), F.when(hit, digest(n_chars=more)).alias("tampered"))


def _band(f: pd.DataFrame) -> pd.DataFrame:
    """The nodes above a block of neighbours, up to BAND levels or the tree's root."""
    f = f.sort_values("pos")
    tree, level, n, h = f["tree"].iloc[0], int(f["level"].iloc[0]), int(f["n"].iloc[0]), f["h"].tolist()
    at, out = int(f["pos"].iloc[0]), []
    for k in range(1, BAND + 1):
        if n == 1:
            break
        h, n, at = [joined(*h[i : i + 2]) for i in range(0, len(h), 2)], (n + 1) // 2, at // 2
        out.append(pd.DataFrame({"tree": tree, "level": level + k, "pos": np.arange(at, at + len(h)), "n": n, "h": h}))
    return pd.concat(out) if out else pd.DataFrame({"tree": [], "level": [], "pos": [], "n": [], "h": []})


NODE = "tree string, level int, pos long, n long, h string"


def nodes(leaf: DataFrame) -> list[DataFrame]:
    """Inner nodes above leaves (tree, pos, n, h), one written table per band."""
    at, level, bands = leaf.select("tree", F.lit(0).alias("level"), "pos", "n", "h"), 0, []
    most = leaf.agg(F.max("n")).first()[0] or 0
    while most > 1:
        at = at.where("n > 1").withColumn("block", F.shiftright("pos", BAND))
        bands.append(written(at.groupBy("tree", "block").applyInPandas(_band, NODE), f"band{len(bands)}"))
        level, most = level + BAND, (most - 1 >> BAND) + 1
        at = bands[-1].where(F.col("level") == level)
    return bands


def lacking(pos: list[int], n: int) -> list[tuple[int, int]]:
    """(level, pos) of the fewest nodes that, with the leaves at `pos` of a tree of n leaves, give its root: the
    siblings of what is known or can be derived, level by level."""
    out, known, level = [], sorted(set(pos)), 0
    while n > 1:
        have = set(known)
        out += [(level, p ^ 1) for p in known if p ^ 1 < n and p ^ 1 not in have]
        known, n, level = sorted({p >> 1 for p in known}), (n + 1) // 2, level + 1
    return out


def _lacking(f: pd.DataFrame) -> pd.DataFrame:
    """A partition's missing nodes, and one row at level -1 for the partition itself."""
    need = [(-1, 0), *lacking(f["pos"].tolist(), int(f["n"].iloc[0]))]
    return pd.DataFrame({"tree": f["tree"].iloc[0], "block": f["block"].iloc[0], "level": [a for a, _ in need], "pos": [b for _, b in need]})


def expand(known: dict[int, str], n: int, fetched: dict[tuple[int, int], str]) -> list[dict[int, str]]:
    """Per level the nodes that are known: leaves, what was fetched, and what follows from the two."""
    levels, level = [], 0
    while n > 1:
        at = dict(known)
        for p in known:
            if p ^ 1 < n and p ^ 1 not in at:
                at[p ^ 1] = fetched[level, p ^ 1]
        levels.append(at)
        known = {p: joined(at[2 * p], at.get(2 * p + 1, "")) for p in {p >> 1 for p in known}}
        n, level = (n + 1) // 2, level + 1
    return [*levels, known]


def fold(h: str, pos: int, levels: list[dict[int, str]], path: list[str]) -> str:
    """The root that leaf h at `pos` leads to, with the siblings in `levels`, and then those in `path`."""
    for at in levels[:-1]:
        other = at.get(pos ^ 1, "") if pos ^ 1 != pos else ""
        h, pos = joined(other, h) if pos & 1 else joined(h, other), pos >> 1
    return fold_path(h, path)


def fold_path(h: str, path: list[str]) -> str:
    for step in path:
        h = joined(h) if step == "-" else joined(step[1:], h) if step[0] == "L" else joined(h, step[1:])
    return h


def _partition(asked: pd.DataFrame, got: pd.DataFrame) -> tuple[list[dict[int, str]], str, list[str]]:
    """The known nodes of a leaf partition by level, the root above and the path to it."""
    fetched = {(a, b): h for a, b, h in zip(got["level"], got["pos"], got["h"]) if a >= 0}
    own = got[got["level"] < 0].iloc[0]
    return expand(dict(zip(asked["pos"].tolist(), asked["h"])), int(asked["n"].iloc[0]), fetched), own["h"], list(own["path"])


def _paths(asked: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
    """Each asked leaf's siblings with their sides."""
    levels, _, _ = _partition(asked, got)
    paths = []
    for pos in asked["pos"].tolist():
        steps = []
        for at in levels[:-1]:
            steps.append("-" if pos ^ 1 not in at else ("L" if pos & 1 else "R") + at[pos ^ 1])
            pos >>= 1
        paths.append(steps)
    return pd.DataFrame({"leaf_tree": asked["leaf_tree"], "subroot": asked["h"], "root": levels[-1][0], "path": paths})


def _audit(asked: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
    """What audited() returns, of one leaf partition."""
    levels, root, path = _partition(asked, got)
    subroot = levels[-1][0]
    above = "".join(step[1:] for step in path)
    proofs: list[dict[int, str]] = [{0: above}]
    for below, at in zip(levels[-2::-1], levels[:0:-1]):  # a leaf's proof is its sibling's digest and its parent's proof
        proofs.append({p: below.get(p ^ 1, "") + up for p in below if (up := proofs[-1].get(p >> 1)) is not None})
    derived, pos = fold_path(subroot, path), asked["pos"].tolist()
    folded = [derived if t is None else fold(t, p, levels, path) for p, t in zip(pos, asked["tampered"])]
    return pd.DataFrame({
        "doc_id": asked["doc_id"], "leaf": asked["h"], "subroot": subroot, "root": root,
        "proof_sha256": [joined(proofs[-1][p]) for p in pos], "folded_root": folded, "verified": [x == root for x in folded],
    })


def _proved(asked: DataFrame, leaf: DataFrame, bands: list[DataFrame], trees: DataFrame, run, schema: str) -> DataFrame:
    """`run` on every leaf partition of `asked` (tree, pos, n, h, ...) with the nodes that it lacks and its row of
    `trees` (tree, root, path) at level -1. The nodes of a band are joined by their place; bands far up are small."""
    asked = asked.withColumn("block", F.shiftright("pos", BAND))
    lack = written(asked.select("tree", "block", "pos", "n").groupBy("tree", "block").applyInPandas(_lacking, "tree string, block long, level int, pos long"), "lacking")
    none = F.lit(None).cast("array<string>").alias("path")
    got = lack.where("level < 0").join(small(trees.select("tree", F.col("root").alias("h"), "path")), "tree").select("tree", "block", "level", "pos", "h", "path")
    for k, (band, first) in enumerate([(leaf.select("tree", F.lit(0).alias("level"), "pos", "h"), 0), *((b.select("tree", "level", "pos", "h"), BAND * i + 1) for i, b in enumerate(bands))]):
        need = lack.where(F.col("level").between(first, 0 if k == 0 else first + BAND - 1))
        if not need.isEmpty():
            got = got.unionByName(need.join(small(band), ["tree", "level", "pos"]).select("tree", "block", "level", "pos", "h", none))
    by = ["tree", "block"]
    return asked.groupBy(*by).cogroup(got.groupBy(*by)).applyInPandas(run, schema)


def manifest(docs: DataFrame) -> Manifest:
    """The trees over all rows of `docs` (doc_id, source, lang, n_chars, text), written to the shared folder.

    Leaves ascend by doc_id in their language, null first; rows that share a doc_id by their digest. Rows equal in all
    are leaves of their own. An empty table has no tree. Other columns are not looked at.
    """
    rows = written(leaves(docs).withColumn("row", F.monotonically_increasing_id()), "leaves")
    leaf = numbered(rows, ["tree"], ["doc_id", "leaf", "row"], "pos", "n").withColumnRenamed("leaf", "h").drop("row")
    leaf = written(leaf, "numbered")
    bands = nodes(leaf)
    tops = leaf.where("n = 1").select("tree", "h")
    for band in bands:
        tops = tops.unionByName(band.where("n = 1").select("tree", "h"))
    top = written(numbered(tops, [], ["tree"], "pos", "n").select(F.lit(TOP).alias("tree"), F.col("tree").alias("leaf_tree"), "pos", "n", "h"), "subroots")
    own = top.where("pos = 0").select("tree", F.lit("").alias("root"), F.array().cast("array<string>").alias("path"))
    trees = _proved(top, top, nodes(top), own, _paths, "leaf_tree string, subroot string, root string, path array<string>")
    return Manifest(leaf, bands, written(trees.withColumnRenamed("leaf_tree", "tree"), "trees"))


def audited(m: Manifest, asked: str = "true") -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of the leaves that meet `asked`.

    folded_root is what the leaf, tampered with where the manifest says so, gives with the original siblings.
    """
    schema = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    leaf = m.leaves.where(asked).withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas has no long with nulls
    out = _proved(leaf, m.leaves, m.bands, m.trees, _audit, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """audited() for every row of `docs`, one row each.

    Null fields are hashed as `-`, a row without a doc_id or n_chars is never tampered with, nor one whose n_chars is the
    largest long. Empty and very long texts are hashed whole, equal rows are leaves side by side, a lone leaf is its own
    root with the proof of nothing, and an empty table gives an empty result.
    """
    return audited(manifest(docs))
