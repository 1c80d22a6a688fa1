"""The Merkle manifest against trees built one node at a time, and the multiproof on its own."""

import random
import zlib
from hashlib import sha256

from vistrack.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos long, h string, n long, block long, level int, row long, leaf string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2, 3, 4, 5, "z") for r in rows], SCHEMA)


def leaf_of(r, more=0):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    i, source, lang, n, text = r
    return h(*map(field, (i, source, lang, n + more if n is not None else None, text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def brute(rows):
    langs = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))):
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: levels([leaf_of(r) for r in v]) for k, v in langs.items()}
    top = levels([trees[k][-1][0] for k in order])
    out = []
    for k, v in langs.items():
        for p, r in enumerate(v):
            hit = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            x, proof = leaf_of(r, int(hit)), []
            for tree, at in ((trees[k], p), (top, order.index(k))):
                for nodes in tree[:-1]:
                    other = nodes[at ^ 1] if at ^ 1 < len(nodes) else ""
                    proof.append(other)
                    x, at = h(other, x) if at & 1 else h(x, other), at >> 1
            out.append((r[0], leaf_of(r), trees[k][-1][0], top[-1][0], h(*proof), x, x == top[-1][0]))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in df.collect()), key=str)


def test_equals_trees_built_node_by_node(spark):
    rng = random.Random(12)
    rows = [(i, rng.choice("ab"), rng.choice(["en", "en", "de", None, "", "é", "Z"]), i, "word " * rng.randrange(9)) for i in range(300)]
    rows += [(7, "a", "en", 7, "again")] * 3 + [(None, None, None, None, None)] * 2 + [(2**62 + 1, "a", "en", 2**63 - 1, "é" * 100_000), (999, "", "xx", None, "")]
    assert found(merkle.merkle_manifest(docs(spark, rows))) == brute(rows)


def test_trees_of_several_bands(spark):
    rows = [(i, "s", "en" if i % 3 else "fr", 1, f"t{i}") for i in range(13_001)]  # en: two bands of levels
    assert found(merkle.merkle_manifest(docs(spark, rows))) == brute(rows)


def test_one_row_and_none(spark):
    rows = [(1, "s", "en", 5, "hello")]
    assert found(merkle.merkle_manifest(docs(spark, rows))) == brute(rows)
    assert merkle.merkle_manifest(docs(spark, [])).count() == 0


def test_proofs_of_some_leaves(spark):
    rows = [(i, "s", "en" if i % 4 else "fr", 1, f"t{i}") for i in range(900)]
    m = merkle.manifest(docs(spark, rows))
    got = found(merkle.audited(m, "doc_id % 11 = 3 or doc_id between 70 and 80"))
    assert got == [r for r in brute(rows) if r[0] % 11 == 3 or 70 <= r[0] <= 80]


def test_a_multiproof_is_minimal_and_enough():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randrange(1, 70)
        nodes = levels([h(str(i)) for i in range(n)])
        asked = sorted(rng.sample(range(n), rng.randrange(1, n + 1)))
        need = merkle.lacking(asked, n)
        derived = merkle.expand({p: nodes[0][p] for p in asked}, n, {(a, b): nodes[a][b] for a, b in need})
        assert derived[-1] == {0: nodes[-1][0]}
        # none of the missing nodes covers an asked leaf or lies under another, so none could be derived or left out
        spans = [(b << a, (b + 1) << a) for a, b in need]
        assert not any(lo <= p < hi for p in asked for lo, hi in spans)
        assert sum(min(hi, n) - lo for lo, hi in spans) + len(asked) == n
