"""Whitening and posting lists against numpy on all rows."""

import numpy as np
import pytest
from vistrack.llm import postings, whiten

SCHEMA = "vec_id long, embedding array<float>, x string, vector string, n string, list string, rid string, component string, need string"


def table(spark, vectors, ids=None):
    rows = [(i if ids is None else ids[i], None if v is None else [None if c is None else float(c) for c in v], *"abcdefg") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA)


# --- whitening


def check_whitening(spark, raw, exact=1e-9):
    got = whiten.whitened(table(spark, raw)).toPandas()
    x = np.floor(256 * np.asarray(raw, np.float32).astype(float)).astype(np.int64)
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    c = (n * u - s) / n
    _, e, v = np.linalg.svd(c, full_matrices=False)  # squares nothing, as eigh of the covariance would
    e, v = e * e / n, v.T
    m = min(4, int((e > e[0] * 1e-13).sum()))
    assert len(got) == m * len(x) and set(got.n) == {n} and got.identity_error.max() < 1e-4
    w = got.pivot(index="vec_id", columns="component", values="whitened").loc[range(len(x))].to_numpy()
    want = (n * x - s) / n @ v[:, :m] / np.sqrt(e[:m])
    want *= np.sign((want * w).sum(0))
    assert np.abs(w - want).max() < exact * np.abs(want).max()
    assert np.allclose(got.groupby("component").explained.first(), e[:m] / e.sum(), rtol=1e-8)
    far = got[got.component == 1].set_index("vec_id").deviation.loc[range(len(x))].to_numpy()
    assert (far == [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]).all()


def test_whitening_equals_eigenvectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 6)) * [1, 5, 0.5, 2, 3, 0.2] + 40
    check_whitening(spark, np.concatenate([x, x[:50], np.repeat(x[:1], 150, 0)]))


def test_whitening_where_directions_are_missing_or_thin(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(300, 2)) * 30
    check_whitening(spark, np.c_[a, a[:, :1] * 2, np.ones(300)], 1e-7)  # two and a bit of three dimensions
    check_whitening(spark, rng.normal(size=(300, 5)) * [1e4, 1, 1e-1, 1e3, 10] + 1000, 1e-7)
    check_whitening(spark, rng.normal(size=(9, 12)))  # fewer vectors than dimensions


def test_whitening_of_odd_rows(spark):
    assert whiten.whitened(table(spark, [])).count() == 0
    assert whiten.whitened(table(spark, [[1, 2], [1, 2]])).count() == 0  # no direction varies
    odd = [None, [], [1, None], [float("nan"), 1], [float("inf"), 0], [1, 2, 3], [1e30, -1e30], [1, 2], [4, -2], [1, 2], [-0.0, 0]]
    got = whiten.whitened(table(spark, odd, [0, 1, 2, 3, 4, 5, 6, None, 8, 9, 2**62 + 1])).collect()
    assert {r.vec_id for r in got} == {6, None, 8, 9, 2**62 + 1} and {r.n for r in got} == {4}
    assert [r.deviation for r in got if r.vec_id == 6] == [None] * len({r.component for r in got})


# --- posting lists


def exact(x, ids, q, k):
    s = (x * x[q]).sum(1)
    at = np.lexsort((ids, -s))
    return [(int(ids[j]), float(s[j])) for j in at if ids[j] != ids[q]][:k]


def test_posting_lists_find_nine_of_ten(spark):
    rng = np.random.default_rng(13)
    centres = rng.normal(size=(12, 8))
    x = (centres[rng.integers(0, 12, 3000)] + 0.3 * rng.normal(size=(3000, 8))).astype(np.float32)
    x[:900] *= rng.uniform(0.5, 3, (900, 1)).astype(np.float32)  # lengths differ
    got = postings.nearest(table(spark, x)).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(range(0, 3000, 20))
    ids, hits = np.arange(3000), 0
    for q, rows in by.items():
        assert [r["rank"] for r in rows] == list(range(1, 21)) and q not in [r.vec_id for r in rows]
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        for r in rows:
            assert r.score == pytest.approx(float(x[q].astype(float) @ x[r.vec_id].astype(float)), rel=1e-12)
        hits += len({i for i, _ in exact(x.astype(float), ids, q, 20)} & {r.vec_id for r in rows})
    assert hits >= 0.9 * 20 * len(by) and got[0].recall >= 0.95


def test_posting_lists_with_a_hot_vector(spark):
    """A third of the rows are one vector; ties go to the smaller ids, under each query's own id left out."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 6)).astype(np.float32)
    x[:200] = 30 * x[0] / np.linalg.norm(x[0])
    got = postings.nearest(table(spark, x)).collect()
    for q in range(0, 200, 20):
        mine = [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])]
        assert mine == [i for i, _ in exact(x.astype(float), np.arange(600), q, 20)] == [i for i in range(22) if i != q][:20]


def test_posting_lists_of_odd_rows(spark):
    assert postings.nearest(table(spark, [])).count() == 0
    assert postings.nearest(table(spark, [[1, 2]], [1])).count() == 0  # nobody asks
    odd = [None, [], [1, None], [0, 0], [float("nan"), 1], [1, 2, 3], [3, 4], [1, 0], [1, 0], [0, 2], [2, 2]]
    ids = [20, 40, 60, 80, 100, 120, 140, 7, 7, None, 140]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in postings.nearest(table(spark, odd, ids)).collect())
    # 140 asks with two vectors; its own rows are no candidates, the repeated row is one twice
    assert got == [(140, 1, 7, 2.0), (140, 1, 7, 3.0), (140, 2, 7, 2.0), (140, 2, 7, 3.0)]
    big = postings.nearest(table(spark, [[1e38, 1e38], [1e38, 0], [0, -1e38]], [20, 1, 2])).collect()
    assert [r.vec_id for r in sorted(big, key=lambda r: r["rank"])] == [1, 2]
