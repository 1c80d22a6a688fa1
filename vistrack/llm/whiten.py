"""Whitening of embeddings by shifted CholeskyQR.

Each pass over the distinct vectors takes the Gram matrix of the centred rows as they are orthogonalised so far; its
Cholesky factor joins the chain that the next pass solves through, row by row, by substitution. The first matrix is
shifted by the rounding errors it may hold, which brings the rows' condition within reach of the next pass; a later one
only if it isn't positive definite in double precision. When the rows are orthonormal (or vanish, in directions that no vector has) the product of the factors is the R of
the rows' QR decomposition, and its singular vectors and values are those of all rows: nothing is squared on the way.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Passes at most; a Gram matrix this near to the identity is one.
PASSES, NEAR = 12, 1e-12
#: A direction with less than this share of a unit row is one that no vector has.
VOID = 1e-8
LONG = 2**63 - 1


def batches(frames, column: str):
    """Arrow batches of integer vectors as arrays (rows, d)."""
    for f in frames:
        if len(f):
            yield f, np.array(f[column].tolist(), np.int64)


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """x - total / n. n x - total is taken in whole numbers where it fits, so that no large mean takes digits away."""
    if n * int(np.abs(x.astype(np.float64)).max(initial=0)) + max(map(abs, total)) < 2**62:
        return (n * x - np.array(total, np.int64)) / n
    return np.array([[float(n * int(v) - s) / n for v, s in zip(row, total)] for row in x])


def solved(c: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """c times the inverses of upper triangular factors, one after another, by substitution over the columns."""
    for r in factors:
        q = np.empty_like(c)
        for j in range(len(r)):
            q[:, j] = (c[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
        c = q
    return c


def summed(parts: DataFrame, ways: int = 16) -> DataFrame:
    """Sums of equally long arrays `cells` by `row`, in two steps: a row's arrays meet in `ways` groups first."""

    def add(f: pd.DataFrame) -> pd.DataFrame:
        return f.head(1).assign(cells=[np.sum(f["cells"].tolist(), axis=0)])

    some = parts.withColumn("way", F.pmod(F.monotonically_increasing_id(), F.lit(ways)).cast("int"))
    some = some.groupBy("row", "way").applyInPandas(add, "row int, cells array<double>, way int")
    return some.groupBy("row").applyInPandas(add, "row int, cells array<double>, way int").select("row", "cells")


def gram(fit: DataFrame, rows_of, d: int) -> np.ndarray:
    """The Gram matrix of rows_of(vectors), d wide: partial matrices are sent, never rows."""

    def part(frames):
        g = np.zeros((d, d))
        for _, x in batches(frames, "x"):
            q = rows_of(x)
            g += q.T @ q
        yield pd.DataFrame({"row": np.arange(d, dtype=np.int32), "cells": list(g)})

    g = np.zeros((d, d))
    for r in summed(fit.select("x").mapInPandas(part, "row int, cells array<double>")).collect():  # d rows
        g[r["row"]] = r["cells"]
    return g


def totals(fit: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and the sum of each component, exact: a long is summed in two halves."""

    def part(frames):
        for _, x in batches(frames, "x"):
            yield pd.DataFrame({"pos": np.arange(x.shape[1], dtype=np.int32), "n": len(x), "high": (x >> 32).sum(0), "low": (x & (2**32 - 1)).sum(0)})

    of = fit.select("x").mapInPandas(part, "pos int, n long, high long, low long")
    big = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    got = sorted(of.groupBy("pos").agg(F.sum("n").alias("n"), big("high"), big("low")).collect(), key=lambda r: r["pos"])  # d rows
    return (got[0]["n"] if got else 0), [int(r["high"]) * 2**32 + int(r["low"]) for r in got]


def cholesky_qr(fit: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """R with R'R = C'C for the centred vectors C, as the product of the passes' factors."""
    d, factors = len(total), []
    for _ in range(PASSES):
        g = gram(fit, lambda x, f=tuple(factors): solved(centred(x, n, total), f), d)
        e, v = np.linalg.eigh((g + g.T) / 2)
        settled = np.where(e > VOID, np.abs(e - 1), 0).max() < NEAR * d
        if factors and settled:
            break
        top = float(e[-1])
        if top <= 0:  # no vector differs from the mean
            return np.zeros((d, d))
        least = 11 * d * (d + 1) * np.finfo(float).eps * top
        shift = 0.0 if factors else least
        while True:
            try:
                factors.append(np.linalg.cholesky(g + shift * np.eye(d)).T)
                break
            except np.linalg.LinAlgError:
                shift = max(shift * 10, least)
    # what is left of the last Gram matrix; the identity but for directions that no vector has
    r = np.sqrt(np.maximum(e, 0))[:, None] * v.T
    for f in reversed(factors):
        r = r @ f
    return r


def principal(r: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(directions (d, k), eigenvalues (k), trace) of the covariance R'R / n; directions without variance are left out.
    The largest entry of a direction is positive."""
    _, s, vt = np.linalg.svd(r)
    e = s * s / n
    keep = (np.arange(len(e)) < k) & (s > s.max(initial=0) * VOID)
    v = vt[keep].T
    if v.size:
        v = v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])
    return v, e[keep], math.fsum(e)


def whole_numbers(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id and x = floor(scale * c) of the vectors without null or non-finite entries; x saturates as a long."""
    c = F.col("c")
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("c"))
    v = v.where((F.size(c) > 0) & F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))
    lim = float(2**62)  # far beyond what doubles tell apart
    return v.select("vec_id", F.transform(c, lambda e: F.floor(F.greatest(F.lit(-lim), F.least(F.lit(lim), e * scale))).cast("long")).alias("x"))


def whitened(vectors: DataFrame, k: int = 4, scale: int = 256) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row per vector and component.

    The fit is on each distinct integer vector once. A null or empty vector, or one with a null or non-finite entry, is
    dropped; where vectors differ in length, those of the commonest length take part (of the longest of these); numbers
    beyond 2**62 are held there. A deviation beyond a long is null. Repeated rows get rows each; a row without
    vec_id is kept. There are no components, and no rows, beyond the directions that vectors vary in: none for an empty
    table or equal vectors. Columns other than vec_id and embedding are not looked at.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    x = whole_numbers(vectors, scale)
    fit = written(x.select("x").distinct(), "fit")
    length = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    x, fit = (t.where(F.size("x") == (length["d"] if length else 0)) for t in (x, fit))
    n, total = totals(fit)
    if n < 2:
        return vectors.sparkSession.createDataFrame([], schema)
    v, e, trace = principal(cholesky_qr(fit, n, total), n, k)
    m = len(e)
    if not m:
        return vectors.sparkSession.createDataFrame([], schema)
    white = lambda x: centred(x, n, total) @ v / np.sqrt(e)
    mean = gram(fit, lambda x: np.c_[np.ones(len(x)), white(x)], m + 1) / n
    error = float(np.abs(mean[1:, 1:] - np.outer(mean[0, 1:], mean[0, 1:]) - np.eye(m)).max())

    def run(frames):
        for f, x in batches(frames, "x"):
            w, top = white(x), n * int(np.abs(x.astype(np.float64)).max()) + max(map(abs, total))
            if top * top * len(total) < LONG:
                off = n * x - np.array(total, np.int64)
                far = (off * off).sum(1).tolist()
            else:
                far = [sum((n * int(c) - s) ** 2 for c, s in zip(row, total)) for row in x]
            yield pd.DataFrame({
                "vec_id": np.repeat(f["vec_id"].to_numpy(), m), "component": np.tile(np.arange(1, m + 1, dtype=np.int32), len(f)), "n": n,
                "deviation": pd.array([g if g <= LONG else None for g in far for _ in range(m)], "Int64"),
                "whitened": w.ravel(), "explained": np.tile(e / trace, len(f)), "identity_error": error,
            })

    out = x.withColumn("vec_id", F.col("vec_id").cast("string"))  # pandas has no long with nulls
    return out.mapInPandas(run, schema.replace("vec_id long", "vec_id string")).withColumn("vec_id", F.col("vec_id").cast("long"))
