"""Descriptor vectors: array columns, whole Arrow batches at a time where built-in functions don't do."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDE, ZONES, ORIENTATIONS = 16, 4, 16


def _sum(v: Column, f) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + f(x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def patch_stats(v: Column) -> tuple[Column, Column]:
    """Mean, and the root of the summed squared deviation (not divided by n)."""
    mean = _sum(v, lambda x: x) / F.size(v)
    return mean, F.sqrt(F.greatest(F.lit(0.0), _sum(v, lambda x: x * x) - F.size(v) * mean * mean))


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)


def descriptor_correl(a: Column, b: Column, middle: float = 0.5) -> Column:
    """Cosine of the vectors less `middle`; null if one is all middle."""
    x, y = F.transform(a, lambda v: v.cast("double") - middle), F.transform(b, lambda v: v.cast("double") - middle)
    return dot(x, y) / F.nullif(F.sqrt(dot(x, x) * dot(y, y)), F.lit(0.0))


def _rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Equally long lists without nulls as an array (rows, n), without a copy by rows."""
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def patch_units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each patch (rows of x) less its floored mean and over its deviation, so that the product of two is their patch_ncc,
    and which ones have a deviation of 1 or more; others correlate with nothing and are zeros."""
    mean = x.mean(1, keepdims=True)
    sd = np.sqrt(np.maximum(0, (x * x).sum(1) - x.shape[1] * mean[:, 0] ** 2))
    ok = sd >= 1
    return np.where(ok[:, None], (x - np.floor(mean)) / np.where(ok, sd, 1)[:, None], 0.0), ok


def patch_ncc(a: Column, b: Column, word_a: Column | None = None, word_b: Column | None = None) -> Column:
    """Normalised cross-correlation about the floored means; 0 if a deviation is below 1, 0.95 for one valid word."""
    (ma, sa), (mb, sb) = patch_stats(a), patch_stats(b)
    x, y = F.transform(a, lambda v: v.cast("double") - F.floor(ma)), F.transform(b, lambda v: v.cast("double") - F.floor(mb))
    ncc = F.when((sa < 1) | (sb < 1), 0.0).otherwise(F.try_divide(dot(x, y), sa * sb))
    return ncc if word_a is None else F.when((word_a == word_b) & (word_a != 0), 0.95).otherwise(ncc)


#: Fixed values of the soft weights: how fast they fall with the fourth power of the distance from the middle (7, 7), in
#: half patches, and of the angle from a sector's middle, in half sectors.
RADIAL, SECTOR = 1.8, 1.5


@lru_cache(1)
def _patch_tables() -> tuple[np.ndarray, np.ndarray]:
    """Per pixel: weight of each of the four zones, which are the quarter turns around the middle; a pixel counts for
    its own and the nearer one beside it. And the radial weight."""
    at = np.arange(SIDE) - (SIDE / 2 - 1)
    x, y = np.meshgrid(at, at)
    turn = np.mod(np.arctan2(y, x) / (2 * np.pi) * ZONES, ZONES)
    own = np.floor(turn).astype(int) % ZONES
    off = 2 * (turn - np.floor(turn) - 0.5)  # from -1 to 1 across a sector
    beside = np.where(off < 0, own - 1, own + 1) % ZONES
    fall = lambda d: np.exp(-SECTOR * d**4)
    zones = np.stack([np.where(own == z, fall(np.abs(off)), 0) + np.where(beside == z, fall(1 - np.abs(off)), 0) for z in range(ZONES)])
    return zones, np.exp(-RADIAL * ((x * x + y * y) / (SIDE / 2) ** 2) ** 2)


def orientation_histograms(patches: np.ndarray) -> np.ndarray:
    """(n, 4, 16) from (n, 16, 16): central differences, each pixel's gradient length shared between the two nearest
    orientations and the zones."""
    n = len(patches)
    gx, gy = np.zeros_like(patches), np.zeros_like(patches)
    gx[:, 1:-1, 1:-1] = (patches[:, 1:-1, 2:] - patches[:, 1:-1, :-2]) / 2
    gy[:, 1:-1, 1:-1] = (patches[:, 2:, 1:-1] - patches[:, :-2, 1:-1]) / 2
    zones, radial = _patch_tables()
    length = np.hypot(gx, gy) * radial
    angle = np.mod(np.arctan2(gy, gx), 2 * np.pi) * ORIENTATIONS / (2 * np.pi)
    low = np.floor(angle).astype(int) % ORIENTATIONS
    part = angle - np.floor(angle)
    out = np.zeros((n, ZONES, ORIENTATIONS))
    for o in range(ORIENTATIONS):
        w = length * (np.where(low == o, 1 - part, 0) + np.where((low + 1) % ORIENTATIONS == o, part, 0))
        out[:, :, o] = np.einsum("nij,zij->nz", w, zones)
    return out


def dominant_orientations(histograms: np.ndarray) -> np.ndarray:
    """Angle in [0, 2 pi): the last of the highest bins of the summed zones, moved to the top of the parabola through
    it and its neighbours where that is finite."""
    s = histograms.sum(1)
    k = ORIENTATIONS - 1 - s[:, ::-1].argmax(1)
    row = np.arange(len(s))
    l, m, r = s[row, k - 1], s[row, k], s[row, (k + 1) % ORIENTATIONS]
    with np.errstate(all="ignore"):
        shift = (l - r) / (2 * (l - 2 * m + r))
    return np.mod((k + np.where(np.isfinite(shift), shift, 0)) * 2 * np.pi / ORIENTATIONS, 2 * np.pi)


@lru_cache(1)
def _tests() -> np.ndarray:
    return np.random.default_rng(16).integers(0, ZONES * ORIENTATIONS, 16)


def binary_signatures(histograms: np.ndarray, angle: np.ndarray) -> np.ndarray:
    """16 bits: bit i is set if the i-th tested cell, its zone and orientation turned by the dominant one, is above 1/64
    of the total; so a turned patch has the same bits. Usable as a blocking key."""
    cell = _tests()
    turned = lambda i, n: (i + np.floor(angle * n / (2 * np.pi)).astype(int)[:, None]) % n
    value = histograms[np.arange(len(histograms))[:, None], turned(cell // ORIENTATIONS, ZONES), turned(cell % ORIENTATIONS, ORIENTATIONS)]
    return ((value > histograms.sum((1, 2))[:, None] / 64) << np.arange(16)).sum(1)


def described_patches(rows: DataFrame, key: str = "id", column: str = "patch") -> DataFrame:
    """key, histo, total, orientation, signature of 256-number patches."""

    def run(frames):
        for f in frames:
            h = orientation_histograms(np.array(f[column].tolist(), float).reshape(-1, SIDE, SIDE))
            angle = dominant_orientations(h)
            yield pd.DataFrame({key: f[key], "histo": list(h.reshape(len(h), -1)), "total": h.sum((1, 2)), "orientation": angle, "signature": binary_signatures(h, angle).astype("int32")})

    return rows.select(key, column).mapInPandas(run, f"{key} long, histo array<double>, total double, orientation double, signature int")


def equalised(x: np.ndarray) -> np.ndarray:
    """Rows of values in 0..255 as their rank among the row's, 0 to 1 in steps of 1/255."""
    x = np.clip(x, 0, 255).astype(int)
    n, d = x.shape
    counts = np.bincount((x + 256 * np.arange(n)[:, None]).ravel(), minlength=256 * n).reshape(n, 256)
    return np.floor(np.take_along_axis(counts.cumsum(1), x, 1) * 255 / max(d, 1)) / 255


def equalise_patch(patch: Column) -> Column:
    """Histogram equalisation of values in 0..255, over 255; null stays null. Patches of one size go through at once."""

    @F.pandas_udf("array<double>")
    def run(p: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(p), index=p.index, dtype=object)
        size = p.map(len, na_action="ignore")
        for n in size.dropna().unique():
            at = p.index[size == n]
            out.loc[at] = pd.Series(list(equalised(np.array(p.loc[at].tolist(), float).reshape(len(at), int(n)))), index=at)
        return out

    return run(patch)


def standardise_patch(v: Column) -> Column:
    """The variant by mean and deviation; over 255 where the deviation is below 1."""
    mean, sd = patch_stats(v)
    return F.when(sd < 1, F.transform(v, lambda x: x / 255.0)).otherwise(F.transform(v, lambda x: F.try_divide(x - mean, sd)))


def pca_fit(vectors: DataFrame, column: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(modes (k, d), average (d), singular values (k)) in one pass: partitions send n, sum and Gram matrix in rows
    of fixed length, which are summed by Spark; the driver decomposes one d x d matrix."""

    def part(frames):
        n, total = 0, None
        for f in frames:
            if len(f):
                x = np.array(f[column].tolist(), float)
                x1 = np.c_[np.ones(len(x)), x]
                total, n = x1.T @ x1 + (0 if total is None else total), n + len(x)
        if total is not None:
            yield pd.DataFrame({"row": np.arange(len(total)), "cells": list(total)})

    rows = vectors.select(column).mapInPandas(part, "row int, cells array<double>").select("row", F.posexplode("cells"))
    got = rows.groupBy("row", "pos").agg(F.sum("col").alias("x")).collect()
    d = max(r["row"] for r in got) + 1
    m = np.zeros((d, d))
    for r in got:
        m[r["row"], r["pos"]] = r["x"]
    n, avg = m[0, 0], m[0, 1:] / m[0, 0]
    values, v = np.linalg.eigh(m[1:, 1:] - n * np.outer(avg, avg))
    order = np.argsort(values)[::-1][:k]
    modes = v[:, order].T
    modes *= np.where(modes[np.arange(len(modes)), np.abs(modes).argmax(1)] < 0, -1, 1)[:, None]
    return modes, avg, np.sqrt(np.maximum(values[order], 0))


def pca_project(v: Column, modes: np.ndarray, avg: np.ndarray) -> Column:
    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(list((np.array(x.tolist(), float).reshape(-1, len(avg)) - avg) @ modes.T))

    return run(v)


def pca_unproject(v: Column, modes: np.ndarray, avg: np.ndarray) -> Column:
    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.array(x.tolist(), float).reshape(-1, len(modes)) @ modes + avg))

    return run(v)
