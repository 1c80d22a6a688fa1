"""Plane geometry as column expressions: projective maps are arrays of nine doubles, row by row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def to_base_level(c: Column, scale: Column) -> Column:
    """A pyramid coordinate at full resolution."""
    return c * F.pow(F.lit(2.0), scale)


def apply_homography(h: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """The point's image: the first two coordinates over the third; null if that is zero."""
    row = lambda i: h[3 * i] * x + h[3 * i + 1] * y + h[3 * i + 2]
    w = F.nullif(row(2), F.lit(0.0))
    return row(0) / w, row(1) / w


def determinant(h: Column) -> Column:
    return h[0] * (h[4] * h[8] - h[5] * h[7]) - h[1] * (h[3] * h[8] - h[5] * h[6]) + h[2] * (h[3] * h[7] - h[4] * h[6])


def invert_homography(h: Column) -> Column:
    """Adjugate over determinant; nulls for a singular matrix."""
    det = F.nullif(determinant(h), F.lit(0.0))
    minor = lambda a, b, c, d: (h[a] * h[d] - h[b] * h[c]) / det
    return F.array(
        minor(4, 5, 7, 8), minor(2, 1, 8, 7), minor(1, 2, 4, 5),
        minor(5, 3, 8, 6), minor(0, 2, 6, 8), minor(2, 0, 5, 3),
        minor(3, 4, 6, 7), minor(1, 0, 7, 6), minor(0, 1, 3, 4),
    )


def is_plausible(h: Column, side: float = 200.0, low: float = 20.0, high: float = 2000.0, ratio: float = 2.5) -> Column:
    """Whether the square of `side` keeps edges in [low, high], and neighbouring edges ratios in [1/ratio, ratio]."""
    corners = [apply_homography(h, F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (side, 0.0), (side, side), (0.0, side))]
    edge = lambda a, b: F.sqrt(F.pow(a[0] - b[0], F.lit(2.0)) + F.pow(a[1] - b[1], F.lit(2.0)))
    e = [edge(corners[i], corners[(i + 1) % 4]) for i in range(4)]
    ok = F.lit(True)
    for i, x in enumerate(e):
        part = x / F.nullif(e[(i + 1) % 4], F.lit(0.0))
        ok = ok & x.between(low, high) & part.between(1 / ratio, ratio)
    return F.coalesce(ok, F.lit(False))


def is_reprojection_inlier(h: Column, ox: Column, oy: Column, fx: Column, fy: Column, threshold: float = 3.0) -> Column:
    """Object point and frame point strictly closer than the threshold under h; true without h."""
    x, y = apply_homography(h, ox, oy)
    near = F.pow(x - fx, F.lit(2.0)) + F.pow(y - fy, F.lit(2.0)) < threshold * threshold
    return F.when(h.isNull(), True).otherwise(F.coalesce(near, F.lit(False)))


def is_epipolar_inlier(f: Column, ox: Column, oy: Column, fx: Column, fy: Column, threshold: float = 3.0) -> Column:
    """|a' (F b)| below the threshold, a the object point and b the frame point."""
    row = lambda i: f[3 * i] * fx + f[3 * i + 1] * fy + f[3 * i + 2]
    return F.abs(ox * row(0) + oy * row(1) + row(2)) < threshold


def distort(x: Column, y: Column, k1: float, k2: float, p1: float, p2: float, fx: float, fy: float, cx: float, cy: float) -> tuple[Column, Column]:
    """Radial and tangential distortion of a normalised point, in pixels."""
    r2 = x * x + y * y
    radial = 1 + k1 * r2 + k2 * r2 * r2
    dx = x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x)
    dy = y * radial + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y
    return dx * fx + cx, dy * fy + cy


def undistort(k1: float, k2: float, p1: float, p2: float, fx: float, fy: float, cx: float, cy: float, steps: int = 5, settled: float = 1e-4):
    """A pandas UDF (u, v) -> struct<x, y>: at most `steps` Newton steps, a row stopping at a squared step below
    `settled` (pixels)."""

    @F.pandas_udf("x double, y double")
    def run(u: pd.Series, v: pd.Series) -> pd.DataFrame:
        x, y = ((u - cx) / fx).to_numpy(float), ((v - cy) / fy).to_numpy(float)
        live = np.isfinite(x) & np.isfinite(y)
        for _ in range(steps):
            r2 = x * x + y * y
            g, dg = 1 + k1 * r2 + k2 * r2 * r2, 2 * k1 + 4 * k2 * r2
            ex = (x * g + 2 * p1 * x * y + p2 * (r2 + 2 * x * x)) * fx + cx - u
            ey = (y * g + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y) * fy + cy - v
            a = fx * (g + x * x * dg + 2 * p1 * y + 6 * p2 * x)
            b = fx * (x * y * dg + 2 * p1 * x + 2 * p2 * y)
            c = fy * (x * y * dg + 2 * p1 * x + 2 * p2 * y)
            d = fy * (g + y * y * dg + 6 * p1 * y + 2 * p2 * x)
            det = a * d - b * c
            det = np.where(det == 0, np.nan, det)
            sx, sy = (d * ex - b * ey) / det, (a * ey - c * ex) / det
            ok = live & np.isfinite(sx) & np.isfinite(sy)
            x, y = np.where(ok, x - sx, x), np.where(ok, y - sy, y)
            live = ok & ((sx * fx) ** 2 + (sy * fy) ** 2 >= settled)
            if not live.any():
                break
        return pd.DataFrame({"x": x, "y": y})

    return run


def homography_from_points(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least-squares maps of batches of n >= 4 points: (m, n, 2) to (m, n, 2) gives (m, 9); last entry 1.

    Points are centred and scaled first; degenerate sets give NaN.
    """

    def scaled(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mid = p.mean(1, keepdims=True)
        size = np.sqrt(((p - mid) ** 2).sum(2).mean(1))
        s = np.sqrt(2) / np.where(size > 0, size, np.nan)
        t = np.zeros((len(p), 3, 3))
        t[:, 0, 0] = t[:, 1, 1] = s
        t[:, 0, 2], t[:, 1, 2], t[:, 2, 2] = -s * mid[:, 0, 0], -s * mid[:, 0, 1], 1
        return (p - mid) * s[:, None, None], t

    (p, tp), (q, tq) = scaled(a.astype(float)), scaled(b.astype(float))
    m, n, _ = p.shape
    rows = np.zeros((m, 2 * n, 9))
    one = np.concatenate([p, np.ones((m, n, 1))], 2)
    rows[:, :n, :3], rows[:, :n, 6:] = one, -q[:, :, :1] * one
    rows[:, n:, 3:6], rows[:, n:, 6:] = one, -q[:, :, 1:] * one
    bad = ~np.isfinite(rows).all((1, 2))
    rows[bad] = 0
    _, _, vt = np.linalg.svd(rows.transpose(0, 2, 1) @ rows)
    h = vt[:, -1].reshape(m, 3, 3)
    bad |= ~np.isfinite(tq).all((1, 2))
    tq, tp = np.where(bad[:, None, None], np.eye(3), tq), np.where(bad[:, None, None], np.eye(3), tp)
    h = np.linalg.inv(tq) @ h @ tp
    with np.errstate(all="ignore"):
        h = (h / h[:, 2:, 2:]).reshape(m, 9)
    h[bad | ~np.isfinite(h).all(1)] = np.nan
    return h


def homography_from_4(points: Column) -> Column:
    """From arrays of 16 numbers, four pairs (x, y, x', y'): the map of the first to the second; null if degenerate."""

    @F.pandas_udf("array<double>")
    def run(p: pd.Series) -> pd.Series:
        x = np.array([v if v is not None and len(v) == 16 else [np.nan] * 16 for v in p], float).reshape(-1, 4, 4)
        h = homography_from_points(x[:, :, :2], x[:, :, 2:]) if len(x) else np.zeros((0, 9))
        return pd.Series([None if np.isnan(r).any() else r.tolist() for r in h], dtype=object)

    return run(points)


def _square_to(quad: np.ndarray) -> list[np.ndarray]:
    """a to h of the maps [[a, b, c], [d, e, f], [g, h, 1]] of the unit square to quads (m, 4, 2)."""
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = quad.astype(float).transpose(1, 2, 0)
    sx, sy, den = x0 - x1 + x2 - x3, y0 - y1 + y2 - y3, (x1 - x2) * (y3 - y2) - (x3 - x2) * (y1 - y2)
    g, h = (sx * (y3 - y2) - (x3 - x2) * sy) / den, ((x1 - x2) * sy - sx * (y1 - y2)) / den
    return [x1 - x0 + g * x1, x3 - x0 + h * x3, x0, y1 - y0 + g * y1, y3 - y0 + h * y3, y0, g, h]


def homography_from_quads(quad: np.ndarray, side: np.ndarray) -> np.ndarray:
    """The maps (m, 9) of quads (m, 4, 2) to rectangles of `side` (m, 2) whose corners are (0, 0), (w, 0), (w, h), (0, h):
    homography_from_points() of four pairs in closed form. Degenerate quads give NaN."""
    w, t = side.astype(float).T
    with np.errstate(all="ignore"):
        a, b, c, d, e, f, g, h = _square_to(quad)
        out = np.stack([w * (e - f * h), w * (c * h - b), w * (b * f - c * e), t * (f * g - d), t * (a - c * g), t * (c * d - a * f), d * h - e * g, b * g - a * h, a * e - b * d], 1)
        out /= out[:, 8:]
    out[~np.isfinite(out).all(1)] = np.nan
    return out


def homography_from_fours(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """homography_from_points() of four pairs each, (m, 4, 2) to (m, 4, 2), in closed form; three points on a line give NaN
    (or a map that is all rounding errors)."""
    with np.errstate(all="ignore"):
        back = homography_from_quads(a, np.ones((len(a), 2))).reshape(-1, 3, 3)
        out = np.stack([*_square_to(b), np.ones(len(b))], 1).reshape(-1, 3, 3) @ back
        out = (out / out[:, 2:, 2:]).reshape(-1, 9)
    out[~np.isfinite(out).all(1)] = np.nan
    return out
