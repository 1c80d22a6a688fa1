"""Training from synthetic views: random projective views of images, and points that recur in them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import apply_homography, homography_from_quads
from .numbering import numbered
from .objects import pack_key


def random_views(images: DataFrame, n: int = 1000, jitter: float = 0.2, low: float = 0.5, high: float = 2.0, seed: int = 1) -> DataFrame:
    """image_id, view, width, height, h of n views of each image (image_id, width, height).

    Corners move by up to `jitter` of the side, then scale by a log-uniform factor and turn by any angle; the quad is
    shifted to the origin, and the view's size is rounded up to a multiple of 8. h maps view to image. All numbers
    come from hashes of (image, view), so reruns agree.
    """
    u = lambda k: F.pmod(F.xxhash64("image_id", "view", F.lit(seed), F.lit(k)), F.lit(1 << 30)) / float(1 << 30)
    rows = images.select("image_id", "width", "height", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("view"))
    rows = rows.withColumn("u", F.array(*(u(k) for k in range(10))))

    @F.pandas_udf("width int, height int, h array<double>")
    def make(width: pd.Series, height: pd.Series, us: pd.Series) -> pd.DataFrame:
        m = len(width)
        x, side = np.array(us.tolist(), float).reshape(m, 10), np.stack([width, height], 1).astype(float)
        corners = np.array([(0, 0), (1, 0), (1, 1), (0, 1)], float)[None] * side[:, None]
        quad = corners + (2 * x[:, :8].reshape(m, 4, 2) - 1) * jitter * side[:, None]
        scale, angle = low * (high / low) ** x[:, 8], 2 * np.pi * x[:, 9]
        turn = np.stack([np.cos(angle), -np.sin(angle), np.sin(angle), np.cos(angle)], 1).reshape(m, 2, 2) * scale[:, None, None]
        quad = np.einsum("mij,mkj->mki", turn, quad)
        quad -= quad.min(1, keepdims=True)
        size = np.ceil(quad.max(1) / 8) * 8
        h = homography_from_quads(quad, side)
        return pd.DataFrame({"width": size[:, 0].astype("int32"), "height": size[:, 1].astype("int32"), "h": list(h)})

    out = rows.withColumn("v", make("width", "height", "u"))
    return out.select("image_id", "view", F.col("v.width").alias("width"), F.col("v.height").alias("height"), F.col("v.h").alias("h"))


def back_project(points: DataFrame, views: DataFrame | None = None) -> DataFrame:
    """Points (image_id, view, ..., u, v) with x, y on the image, by the map h of their view; without `views` the points have
    it themselves."""
    at = points if views is None else points.join(views.select("image_id", "view", "h"), ["image_id", "view"])
    x, y = apply_homography(F.col("h"), F.col("u"), F.col("v"))
    return at.withColumns({"x": x, "y": y}).drop("h")


def leaders(x: np.ndarray, y: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group of each point from 0, centres' x and y): the nearest centre within r takes a point and moves to the running
    mean; else the point is a new centre."""
    cells: dict[tuple[int, int], list[int]] = {}
    cx, cy, n, of = [], [], [], []
    for x, y in zip(x.tolist(), y.tolist()):
        i, j = int(x // r), int(y // r)
        near = [(d, g) for a in (i - 1, i, i + 1) for b in (j - 1, j, j + 1) for g in cells.get((a, b), ()) if (d := (cx[g] - x) ** 2 + (cy[g] - y) ** 2) < r * r]
        if near:
            g = min(near)[1]
            old = (int(cx[g] // r), int(cy[g] // r))
            n[g] += 1
            cx[g] += (x - cx[g]) / n[g]
            cy[g] += (y - cy[g]) / n[g]
            if (new := (int(cx[g] // r), int(cy[g] // r))) != old:
                cells[old].remove(g)
                cells.setdefault(new, []).append(g)
        else:
            g = len(cx)
            cx.append(x), cy.append(y), n.append(1)
            cells.setdefault((i, j), []).append(g)
        of.append(g)
    return np.array(of, int), np.array(cx), np.array(cy)


def leaders_of_many(x: np.ndarray, y: np.ndarray, size: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """leaders() of many images, whose points follow each other, `size` of each: (group, centre's x, y) of each point. The
    k-th points of all images are placed at once, the longest images first, so those that go on are the first rows."""
    start, of, order = np.cumsum(size) - size, np.zeros(len(x), int), np.argsort(-size, kind="stable")
    most = int(size.max(initial=0))
    cx, cy, n, groups = np.full((len(size), most), np.inf), np.zeros((len(size), most)), np.zeros((len(size), most), int), np.zeros(len(size), int)
    for k in range(most):
        m = int((size > k).sum())
        at, row, top = start[order[:m]] + k, np.arange(m), max(1, int(groups[:m].max(initial=0)))
        d = (cx[:m, :top] - x[at, None]) ** 2 + (cy[:m, :top] - y[at, None]) ** 2
        g = d.argmin(1)
        g = np.where(d[row, g] < r * r, g, groups[:m])
        new = g == groups[:m]
        groups[:m] += new
        cx[row[new], g[new]], cy[row[new], g[new]] = x[at[new]], y[at[new]]
        n[row, g] += 1
        cx[row, g] += (x[at] - cx[row, g]) / n[row, g]
        cy[row, g] += (y[at] - cy[row, g]) / n[row, g]
        of[at] = g
    back = np.empty(len(size), int)
    back[order] = np.arange(len(size))
    image = np.repeat(back, size)
    return of, cx[image, of], cy[image, of]


def group_points(points: DataFrame, r: float = 3.0, least: int = 0, together: int = 256, dealt: bool = False) -> DataFrame:
    """image_id, group, x, y, word, cnt: leaders() of each image's points (seq, x, y, word) in order of seq, of the groups
    with at least `least` points.

    The result depends on the order, so an image is in one task; its size is bounded by views times points per view. Tasks
    stream their images; those of at most `together` points are taken many at a time. Points that are `dealt` lie image by
    image in their partitions as it is.
    """

    def grouped(f: pd.DataFrame) -> pd.DataFrame:
        x, y = f["x"].to_numpy(float), f["y"].to_numpy(float)
        image, start, size = np.unique(f["image_id"], return_index=True, return_counts=True)
        of, cx, cy = np.zeros(len(f), int), np.zeros(len(f)), np.zeros(len(f))
        few = np.repeat(size <= together, size) & np.isfinite(x) & np.isfinite(y) if len(f) else np.zeros(0, bool)
        fine = np.minimum.reduceat(few, start) if len(f) else few
        few = np.repeat(fine, size)
        if few.any():
            of[few], cx[few], cy[few] = leaders_of_many(x[few], y[few], size[fine], r)
        for a, n in zip(start[~fine], size[~fine]):
            g, gx, gy = leaders(x[a : a + n], y[a : a + n], r)
            of[a : a + n], cx[a : a + n], cy[a : a + n] = g, gx[g], gy[g]
        out = pd.DataFrame({"image_id": f["image_id"].to_numpy(), "group": of + 1, "x": cx, "y": cy, "word": f["word"].to_numpy(), "cnt": 1})
        if least > 1:
            out = out[out.groupby(["image_id", "group"])["cnt"].transform("size") >= least]
        return out.groupby(["image_id", "group", "x", "y", "word"], as_index=False, dropna=False)["cnt"].sum()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for f in batches:
            held.append(f)
            if sum(map(len, held)) >= 60_000:
                f = pd.concat(held)
                last = f["image_id"].to_numpy() == f["image_id"].iloc[-1]  # may go on in the next batch
                yield grouped(f[~last])
                held = [f[last]]
        if held:
            yield grouped(pd.concat(held))

    rows = points.select("image_id", "seq", "x", "y", "word").where("image_id is not null")
    rows = rows if dealt else rows.repartition("image_id")
    return rows.sortWithinPartitions("image_id", "seq").mapInPandas(run, "image_id long, group long, x double, y double, word long, cnt long")


def prune_points(groups: DataFrame, views: int, rate: float = 0.3) -> DataFrame:
    """The groups seen in at least int(views * rate) views."""
    total = groups.groupBy("image_id", "group").agg(F.sum("cnt").alias("total")).where(F.col("total") >= int(views * rate))
    return groups.join(total.select("image_id", "group"), ["image_id", "group"], "left_semi")


def point_clusters(groups: DataFrame) -> DataFrame:
    """cid_val, cnt: the groups (image_id, group, word, cnt) as a collection, their cids numbered by image and group; a
    row is keyed by cid and word together, as collections are stored. Word 0 is none."""
    h = groups.where("word <> 0")
    ids = numbered(h.select("image_id", "group").distinct(), [], ["image_id", "group"], "cid", start=1)
    return h.join(ids, ["image_id", "group"]).select(pack_key(F.col("cid"), F.col("word")).alias("cid_val"), "cnt")
