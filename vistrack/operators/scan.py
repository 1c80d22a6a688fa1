"""Running affine maps along each object's frames, over sessions of any length.

x_k = A_k x_(k-1) + b_k is a fold, but composing such maps is associative: frames are cut into chunks, every chunk
composes its own maps, the few results of an object's chunks are composed in their turn, and each row's map is applied
to what the chunk before it left. No task holds more than a batch of rows, and time is linear in the frames.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from ..plans.state import small, written

#: Frames in a chunk.
CHUNK = 4096

#: From a batch (place of the row in its session, from 0; measurements as (rows, numbers)) to the maps: A as (rows, parts,
#: size, size) and b as (rows, parts, size). The first row of a session has A = 0.
Maps = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def along_sessions(rows: DataFrame, ties: list[str], chunk: int = CHUNK) -> DataFrame:
    """Adds __chunk, __rn (place in the chunk, from 1) and __k (place in the session, from 0) to rows of (obj_id,
    frame_id): a session starts where an object has no row on the frame before. Rows of one frame follow `ties`."""
    by = ["obj_id", "__chunk"]
    w = Window.partitionBy(*by).orderBy("frame_id", *ties)
    at = rows.withColumn("__chunk", F.floor(F.col("frame_id") / chunk)).withColumns({"__rn": F.row_number().over(w), "__cut": F.col("frame_id") - F.lag("frame_id").over(w) > 1})
    at = written(at.withColumn("__cut", F.max(F.when(F.col("__cut"), F.col("__rn"))).over(w.rowsBetween(Window.unboundedPreceding, 0))), "chunked")
    each = at.groupBy(*by).agg(F.min("frame_id").alias("first"), F.max("frame_id").alias("last"), F.count("*").alias("rows"), F.max("__cut").alias("cut"))
    of = Window.partitionBy("obj_id").orderBy("__chunk")
    past = of.rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumns({"__head": F.coalesce(F.col("first") - F.lag("last").over(of) > 1, F.lit(True)), "before": F.coalesce(F.sum("rows").over(past), F.lit(0))})
    begun = F.col("before") + F.coalesce("cut", F.when(F.col("__head"), 1))
    each = each.withColumn("begun", begun).withColumn("__open", F.col("before") - F.last("begun", ignorenulls=True).over(past))
    at = at.join(small(written(each.select(*by, "__head", "__open"), "chunks")), by)
    k = F.when(F.col("__cut").isNotNull(), F.col("__rn") - F.col("__cut")).when(F.col("__head"), F.col("__rn") - 1).otherwise(F.col("__rn") + F.col("__open"))
    return at.withColumn("__k", k.cast("long")).drop("__cut", "__head", "__open")


def compose(a: np.ndarray, b: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maps up to and with each row from the first of its part (a number per row, equal rows lie together): doubling,
    a row's map is composed with the one 1, 2, 4, ... rows before it."""
    a, b, step = a.copy(), b.copy(), 1
    while step < len(a):
        near = np.flatnonzero(part[step:] == part[:-step]) + step
        if not len(near):
            break
        b[near] += np.einsum("nkij,nkj->nki", a[near], b[near - step])
        a[near] = a[near] @ a[near - step]
        step *= 2
    return a, b


def _composed(rows: DataFrame, key: list[str], order: str, parts: int, size: int, maps: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], keep: list[str]) -> DataFrame:
    """`keep` with __a and __b: the maps composed along `order` within each key, a batch of rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, a0, b0 = None, None, None
        for t in batches:
            if not t.num_rows:
                continue
            keys = np.stack([t[c].to_numpy() for c in key])
            part = np.r_[0, np.cumsum((keys[:, 1:] != keys[:, :-1]).any(0))]
            a, b = compose(*maps(t), part)
            if last is not None and (last == keys[:, 0]).all():  # the batch goes on with the part that the last one ended in
                n = int((part == 0).sum())
                b[:n] += np.einsum("nkij,kj->nki", a[:n], b0)
                a[:n] = a[:n] @ a0
            last, a0, b0 = keys[:, -1], a[-1], b[-1]
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x[0].size), pa.array(x.reshape(-1))) for x in (a, b)]
            yield pa.RecordBatch.from_arrays([t[c] for c in keep] + lists, names=[*keep, "__a", "__b"])

    schema = StructType([rows.schema[c] for c in keep]).add("__a", ArrayType(DoubleType())).add("__b", ArrayType(DoubleType()))
    return rows.repartition(*key).sortWithinPartitions(*key, order).mapInArrow(run, schema)


def _shaped(t: pa.RecordBatch, name: str, *shape: int) -> np.ndarray:
    return t[name].flatten().to_numpy().reshape(-1, *shape)


def affine_scan(rows: DataFrame, numbers: list[str], maps: Maps, parts: int, size: int, chunk: int = CHUNK) -> DataFrame:
    """`rows` (obj_id, frame_id, ...) with __k and __x (array of `parts` times `size`): the state after each row.

    Rows of one frame go by their numbers. A row without an object, a frame or one of the numbers is an absence: its
    state is null, and it does not keep a session open.
    """
    whole = F.lit(True)
    for c in ("obj_id", "frame_id", *numbers):
        whole &= F.col(c).isNotNull()
    rows = rows.withColumns({f"__z{i}": F.col(c).cast("double") for i, c in enumerate(numbers)})
    z = [f"__z{i}" for i in range(len(numbers))]
    at = along_sessions(rows.where(whole), z, chunk)

    def measured(t: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return maps(t["__k"].to_numpy(), np.stack([t[c].to_numpy() for c in z], 1))

    key = ["obj_id", "__chunk"]
    at = written(_composed(at, key, "__rn", parts, size, measured, [c for c in at.columns if c not in z]), "composed")
    ends = at.groupBy(*key).agg(F.max_by(F.struct("__a", "__b"), "__rn").alias("e")).select(*key, F.col("e.__a").alias("__a"), F.col("e.__b").alias("__b"))
    ends = _composed(ends, ["obj_id"], "__chunk", parts, size, lambda t: (_shaped(t, "__a", parts, size, size), _shaped(t, "__b", parts, size)), key)
    left = ends.select(*key, F.lag("__b").over(Window.partitionBy("obj_id").orderBy("__chunk")).alias("__left"))
    out = at.join(small(written(left, "left")), key)
    x = []
    for p in range(parts):
        for i in range(size):
            own = F.col("__b")[p * size + i]
            x.append(sum((F.col("__a")[(p * size + i) * size + j] * F.coalesce(F.col("__left")[p * size + j], F.lit(0.0)) for j in range(size)), own))
    out = out.withColumn("__x", F.array(*x)).drop("__a", "__b", "__left", "__chunk", "__rn")
    none = rows.where(~whole).drop(*z).withColumns({"__k": F.lit(None).cast("long"), "__x": F.lit(None).cast("array<double>")})
    return out.unionByName(none)
