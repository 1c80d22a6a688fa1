"""Helpers that several operators share: shared-folder tables, word patterns and connected components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the cluster's own setting. Where it is unset, a local session gets a folder of its
    own; on a cluster that would be another disk on every machine, so it is an error there."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts the lineage and outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Within it, shuffle files go as soon as the query that made them is over, not when the driver happens to collect its
    garbage. For chains of tables that are `written` and read again, so that no query needs another one's shuffles."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def clear(spark: SparkSession) -> None:
    """Deletes the tables that this application has written with `written`; for when its results are out."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint for small tables inside loops; Spark cleans it up when it is no longer referenced."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """`df` marked for broadcast if it has at most `rows` rows, which is counted first; else as it is, so that the
    join is a shuffled one that adaptive execution can split."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: The table of words that this Python worker keeps between its tasks.
_kept: list[dict] = []


def alone(table: dict | None = None) -> None:
    """Empties the table of words that another operator has left in this Python worker, which Spark uses for all of an
    application's stages; `table` is what is kept from now on."""
    if not _kept or _kept[0] is not table:
        for x in _kept:
            x.clear()
        _kept[:] = [] if table is None else [table]
        give_back()


def give_back() -> None:
    """Returns to the system what the allocators of this Python worker hold but nothing uses. They keep the most that any
    stage has needed, and a worker lives on beside its executor's heap through stages that need little or no Python."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run`, for mapInArrow or mapInPandas, that gives its memory back when the task is over."""

    def held(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return held


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The rows of `batches` in batches of `rows` at most, so that few are Python objects at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def ascii_lower(c: Column) -> Column:
    """Lower case for A-Z only."""
    return F.translate(c, UPPER, LOWER)


def unit_hash(*cols: Column | str) -> Column:
    """A reproducible number in (0, 1) from the columns."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of `edges` (src, dst long) by alternating large and small stars.

    Returns one row per node that has an edge to another: node, component (the smallest node of its component).
    Every step is a min per node and an equi-join, so a node of any degree is a skewed join at worst, never a
    collected list. Self-loops, repeats and nulls are dropped; no edges give an empty table.
    """
    e = (
        edges.select(F.greatest("src", "dst").cast("long").alias("a"), F.least("src", "dst").cast("long").alias("b"))
        .where("a <> b")
        .distinct()
    )
    e = checkpointed(e)
    mark = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b")))
            .distinct()
        )
        e = checkpointed(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
