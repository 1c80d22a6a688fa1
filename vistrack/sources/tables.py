"""Readers and writers of the files and tables that training and tracking use."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.objects import pack_key, unpack_key
from .files import FrameSource, PacketSource

def read_packets(spark: SparkSession, path: str, dim: int, split_bytes: int = 64 << 20) -> DataFrame:
    """Files of fixed records, an 8-byte pointer and `dim` floats, little-endian: source, packet_no (file order), ptr,
    descriptor. A trailing part of a record is an error. A file is cut into ranges of at most `split_bytes`."""
    spark.dataSource.register(PacketSource)
    return spark.read.format("packets").option("dim", dim).option("splitBytes", split_bytes).load(path)


def write_packets(packets: DataFrame, path: str, dim: int) -> None:
    """Appends files of packets to a folder, one for each source (source, packet_no, ptr, descriptor), in order of
    packet_no. As packets point into their file, a source is written by one task."""
    packets.sparkSession.dataSource.register(PacketSource)
    rows = packets.repartition("source").sortWithinPartitions("source", "packet_no")
    rows = rows.select("source", F.col("packet_no").cast("long"), F.col("ptr").cast("long"), F.col("descriptor").cast("array<float>"))
    rows.write.format("packets").option("dim", dim).mode("append").save(path)


def bad_coordinates(packets: DataFrame) -> DataFrame:
    """source, packet_no, coord of every coordinate that isn't a finite number."""
    at = packets.select("source", "packet_no", F.posexplode("descriptor").alias("coord", "x"))
    return at.where(F.col("x").isNull() | F.isnan("x") | (F.abs(F.col("x")) == float("inf"))).select("source", "packet_no", "coord")


def require_finite(packets: DataFrame) -> DataFrame:
    """The packets, if all coordinates are finite; else an error that names the first bad ones."""
    bad = bad_coordinates(packets).take(5)
    if bad:
        raise ValueError("not finite: " + ", ".join(f"{r['source']}#{r['packet_no']}[{r['coord']}]" for r in bad))
    return packets


def write_descriptors(rows: DataFrame, path: str) -> None:
    """Appends descriptors (with `total`), leaving out those whose total is 0."""
    require_finite(rows).where("total <> 0").write.mode("append").parquet(path)


def first_packets(packets: DataFrame, n: int) -> DataFrame:
    """The first n packets in file order if 0 < n, else all."""
    return packets.orderBy("packet_no").limit(n) if n > 0 else packets


def save_clusters(h: DataFrame, path: str) -> None:
    h.select(pack_key(F.col("cid"), F.col("word")).alias("cid_val"), F.col("cnt").cast("int").alias("cnt")).write.mode("overwrite").parquet(path)


def load_clusters(spark: SparkSession, path: str) -> DataFrame:
    cid, word = unpack_key(F.col("cid_val"))
    return spark.read.parquet(path).select(cid.alias("cid"), word.alias("word"), F.col("cnt").cast("long").alias("cnt"))


ANNOTATION = ("obj", "x", "y", "type", "descr")


def add_annotation(rows: DataFrame, path: str) -> None:
    """Appends (obj, x, y, type, descr)."""
    rows.select(*ANNOTATION).write.mode("append").parquet(path)


def annotations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*ANNOTATION)


def read_images(spark: SparkSession, path: str, shape: DataFrame) -> DataFrame:
    """img_id, width, height, step, channels, data: raw files joined to their shapes (file, img_id, ...)."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("content").alias("data"))
    return valid_images(files.join(shape, "file").drop("file"))


def valid_images(images: DataFrame) -> DataFrame:
    """Images whose data has step * height bytes."""
    return images.where(F.octet_length("data") == F.col("step") * F.col("height"))


def add_images(images: DataFrame, path: str) -> None:
    """Appends images (img_id, width, height, step, channels, data), if all are whole; else an error that names the
    first ones that aren't."""
    whole = F.coalesce(F.octet_length("data") == F.col("step") * F.col("height"), F.lit(False))
    bad = [r["img_id"] for r in images.where(~whole).select("img_id").take(5)]
    if bad:
        raise ValueError(f"images without step x height bytes: {bad}")
    images.select("img_id", "width", "height", "step", "channels", "data").write.mode("append").parquet(path)


def get_images(images: DataFrame, ids: DataFrame) -> DataFrame:
    return valid_images(images).join(ids.select("img_id").distinct(), "img_id")


def read_frames(spark: SparkSession, folder: str, prefix: str, suffix: str = "bmp", first: int = 0, last: int | None = None, stream: bool = False) -> DataFrame:
    """frame_id, path, data of numbered files prefix + digits + suffix, from the first existing number at or above
    `first` up to `last`. With `stream` a stream of them, where a frame comes once all numbers before it are there."""
    if stream:
        spark.dataSource.register(FrameSource)
        options = {"prefix": prefix, "suffix": suffix, "first": first} | ({} if last is None else {"last": last})
        return spark.readStream.format("frames").options(**options).load(folder)
    reader = spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}*.{suffix}")
    number = F.regexp_extract("path", rf"{prefix}([0-9]+)\.{suffix}$", 1)
    out = reader.load(folder).where(number != "").select(number.cast("long").alias("frame_id"), "path", F.col("content").alias("data"))
    out = out.where(F.col("frame_id") >= first)
    return out if last is None else out.where(F.col("frame_id") <= last)


#: The instructions of a truth script.
INSTRUCTIONS = ("add", "addH", "addF", "echo", "check")


def parse_truth(lines: DataFrame, column: str = "value") -> DataFrame:
    """frame_id, instr, arg (trimmed) of the lines `id instr arg`; other lines and instructions are skipped."""
    part = lambda k: F.regexp_extract(column, r"^\s*(\d+)\s+(\w+)(.*)$", k)
    out = lines.where(part(1) != "").select(part(1).cast("long").alias("frame_id"), part(2).alias("instr"), F.trim(part(3)).alias("arg"))
    return out.where(F.col("instr").isin(*INSTRUCTIONS))


def read_truth_script(spark: SparkSession, path: str) -> DataFrame:
    return parse_truth(spark.read.text(path))


def read_matrix(spark: SparkSession, path: str, rows: int | None = None) -> np.ndarray:
    """A text file of numbers, one row a line, the first `rows` of them: modes or an average, some hundred numbers wide."""
    lines = spark.read.text(path, wholetext=True).first()[0].split("\n")
    data = [[float(x) for x in line.split()] for line in lines if line.strip()]
    return np.array(data[:rows])


def write_matrix(spark: SparkSession, m: np.ndarray, path: str) -> None:
    text = "\n".join(" ".join(repr(float(x)) for x in row) for row in np.atleast_2d(m))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
