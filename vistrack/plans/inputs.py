"""The driver's tables as the library's inputs, and the same in SQL. Each SQL text is a list of common table
expressions that a query starts from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import histo

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, with its SQL where it can be put in SQL."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def packets(spark: SparkSession, sf: str) -> DataFrame:
    """Descriptors: a file per label, in order of vec_id; every fifth starts a track; a word from the first number."""
    e = read(spark, sf, "embeddings")
    return e.select(
        F.col("label").cast("string").alias("source"), F.col("vec_id").alias("packet_no"),
        F.when(F.col("vec_id") % 5 == 0, -1).otherwise(280).cast("long").alias("ptr"), F.col("embedding").alias("descriptor"),
        (F.floor(F.abs(F.col("embedding")[0].cast("double")) * 100) % 16 + 1).alias("word"),
    )


PACKETS = """packets as (
  select cast(label as varchar) as source, vec_id as packet_no, cast(case when vec_id % 5 = 0 then -1 else 280 end as bigint) as ptr,
         embedding as descriptor, cast(floor(abs(cast(embedding[1] as double)) * 100) as bigint) % 16 + 1 as word
  from embeddings)"""


#: A word: a part in a quantity.
WORD_SQL = "l_partkey * 50 + cast(l_quantity as bigint)"


def word():
    return (F.col("l_partkey") * 50 + F.col("l_quantity").cast("long")).alias("word")


def clusters(spark: SparkSession, sf: str) -> DataFrame:
    """A collection of histograms: suppliers, with what they sell as words."""
    rows = read(spark, sf, "lineitem").select((F.col("l_suppkey") + 1).alias("cid"), word())
    return histo.histograms(rows, "cid")


H = f"h as (select l_suppkey + 1 as cid, {WORD_SQL} as word, count(*) as cnt from lineitem group by 1, 2)"


def frame_points(spark: SparkSession, sf: str) -> DataFrame:
    """Frames to look up: customers, with what they buy as words."""
    o = read(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("query_id"))
    return read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), word()).join(o, "o_orderkey").drop("o_orderkey")


def frame_histograms(spark: SparkSession, sf: str) -> DataFrame:
    return histo.histograms(frame_points(spark, sf), "query_id")


Q = f"q as (select o_custkey as query_id, {WORD_SQL} as word, count(*) as cnt from lineitem join orders on l_orderkey = o_orderkey group by 1, 2)"
IDF = """idf as (select word, count(*) as df, case when (select count(distinct cid) from h) < 2 then 1.0
  else ln(floor((select count(distinct cid) from h) / count(*))) end as idf from h group by word)"""


def keypoints(spark: SparkSession, sf: str) -> DataFrame:
    """Keypoints of one video: a frame per hour, position from value and k, track = user; word 0
    where k is a multiple of 20."""
    k = F.get_json_object("props", "$.k").cast("long")
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return read(spark, sf, "events").select(
        F.lit(0).cast("long").alias("video_id"), F.floor(us / 3600000000).alias("frame_id"), F.col("event_id").alias("kpt_id"),
        F.col("user_id").alias("track_id"), F.col("value").alias("u"), (k * 4.8).alias("v"), (k % 20).alias("word"), (k % 4).cast("int").alias("scale"),
        F.col("value").alias("score"), k.alias("k"), us.alias("us"), F.col("event_type").alias("kind"),
    )


K = """pts as (
  select cast(0 as bigint) as video_id, cast(floor(epoch_us(ts) / 3600000000) as bigint) as frame_id, event_id as kpt_id, user_id as track_id,
         value as u, k * 4.8e0 as v, k % 20 as word, cast(k % 4 as integer) as scale, value as score, k, epoch_us(ts) as us, event_type as kind
  from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events))"""


def detections(spark: SparkSession, sf: str) -> DataFrame:
    """Objects over time: users, seen at their events; t in seconds, frame = minute."""
    p = keypoints(spark, sf)
    return p.select(F.col("track_id").alias("obj_id"), (F.col("us") / 1e6).alias("t"), F.floor(F.col("us") / 60000000).alias("frame_id"), "kpt_id", F.col("u").alias("x"), F.col("v").alias("y"))


D = "det as (select track_id as obj_id, us / 1e6 as t, cast(floor(us / 60000000) as bigint) as frame_id, kpt_id, u as x, v as y from pts)"


def maps(points: DataFrame, key: str) -> DataFrame:
    """Adds h: a map near the identity, from the key."""
    k = (F.col(key) % 10).cast("double")
    return points.withColumn("h", F.array(1 + k * 0.01, k * 0.002, k * 3, -k * 0.003, 1 - k * 0.01, k * 2, k * 0.00001, k * 0.00002, F.lit(1.0)))


def maps_sql(key: str) -> str:
    return f"""[1 + ({key} % 10) * 0.01e0, ({key} % 10) * 0.002e0, ({key} % 10) * 3e0, -({key} % 10) * 0.003e0, 1 - ({key} % 10) * 0.01e0,
  ({key} % 10) * 2e0, ({key} % 10) * 0.00001e0, ({key} % 10) * 0.00002e0, 1e0]"""
