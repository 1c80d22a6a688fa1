"""Queries that write a table in the library's file forms and read it back."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..functions import geometry, vectors
from ..operators import histo, objects, views, vocab
from ..sources import tables
from .inputs import K, PACKETS, keypoints, maps, maps_sql, packets, query, read
from .state import shared_dir
from .tracking import MAPPED, rounded
from .vocabulary import X, descriptors, patches


def folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid4().hex}"


@query("io1_read_packets", f"""with {PACKETS} select source, cast(row_number() over (partition by source order by packet_no) - 1 as bigint) as packet_no, ptr,
round(list_sum(list_transform(range(1, 65), lambda i: i * cast(descriptor[i] as double))), 6) as moment from packets""")
def io1(spark, sf):
    """Descriptors as files of packets, a file a source, numbered by their place in it."""
    path = folder(spark, "packets")
    tables.write_packets(packets(spark, sf), path, 64)
    got = tables.read_packets(spark, path, 64)
    moment = F.aggregate(F.transform("descriptor", lambda x, i: (i + 1) * x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return rounded(got.select(F.regexp_extract("source", r"([^/]+)-[0-9a-f]+\.bin$", 1).alias("source"), "packet_no", "ptr", moment.alias("moment")), "moment")


@query("io3_tables_round_trip", """select p_partkey as node_id, p_partkey // 4 as parent_id, cast(p_partkey % 4 as integer) as ordinal, cast(p_size % 9 as integer) as level,
cast(case when p_partkey % 3 = 0 then 0 else p_partkey end as integer) as word, cast(p_size as bigint) as size, round(cast(p_retailprice as double), 6) as first, cast(p_size as double) as second from part""")
def io3(spark, sf):
    """Parts as nodes of a tree, saved as its two tables and loaded."""
    key = F.col("p_partkey")
    nodes = read(spark, sf, "part").select(
        key.alias("node_id"), F.floor(key / 4).alias("parent_id"), (key % 4).cast("int").alias("ordinal"), (F.col("p_size") % 9).cast("int").alias("level"),
        F.when(key % 3 == 0, 0).otherwise(key).cast("int").alias("word"), F.col("p_size").cast("long").alias("size"),
        F.array(F.col("p_retailprice").cast("double"), F.col("p_size").cast("double")).alias("mean"),
    )
    path = folder(spark, "nodes")
    vocab.save_tree(nodes, path)
    got = vocab.load_tree(spark, path)
    return rounded(got.select(*(c for c in got.columns if c != "mean"), F.col("mean")[0].alias("first"), F.col("mean")[1].alias("second")), "first")


@query("io6_add_images", "select doc_id as img_id, md5(text) as digest, octet_length(encode(text)) as bytes from documents where doc_id % 2 = 0")
def io6(spark, sf):
    """Whole texts stand in for images: appended to a table of images in two parts, those with even ids fetched."""
    size = F.octet_length("text")
    images = read(spark, sf, "documents").where("text is not null").select(
        F.col("doc_id").alias("img_id"), size.alias("width"), F.lit(1).alias("height"), size.alias("step"), F.lit(1).alias("channels"), F.col("text").cast("binary").alias("data"),
    )
    path = folder(spark, "images")
    for part in (0, 1):
        tables.add_images(images.where(F.col("img_id") % 3 % 2 == part), path)
    got = tables.get_images(spark.read.parquet(path), images.where("img_id % 2 = 0"))
    return got.select("img_id", F.md5("data").alias("digest"), F.octet_length("data").cast("long").alias("bytes"))


@query("io10_annotations", "select p_partkey as obj, cast(p_size as double) as x, round(cast(p_retailprice as double), 6) as y, p_type as type, p_name as descr from part")
def io10(spark, sf):
    """Parts as annotations, appended in two goes."""
    path = folder(spark, "annotations")
    rows = read(spark, sf, "part").select(F.col("p_partkey").alias("obj"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").cast("double").alias("y"), F.col("p_type").alias("type"), F.col("p_name").alias("descr"))
    for part in (0, 1):
        tables.add_annotation(rows.where(F.col("obj") % 2 == part), path)
    return rounded(tables.annotations(spark, path), "y")


@query("io11_import_pca", f"with {X}, e as (select label, a[i] as x, i from x, range(1, 65) r(i)), m as (select label as mode, i, avg(x) as m from e where label < 8 group by 1, 2), g as (select i, avg(x) as g from e group by 1)," """
c as (select id, i, a[i] as x from x, range(1, 65) r(i)) select id, cast(mode as integer) as mode, round(sum((x - g) * m), 5) as x from c join g using (i) join m using (i) group by 1, 2""")
def io11(spark, sf):
    """The mean descriptors of eight labels as modes, and that of all as the average: written as text, imported, projected on."""
    d = descriptors(spark, sf)
    of = lambda rows: rows.agg(*(F.avg(F.col("vector")[i]).alias(f"m{i}") for i in range(64)))
    label = F.col("source").cast("int")
    modes = [list(r)[1:] for r in of(d.where(label < 8).groupBy(label.alias("mode"))).orderBy("mode").collect()]  # eight rows
    path = folder(spark, "modes")
    tables.write_matrix(spark, modes, f"{path}/modes")
    tables.write_matrix(spark, [list(of(d).first())], f"{path}/average")
    at = vectors.pca_project(F.col("vector"), tables.read_matrix(spark, f"{path}/modes", 8), tables.read_matrix(spark, f"{path}/average")[0])
    return rounded(d.select("id", F.posexplode(at).alias("mode", "x")), "x", digits=5)


@query("v8_v9_energy", f"with {X}, e as (select id, i, a[i] as x from x, range(1, 65) r(i)), g as (select i, avg(x) as g from e group by 1) select id, round(sum((x - g) * (x - g)), 5) as energy from e join g using (i) group by 1")
def v8(spark, sf):
    """On all modes a vector is as long as it is off the average."""
    d = descriptors(spark, sf)
    modes, avg, _ = vectors.pca_fit(d, "vector", 64)
    energy = F.aggregate(vectors.pca_project(F.col("vector"), modes, avg), F.lit(0.0), lambda s, x: s + x * x)
    return rounded(d.select("id", energy.alias("energy")), "energy", digits=5)


@query("v4_patch_moments", f"""with {X}, g as (select id, 16 * i + j + 1 as p, greatest(0e0, least(255e0, floor(128e0 + 900e0 * a[i + 1] * a[j + 17] + 200e0 * a[i + 1]))) as x from x, range(16) r(i), range(16) s(j)),
r as (select *, count(*) over (partition by id order by x range between unbounded preceding and current row) as below, avg(x) over (partition by id) as mean, sum(x * x) over (partition by id) as sq from g),
t as (select *, sqrt(greatest(0, sq - 256 * mean * mean)) as sd from r)
select id, round(sum(p * floor(below * 255 / 256) / 255), 4) as equalised, round(sum(p * case when sd < 1 then x / 255 else (x - mean) / sd end), 4) as standardised from t group by 1""")
def v4(spark, sf):
    """Both ways of normalising a patch, each value times its place."""
    moment = lambda v: F.aggregate(F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    p = patches(spark, sf).select("id", vectors.equalise_patch(F.col("patch")).alias("e"), vectors.standardise_patch(F.col("patch")).alias("s"))
    return rounded(p.select("id", moment("e").alias("equalised"), moment("s").alias("standardised")), "equalised", "standardised", digits=4)


@query("p10_recovered_maps", f"with {K}, m as (select distinct track_id from pts) select track_id, cast(i as integer) as i, round(({maps_sql('track_id')})[i + 1], 6) as x from m, range(9) r(i)")
def p10(spark, sf):
    """Each track's map from what it makes of four corners."""
    corners = ((0.0, 0.0), (200.0, 0.0), (200.0, 200.0), (0.0, 200.0))
    m = maps(keypoints(spark, sf).select("track_id").distinct(), "track_id")
    pairs = [c for x, y in corners for c in (F.lit(x), F.lit(y), *geometry.apply_homography(F.col("h"), F.lit(x), F.lit(y)))]
    return rounded(m.select("track_id", F.posexplode(geometry.homography_from_4(F.array(*pairs))).alias("i", "x")), "x")


@query("c2_points_under_maps", MAPPED + " select kpt_id, round((h[1]*u+h[2]*v+h[3])/(h[7]*u+h[8]*v+h[9]), 6) as x, round((h[4]*u+h[5]*v+h[6])/(h[7]*u+h[8]*v+h[9]), 6) as y from m")
def c2(spark, sf):
    """Each track's points as a view of its image, brought back by the view's map."""
    p = keypoints(spark, sf).withColumn("view", F.lit(0))
    shown = maps(p.select("track_id", "view").distinct(), "track_id").withColumnRenamed("track_id", "image_id")
    return rounded(views.back_project(p.withColumnRenamed("track_id", "image_id"), shown).select("kpt_id", "x", "y"), "x", "y")


@query("d2_frames_into_objects", f"with {K} select track_id as obj_id, word as cid, count(*) as cnt, count(distinct frame_id) as images from pts where word <> 0 group by 1, 2")
def d2(spark, sf):
    """Objects trained on their points of even frames, then those of odd frames added."""
    p = keypoints(spark, sf).withColumnsRenamed({"track_id": "obj_id", "frame_id": "img_id"})
    even, odd = (p.where(F.col("img_id") % 2 == k) for k in (0, 1))
    first, more = objects.added_keypoints(even, with_clusters=False), objects.added_keypoints(odd, with_clusters=False)
    h = histo.update_histograms(objects.added_counts(first), objects.added_counts(more)).select(F.col("cid").alias("obj_id"), F.col("word").alias("cid"), "cnt")
    images = first.unionByName(more).groupBy("obj_id", "cid").agg(F.countDistinct("img_id").alias("images"))
    return h.join(images, ["obj_id", "cid"])
