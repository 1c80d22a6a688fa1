"""Queries over histograms, inverted index, retrieval and clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster, histo, objects, retrieve
from .inputs import IDF, PACKETS, WORD_SQL, H, K, Q, clusters, frame_histograms, frame_points, keypoints, packets, query, read, word


def r6(c: str):
    return F.round(F.col(c), 6).alias(c)


@query("h1_assign_track_ids", f"with {PACKETS} select source, packet_no, cast(sum(case when ptr = -1 then 1 else 0 end) over (partition by source order by packet_no) as bigint) as track_id from packets")
def h1(spark, sf):
    return histo.assign_track_ids(packets(spark, sf)).select("source", "packet_no", "track_id")


@query("h2_track_histograms", f"""with {PACKETS}, t as (select *, cast(sum(case when ptr = -1 then 1 else 0 end) over (partition by source order by packet_no) as bigint) as track_id from packets)
select source, track_id, word, count(*) as cnt from t where word <> 0 group by all""")
def h2(spark, sf):
    return histo.histograms(histo.assign_track_ids(packets(spark, sf)), "source", "track_id")


@query("h3_object_histograms", "select l_orderkey as obj_id, l_partkey + 1 as cid, count(*) as cnt from lineitem group by 1, 2")
def h3(spark, sf):
    rows = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("obj_id"), (F.col("l_partkey") + 1).alias("cid"))
    return histo.histograms(rows, "obj_id", word="cid", into="cid")


@query("h4_frame_histograms", f"with {K} select frame_id, word, count(*) as cnt from pts where word <> 0 group by 1, 2")
def h4(spark, sf):
    return histo.histograms(keypoints(spark, sf), "frame_id")


RANKED = "ranked as (select distinct track_id, (track_id + d) % 30 + 1 as cid from pts, (values (0), (7), (11)) v(d))"


def ranked(points):
    return points.select("track_id").distinct().select("track_id", F.explode(F.array(*((F.col("track_id") + d) % 30 + 1 for d in (0, 7, 11)))).alias("cid"))


@query("h5_frame_histograms_soft", f"with {K}, {RANKED} select frame_id, cid as word, count(*) as cnt from pts join ranked using (track_id) group by 1, 2")
def h5(spark, sf):
    p = keypoints(spark, sf)
    return histo.soft_histograms(p, ranked(p))


@query("h6_update_histograms", f"""with {H}, d as (select l_suppkey + 1 as cid, {WORD_SQL} as word, case when l_linenumber = 1 then -1 else 1 end as cnt from lineitem where l_returnflag = 'R')
select cid, word, cast(sum(cnt) as bigint) as cnt from (select * from h union all select * from d) group by 1, 2 having sum(cnt) > 0""")
def h6(spark, sf):
    d = read(spark, sf, "lineitem").where("l_returnflag = 'R'")
    d = d.select((F.col("l_suppkey") + 1).alias("cid"), word(), F.when(F.col("l_linenumber") == 1, -1).otherwise(1).cast("long").alias("cnt"))
    return histo.update_histograms(clusters(spark, sf), d)


@query("h7_merge_histograms", f"with {H} select case when cid % 3 = 0 then cid - 1 else cid end as cid, word, cast(sum(cnt) as bigint) as cnt from h group by 1, 2")
def h7(spark, sf):
    h = clusters(spark, sf)
    into = h.select(F.col("cid").alias("old"), (F.col("cid") - 1).alias("new")).where("old % 3 = 0").distinct()
    return histo.merge_histograms(h, into)


@query("h8_frequencies", f"""with {H}, a as (select distinct l_suppkey + 1 as cid, {WORD_SQL} + 1 as word from lineitem)
select a.cid, a.word, cast(coalesce(cnt, 0) as bigint) as freq, round(coalesce(cnt, 0) / total, 6) as proba
from a left join h using (cid, word) left join (select cid, sum(cnt) as total from h group by 1) t on t.cid = a.cid""")
def h8(spark, sf):
    asked = read(spark, sf, "lineitem").select((F.col("l_suppkey") + 1).alias("cid"), (word() + 1).alias("word")).distinct()
    return histo.frequencies(asked, clusters(spark, sf)).withColumn("proba", F.round("proba", 6))


@query("h9_totals", "select l_suppkey + 1 as cid, count(*) as total from lineitem group by 1")
def h9(spark, sf):
    return histo.totals(clusters(spark, sf))


@query("h10_inverted_index", f"with {H} select word, string_agg(cid || ':' || cnt, ',' order by cid) as postings from h group by 1")
def h10(spark, sf):
    text = F.array_join(F.transform("postings", lambda p: F.concat_ws(":", p["cid"], p["cnt"])), ",")
    return histo.inverted_index(clusters(spark, sf)).select("word", text.alias("postings"))


@query("h11_idf", f"with {H}, {IDF} select word, df, round(idf, 6) as idf from idf")
def h11(spark, sf):
    return histo.idf(clusters(spark, sf)).select("word", "df", r6("idf"))


@query("h12_weighted_sums", f"""with {H}, {IDF} select cid, round(sum(cnt * idf), 6) as idf_sum, round(sum(idf), 6) as bin_sum, cast(sum(cnt) as double) as plain
from h join idf using (word) group by 1""")
def h12(spark, sf):
    h = clusters(spark, sf)
    w = histo.idf(h)
    a, b, c = histo.weighted_sums(h, w), histo.weighted_sums(h, w, binary=True), histo.weighted_sums(h)
    out = a.withColumnRenamed("weighted_sum", "idf_sum").join(b.withColumnRenamed("weighted_sum", "bin_sum"), "cid").join(c.withColumnRenamed("weighted_sum", "plain"), "cid")
    return out.select("cid", r6("idf_sum"), r6("bin_sum"), "plain")


@query("h13_best_cluster_per_word", f"with {H} select word, cid, cnt from (select *, row_number() over (partition by word order by cnt desc, cid) as r from h) where r = 1")
def h13(spark, sf):
    return histo.best_cluster_per_word(clusters(spark, sf))


@query("h14_ambiguity", f"""with {H} select word, count(*) as clusters, cast(sum(case when cnt / total > 0.002 then 1 else 0 end) as bigint) as strong
from h join (select cid, sum(cnt) as total from h group by 1) using (cid) group by 1""")
def h14(spark, sf):
    return histo.ambiguity(clusters(spark, sf), 0.002)


@query("h14_ambiguity_summary", f"""with {H} select count(*) as words, cast(sum(case when n = 1 then 1 else 0 end) as bigint) as unique_words,
(select count(distinct cid) from h) as clusters from (select word, count(*) as n from h group by 1)""")
def h14s(spark, sf):
    return histo.ambiguity_summary(clusters(spark, sf))


@query("h15_shares", f"with {H} select cid, word, cnt, round(cnt / sum(cnt) over (partition by cid), 6) as share from h")
def h15s(spark, sf):
    return histo.shares(clusters(spark, sf)).withColumn("share", F.round("share", 6))


@query("h15_word_listing", f"""with {K}, long_ as (select track_id from pts group by 1 having count(*) >= 10)
select word, track_id, count(*) as n from pts where track_id in (from long_) and word <> 0 group by rollup (word, track_id) having word is not null""")
def h15(spark, sf):
    return histo.word_listing(keypoints(spark, sf))


NORMED = "a as (select cid, word, cnt / sum(cnt) over (partition by cid) as w from h)"


@query("r1_similarity_scores", f"""with {H}, {IDF}, {NORMED} select x.cid as query_id, y.cid, round(sum(x.w * idf * y.w), 6) as score
from a x join idf using (word) join a y using (word) where x.cid <> y.cid group by 1, 2""")
def r1(spark, sf):
    h = clusters(spark, sf)
    return retrieve.similarity_scores(h.withColumnRenamed("cid", "query_id"), h, True, histo.idf(h)).select("query_id", "cid", r6("score"))


@query("r2_best_match", f"""with {H}, {NORMED}, s as (select x.cid as query_id, y.cid, round(sum(x.w * y.w), 9) as score from a x join a y using (word) where x.cid <> y.cid group by 1, 2)
select query_id, cid, round(score, 6) as score from (select *, row_number() over (partition by query_id order by score desc, cid) as r from s) where r = 1""")
def r2(spark, sf):
    h = clusters(spark, sf)
    s = retrieve.similarity_scores(h.withColumnRenamed("cid", "query_id"), h).withColumn("score", F.round("score", 9))
    return retrieve.best_match(s).select("query_id", "cid", r6("score"))


@query("r3_double_normalised_product", f"""with {H}, t as (select *, sum(cnt) over (partition by cid) as total from h)
select x.cid as query_id, y.cid, round(1e6 * sum((x.cnt / x.total) * (y.cnt / y.total) / (cast(x.total as double) * y.total)), 6) as score
from t x join t y using (word) group by 1, 2""")
def r3(spark, sf):
    h = clusters(spark, sf)
    s = retrieve.double_normalised_product(h.withColumnRenamed("cid", "query_id"), h)
    return s.select("query_id", "cid", F.round(F.col("score") * 1e6, 6).alias("score"))


def _r4(flags: set[str]) -> str:
    """The closed form of the scores in SQL."""
    x = "least(q.cnt, h.cnt)" if "MIN" in flags else "1" if "BIN" in flags else "q.cnt * h.cnt"
    idf = "idf" if "IDF" in flags else "1e0"
    per = "1" if "BIN" in flags else "h2.cnt"
    wsum = f", ws as (select h2.cid, sum({per} * {idf}) as s from h h2 join idf using (word) group by 1)" if "NORM" in flags else ""
    score = f"{x} * {idf}" + ("/ nullif(s, 0)" if "NORM" in flags else "") + ("/ total" if "NORM" in flags and not flags & {"MIN", "BIN"} else "")
    join = "join ws on ws.cid = h.cid" if "NORM" in flags else ""
    return f"""with {H}, {Q}, {IDF}{wsum}, t as (select *, sum(cnt) over (partition by query_id) as total from q),
s as (select q.query_id, h.cid, sum({score}) as score from t q join h using (word) join idf using (word) {join} group by 1, 2)
select query_id, cid, round(score, 6) as score from s where score > 0"""


for _flags in ((), ("NORM",), ("IDF", "NORM"), ("MIN", "IDF", "NORM"), ("BIN", "IDF", "NORM")):

    @query("r4_query_scores_" + ("_".join(_flags).lower() or "freq"), _r4(set(_flags)))
    def r4(spark, sf, flags=frozenset(_flags)):
        return retrieve.query_scores(frame_histograms(spark, sf), clusters(spark, sf), flags).select("query_id", "cid", r6("score"))


def older(spark, sf):
    """The frames' histograms before their last line items came in."""
    o = read(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("query_id"))
    rows = read(spark, sf, "lineitem").where("l_linenumber < 5").select(F.col("l_orderkey").alias("o_orderkey"), word()).join(o, "o_orderkey")
    return histo.histograms(rows, "query_id")


@query("r5_incremental_update", _r4({"MIN", "IDF", "NORM"}))
def r5(spark, sf):
    db, old, new = clusters(spark, sf), older(spark, sf), frame_histograms(spark, sf)
    stored = retrieve.query_scores(old, db, {"MIN", "IDF", "NORM"})
    return retrieve.update_scores(stored, old, new, db).select("query_id", "cid", r6("score"))


for _flags in ((), ("IDF", "NORM")):

    @query("r5_incremental_" + ("_".join(_flags).lower() or "freq"), _r4(set(_flags)))
    def r5_flags(spark, sf, flags=frozenset(_flags)):
        db, old, new = clusters(spark, sf), older(spark, sf), frame_histograms(spark, sf)
        return retrieve.update_scores(retrieve.query_scores(old, db, flags), old, new, db, flags).select("query_id", "cid", r6("score"))


@query("r6_histogram_diff", f"""with {Q}, o as (select o_custkey as query_id, {WORD_SQL} as word, count(*) as cnt from lineitem join orders on l_orderkey = o_orderkey where l_linenumber < 5 group by 1, 2)
select query_id, word, coalesce(o.cnt, 0) as before, coalesce(q.cnt, 0) as after from o full join q using (query_id, word) where coalesce(o.cnt, 0) <> coalesce(q.cnt, 0)""")
def r6_(spark, sf):
    return retrieve.histogram_diff(older(spark, sf), frame_histograms(spark, sf))


def _scored() -> str:
    return _r4({"IDF", "NORM"}).replace("round(score, 6)", "round(score, 9)")


def scored(spark, sf):
    return retrieve.query_scores(frame_histograms(spark, sf), clusters(spark, sf)).withColumn("score", F.round("score", 9))


@query("r7_top_k", f"select query_id, rank, cid, round(score, 6) as score from (select *, cast(row_number() over (partition by query_id order by score desc, cid) as integer) as rank from ({_scored()})) where rank <= 5")
def r7(spark, sf):
    return retrieve.top_k(scored(spark, sf), 5).select("query_id", "rank", "cid", r6("score"))


@query("r8_min_ratio", f"select query_id, cid, round(score, 6) as score from (select *, max(score) over (partition by query_id) as best from ({_scored()})) where score > 0.7 * best")
def r8(spark, sf):
    return retrieve.min_ratio(scored(spark, sf), 0.7).select("query_id", "cid", r6("score"))


@query("r9_retrieve_frames", f"""select query_id, rank, cid, round(score, 6) as score, n_name as comment
from (select *, cast(row_number() over (partition by query_id order by score desc, cid) as integer) as rank from ({_scored()}))
join supplier on s_suppkey + 1 = cid join nation on s_nationkey = n_nationkey where rank <= 3""")
def r9(spark, sf):
    s = read(spark, sf, "supplier").join(read(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    names = s.select((F.col("s_suppkey") + 1).alias("cid"), F.col("n_name").alias("comment"))
    q = histo.histograms(frame_points(spark, sf), "query_id")
    top = retrieve.top_k(retrieve.query_scores(q, clusters(spark, sf)).withColumn("score", F.round("score", 9)), 3)
    return top.join(names, "cid").select("query_id", "rank", "cid", r6("score"), "comment")


@query("r10_similarity_join", f"""with {H}, {NORMED} select x.cid as a, y.cid as b, round(sum(x.w * y.w), 9) as score from a x join a y using (word)
where x.cid < y.cid group by 1, 2 having sum(x.w * y.w) > 0.00001""")
def r10(spark, sf):
    return cluster.similarity_join(clusters(spark, sf), 0.00001).select("a", "b", F.round("score", 9).alias("score"))


def track_words(spark, sf):
    return histo.histograms(keypoints(spark, sf).select(F.col("track_id").alias("cid"), "word"), "cid")


@query("r11_agglomerate")
def r11(spark, sf):
    return cluster.agglomerate(track_words(spark, sf), 0.07)[1]


@query("r12_agglomerate_schedule")
def r12(spark, sf):
    return cluster.agglomerate_schedule(track_words(spark, sf), (0.08, 0.07, 0.06))[1]


@query("io4_packed_clusters", f"with {H} select (cid << 32) | word as cid_val, cid, word, cast(cnt as bigint) as cnt from h")
def io4(spark, sf):
    packed = clusters(spark, sf).select(objects.pack_key(F.col("cid"), F.col("word")).alias("cid_val"), "cnt")
    cid, word = objects.unpack_key(F.col("cid_val"))
    return packed.select("cid_val", cid.alias("cid"), word.alias("word"), "cnt")


@query("io9_union_inputs", f"""with {H}, u as (select 0 as source, * from h union all select 1, o_custkey, word, cnt from (select query_id as o_custkey, word, cnt from ({Q.split(' as ', 1)[1][1:-1]})))
select cast(dense_rank() over (order by source, cid) as bigint) as cid, word, cnt from u""")
def io9(spark, sf):
    return objects.union_inputs(clusters(spark, sf), frame_histograms(spark, sf).withColumnRenamed("query_id", "cid"))
