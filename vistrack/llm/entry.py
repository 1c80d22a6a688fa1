"""The registered queries of this subpackage: one per operator, over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, covertree, hnsw, kdshard, linededup, merkle, minhash, mix, postings, quality, secrets, urls, whiten

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.pareto_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_pages(table(spark, sf_dir, "pages"))


def op3_hnsw_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def byte_bpe() -> tuple[str, str]:
    """The rank file and the pattern that op5 and the pipeline encode with."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op5_bpe_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), *byte_bpe())


def op7_bottom_k_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdshard.shard_documents(table(spark, sf_dir, "documents"))


def op6_template_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(table(spark, sf_dir, "documents"))


def op8_cover_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.nearest(table(spark, sf_dir, "embeddings"))


def op11_cholesky_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whitened(table(spark, sf_dir, "embeddings"))


def op13_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.nearest(table(spark, sf_dir, "embeddings"))


def op12_octopus_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_manifest(table(spark, sf_dir, "documents"))


#: A field as the leaves have it; and the CRC-32 of a decimal number, bit by bit.
FIELD_SQL = "coalesce(strlen(cast({0} as varchar)) || ':' || cast({0} as varchar), '-')"
CRC_SQL = """xor(4294967295, list_reduce(list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint)), lambda a, c:
  list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)), xor(a, c)), 4294967295::bigint))"""
OP12_SQL = f"""
with recursive leaf as materialized (
  select doc_id, coalesce('=' || lang, '-') as tree, sha256({"||".join(FIELD_SQL.format(c) for c in merkle.FIELDS)}) as h,
         case when {CRC_SQL} % 7 = 0 then sha256({"||".join(FIELD_SQL.format("(n_chars + 1)" if c == "n_chars" else c) for c in merkle.FIELDS)}) end as changed
  from documents
), placed as materialized (
  select *, row_number() over (partition by tree order by doc_id nulls first, h) - 1 as pos, count(*) over (partition by tree) as n from leaf
), node as (
  select tree, 0 as level, pos, n, h from placed
  union all
  select tree, level + 1, pos // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' order by pos)) from node where n > 1 group by tree, level, pos // 2
), kept as materialized (select * from node
), sub as materialized (
  select tree, h as subroot, row_number() over (order by tree) - 1 as pos, count(*) over () as n from kept where n = 1
), above as (
  select 0 as level, pos, n, subroot as h from sub
  union all
  select level + 1, pos // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' order by pos)) from above where n > 1 group by level, pos // 2
), tops as materialized (select * from above
), walk as (
  select doc_id, h as leaf, tree, 0 as level, pos, n, '' as proof, coalesce(changed, h) as folded from placed
  union all
  select w.doc_id, w.leaf, w.tree, w.level + 1, w.pos // 2, (w.n + 1) // 2, w.proof || coalesce(s.h, ''),
         sha256(case when w.pos % 2 = 1 then s.h || w.folded else w.folded || coalesce(s.h, '') end)
  from walk w left join kept s on s.tree = w.tree and s.level = w.level and s.pos = xor(w.pos, 1) where w.n > 1
), half as materialized (
  select w.doc_id, w.leaf, w.proof, w.folded, sub.subroot, sub.pos, sub.n from walk w join sub using (tree) where w.n = 1
), climb as (
  select *, 0 as level from half
  union all
  select c.doc_id, c.leaf, c.proof || coalesce(s.h, ''), sha256(case when c.pos % 2 = 1 then s.h || c.folded else c.folded || coalesce(s.h, '') end),
         c.subroot, c.pos // 2, (c.n + 1) // 2, c.level + 1
  from climb c left join tops s on s.level = c.level and s.pos = xor(c.pos, 1) where c.n > 1
)
select doc_id, leaf, subroot, (select h from tops where n = 1) as root, sha256(proof) as proof_sha256, folded as folded_root,
       folded = (select h from tops where n = 1) as verified
from climb where n = 1
"""


OP8_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as z
  from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id,
         cast(list_sum(list_transform(range(1, len(q.z) + 1), lambda i: q.z[i] * c.z[i])) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.z) = len(c.z)
), ranked as (
  select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""


def queries() -> dict[str, Query]:
    own = (
        op1_pareto_mix, op2_link_trust, op3_hnsw_near_vectors, op4_neighbour_quality, op5_bpe_merge_replay,
        op6_template_line_dedup, op7_bottom_k_near_dedup, op8_cover_tree_top_k, op9_randomness_battery, op10_kd_shards,
        op11_cholesky_whitening, op12_octopus_manifest, op13_posting_lists,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op8_cover_tree_top_k": OP8_SQL, "op12_octopus_manifest": OP12_SQL}
