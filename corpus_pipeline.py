"""A corpus pipeline of five stages, each calling one operator of vistrack.llm on what its predecessor kept.

Documents go in; token ids come out. All stages but the last return the columns of `documents`:
quality (predicted bad documents go), line dedup (lines of recurring templates go, but for their first document),
near-dedup (one document of each group stays), mixing (documents repeat as often as the mix takes them), encoding.

Rows without a doc_id, or that share one, go through all stages as rows of their own; null and empty texts are scored
by what they are, have no lines and no words (so the mix leaves them out beyond whole copies), and encode to no tokens;
long texts are read whole; empty tables stay empty; other columns pass up to the mixing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vistrack.llm import bpe, linededup, minhash, mix, quality
from vistrack.llm.entry import byte_bpe

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 go; all go or stay alike where their texts are equal."""
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go from all but the first document; rows without a doc_id keep theirs."""
    return linededup.line_deduplicated(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row stays of each group of near copies, the first by doc_id; rows without words all stay."""
    return minhash.distinct_documents(docs, percent=80)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row is repeated as often as the mix takes it, or goes if that is never."""
    return mix.mixed_documents(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests and ids of every row."""
    return bpe.encoded(docs, *byte_bpe(), with_ids=True, chars=3_000_000, kept=150_000)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near dedup", near_stage),
    ("mixing", mix_stage),
    ("byte-level BPE", encode_stage),
]

#: No stage but the last could be put in SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written to the shared folder and read again."""
    from vistrack.llm.common import written

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
