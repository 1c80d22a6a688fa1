"""The pipeline's stages on rows at the edge: each stage against its operator on what its predecessor kept."""

import corpus_pipeline
import pytest
from vistrack.llm import common, minhash, mix

DOCS = "doc_id long, text string, lang string, source string, n_chars long, __row string, size string, key string"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    prose = lambda i: " ".join(f"{a}{i}" for a in "all the words of this document are put down in one line".split())
    junk = lambda i: f"%%{i} ## $$ 00 {i} @@ !! __ "
    rows = [(i, prose(i) if i % 3 else junk(i) * 6, f"s{i % 4}") for i in range(120)]
    rows += [(None, None, "s0"), (None, "", None), (None, prose(500), "s1"), (None, prose(500), "s1"), (7, prose(7), "s3"), (7, prose(7), "s3"), (7, prose(501), None), (200, " ".join(f"w{k}" for k in range(60_000)), "s2"), (201, "", "s2"), (202, None, None)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, "en", s, len(t or ""), "r", "s", "k") for i, t, s in rows], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(120)] + [(None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_hand_on_every_row_they_should(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.written(stage(spark, docs, sf_dir), "stage")
        kept[name] = docs
        if name != "byte-level BPE":
            assert docs.columns == columns, name
        if name == "quality classifier":
            got = [(r["doc_id"], r["text"]) for r in docs.collect()]
            assert sum(1 for i, t in got if i is not None and i < 120 and i % 3) >= 80 and sum(1 for i, t in got if i is not None and i < 120 and not i % 3) <= 2
        elif name == "line dedup":
            assert docs.count() == before.count()
        elif name == "near dedup":
            parts = minhash.near_duplicates(before, 80).where("n_shingles > 0").select("component_id").distinct().count()
            assert docs.count() <= before.count() and docs.where("trim(text) <> ''").select("doc_id").distinct().count() <= parts + 1
            assert docs.groupBy("text").count().where("trim(text) <> '' and count > 1").isEmpty()
        elif name == "mixing":
            assert docs.count() == mix.pareto_mix(before).groupBy().sum("copies").first()[0] > 0
        else:
            assert docs.count() == before.count() and docs.where("doc_id is null").count() == before.where("doc_id is null").count()
    assert corpus_pipeline.run(spark, sf_dir).count() == kept["byte-level BPE"].count()


def test_empty_tables_stay_empty(spark, sf_dir, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_written_tables_can_be_cleared(spark):
    t = common.written(spark.range(3), "gone")
    common.clear(spark)
    with pytest.raises(Exception, match="(?i)exist|not found"):
        spark.read.parquet(t.inputFiles()[0])
