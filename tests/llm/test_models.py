"""Encoding against the public library, the classifier on held-out labels, and the pipeline's stages."""

import hashlib
import importlib.util
import random
import tracemalloc
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from vistrack.llm import bpe, common, minhash, quality
from vistrack.llm.entry import byte_bpe, oracle_sql, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, score string, held_out string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "", "", "") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def library():
    path, pattern = byte_bpe()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


TEXTS = [
    None, "", " ", "aaaaaaaaaaaaaaaa aaa", "don't I'LL we've \u2019s", "\u65e5\u672c\u8a9e \U0001f389\U0001f389 \u00e9\u00e8", "\x1c\x1d a\x85b\xa0c\n\n\n  x  ", "ab" * 3000, "<|endoftext|> x", "1234567890 " * 50, "\t\tif x:\r\n", "caf\u0065\u0301 \u200b"
]


def test_encoding_equals_the_library(spark, library):
    rng = random.Random(6)
    texts = TEXTS + ["".join(rng.choice("abe th nino\n 12'sr\u00e9!\u4e2d") for _ in range(rng.randrange(400))) for _ in range(200)]
    d = docs(spark, list(enumerate(texts)) + [(3, texts[3])])
    got = bpe.encoded(d, *byte_bpe(), with_ids=True).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        t = texts[r["doc_id"]] or ""
        ids = library.encode_ordinary(t)
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    back = bpe.decoded(bpe.encoded(d, *byte_bpe(), with_ids=True), byte_bpe()[0])
    assert all(bytes(r["data"]).decode() == (texts[r["doc_id"]] or "") for r in back.collect())
    assert bpe.encoded(docs(spark, []), *byte_bpe()).count() == 0


def test_query_encodes_whole_documents(spark, library):
    got = {r["doc_id"]: r["n_tokens"] for r in queries()["op5_bpe_merge_replay"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        assert got[r["doc_id"]] == len(library.encode_ordinary(r["text"]))


def test_merges_that_come_late():
    """A merge may make a pair of lower rank possible; such words are done merge by merge."""
    tokens = [bytes([c]) for c in b"abcd"] + [b"bc", b"abc", b"cd", b"ab"]
    ranks = {t: i for i, t in enumerate(tokens)} | {bytes([c]): 100 + c for c in range(256) if c not in b"abcd"}
    m = bpe.Merges(ranks)
    rng = random.Random(2)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 12))).encode() for _ in range(500)]
    lib = tiktoken.Encoding("t", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    assert m.replay(words) == [lib.encode_ordinary(w.decode()) for w in words]


@pytest.fixture(scope="module")
def scored(spark):
    s = quality.quality_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    return s.toPandas()


def test_held_out_accuracy(spark, scored):
    import zlib

    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    assert (scored["held_out"] == scored["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    both = scored.merge(labels, on="doc_id")
    out = both[both["held_out"]]
    assert len(out) > 80 and (out["predicted"] == out["quality"]).mean() >= 0.93
    bad = out[out["quality"] == 0]["score"].mean()
    assert out[out["quality"] == 1]["score"].mean() - bad > 0.6
    assert scored["score"].between(0, 1).all() and (scored["predicted"] == (scored["score"] >= 0.5)).all()


def test_votes_equal_brute_force():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, quality.WORDS + quality.SHAPES)).astype(np.float32)
    basis = np.linalg.qr(rng.normal(size=(quality.WORDS + quality.SHAPES, 6)))[0].astype(np.float32)
    known, y = quality.unit(rng.normal(size=(30, 6)).astype(np.float32)), (rng.random(30) > 0.5).astype(float)
    got = quality.vote(x, {"basis": basis, "vectors": known, "y": y}, k=5, block=7)
    for i in range(40):
        v = x[i] @ basis
        sim = known @ (v / np.linalg.norm(v))
        top = np.argsort(-sim)[:5]
        w = np.clip(sim[top], 1e-6, 1) ** 8
        assert got[i] == pytest.approx((w * y[top]).sum() / w.sum(), abs=1e-4)


def test_all_of_a_long_word_enters_both_bags():
    head = "a1B" * 16
    for a, b in ((head + "x" * 90, head + "7-" * 45), (head + "x" * 90 + "Q", head + "x" * 90), ("\u6f22\u5b57" * 40, "\u6f22\u5b57" * 30 + "\u3002" * 20)):
        for x, y in zip(quality.bags(a), quality.bags(b)):
            assert (x != y).any()
    w, s = quality.bags("y" * 48_000)
    assert w.sum() == 1 + -(-(48_000 - 48) // 47) and quality.bags("y" * 48)[0].sum() == 1


def test_labels_and_ids_are_no_inputs(spark):
    good, bad = "Then the people of the town went home and said so.", "BUY!! NOW!! CHEAP!! PILLS!!"
    rows = [(i, (good if i % 2 else bad) + f" {'x' * (i % 7)}") for i in range(300)] + [(1000, good), (2001, good), (3002, None), (3003, ""), (None, good)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)] + [(5, None, 0), (None, 1, 0), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs(spark, rows), labels).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[1000] == by[2001] == by[None] > 0.5 and by[3002] == by[3003]
    assert all((by[i] >= 0.5) == bool(i % 2) for i in range(300))
    kept = quality.good_documents(docs(spark, rows), labels)
    assert kept.columns == docs(spark, rows).columns and {r["doc_id"] for r in kept.collect()} >= {1, 3, 1000, 2001}


def test_a_full_sample_is_small_on_the_driver(spark):
    rows = [(i, " ".join(f"{'good' if i % 2 else 'BAD!!'}{(i * j) % 97}" for j in range(12))) for i in range(3300)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    tracemalloc.start()
    try:
        model = quality.fit(docs(spark, rows), labels)
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    n = len(model["y"])
    known = sorted(i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1)
    assert n == len(known) > 2000 and (model["y"] == [i % 2 for i in known]).all()
    x = quality.features((rows[i][1] for i in known), model["idf"])
    assert np.allclose(model["vectors"], quality.unit(x @ model["basis"]), atol=1e-5)
    # a row of features has 4 KB; as Python's floats it takes eight times as much
    assert peak < 40 + 3 * n * x.shape[1] * 4 / 1e6


def test_a_worker_keeps_the_words_of_one_operator():
    def tables():
        return [len(quality._buckets), len(minhash._hashes), len(bpe._codecs)]

    text, (path, pattern) = "some words that each operator learns", byte_bpe()
    ranks = bpe.read_ranks(path)
    common.alone()
    for _ in range(2):
        first = quality.bags(text)
        quality.bags("another text")
        assert tables() == [8, 0, 0]
        minhash.shingle_set(text)
        assert tables() == [0, 6, 0]
        assert bpe.codec(ranks, pattern, 9) is bpe.codec(ranks, pattern, 9) and tables() == [0, 0, 1]
        assert all((x == y).all() for x, y in zip(first, quality.bags(text)))
        common.alone()
        assert tables() == [0, 0, 0]


def test_classifier_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs(spark, [(1, "a"), (2, None)]), none).collect()
    assert [r["score"] for r in got] == [0.5, 0.5]
    assert quality.quality_scores(docs(spark, []), none).count() == 0


def test_pipeline_stages(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    cols = d.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, SF)
        assert out.columns == cols and dict(out.dtypes) == dict(d.dtypes), name
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert ids <= {r["doc_id"] for r in d.select("doc_id").collect()}
        if name == "near dedup":
            parts = minhash.near_duplicates(d, percent=80).where("kept").count()
            assert len(ids) == parts == out.count()
        assert out.where(F.length("text") != F.col("n_chars")).count() == 0
        d = out
    got = corpus_pipeline.STAGES[-1][1](spark, d, SF)
    assert got.count() == d.count() and got.where("size(ids) <> n_tokens").count() == 0


def test_pipeline_keeps_clean_documents(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = {r["doc_id"] for r in quality.good_documents(d, labels).select("doc_id").collect()}
    clean = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    dirty = {r["doc_id"] for r in labels.where("quality = 0").collect()}
    assert len(clean & kept) >= 0.98 * len(clean) and len(dirty & kept) <= 0.2 * len(dirty)


def test_registered(spark):
    names = set(queries())
    assert {n.split("_")[0] for n in names} == {f"op{k}" for k in range(1, 11)} and set(oracle_sql()) <= names
    assert importlib.util.find_spec("public_tokenizers") and public_tokenizers.PATTERN
