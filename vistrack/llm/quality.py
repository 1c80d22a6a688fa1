"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

A text is two bags: its words in hashed buckets, and the shapes of its words (letters and digits folded to classes)
with marks for repetition and length. What follows the first 48 characters of a word is counted in pieces, so that
text without spaces enters both bags whole. Both are weighted by inverse document frequencies counted over all documents,
brought to unit length and projected on the leading singular vectors of a bounded sample of labelled rows. Every
document is then compared with every labelled vector of the sample in blocks, and the nearest vote by similarity.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alone, pieces, tidy

#: Buckets of words and of shapes; the weight of the words beside the shapes.
WORDS, SHAPES, WORD_WEIGHT = 768, 256, 0.35
#: Characters of the pieces that a longer word is counted in, as words and as shapes.
PIECE = 48
FOLD = {**dict.fromkeys(map(chr, range(65, 91)), "A"), **dict.fromkeys(map(chr, range(97, 123)), "a"), **dict.fromkeys("0123456789", "0")}
_run = re.compile(r"(.)\1+")


class _Buckets(dict):
    """word -> word bucket * SHAPES + shape bucket; bounded, as it starts anew when full."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        folded = "".join([FOLD.get(c) or ("a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c) for c in word[:PIECE]])
        shape = _run.sub(r"\1", folded) + (">" if len(word) > 24 else "")
        # the last 32 buckets of shapes are for marks
        code = zlib.crc32(word.lower().encode("utf-8", "replace")) % WORDS * SHAPES + zlib.crc32(shape.encode("utf-8", "replace")) % (SHAPES - 32)
        self[word] = code
        return code


_buckets = _Buckets()


def bags(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Counts of a text's word buckets and of its shapes and marks. Every text, empty or null too, has a mark."""
    alone(_buckets)
    words = (text or "").split()
    codes = np.fromiter(map(_buckets.__getitem__, words), np.int64, len(words))
    w = np.bincount(codes // SHAPES, minlength=WORDS)
    s = np.bincount(codes % SHAPES, minlength=SHAPES)
    rest = [_buckets["\0" + x[i : i + PIECE - 1]] for x in words if len(x) > PIECE for i in range(PIECE, len(x), PIECE - 1)]
    if rest:
        more = np.array(rest, np.int64)
        w += np.bincount(more // SHAPES, minlength=WORDS)
        s += np.bincount(more % SHAPES, minlength=SHAPES)
    mark = SHAPES - 32
    s[mark + min(15, int(math.log2(len(words) + 1)))] += 1 + len(words) // 4
    if len(words) > 1:
        same = int((codes[1:] == codes[:-1]).sum())
        s[mark + 16] += same
        s[mark + 17] += int(len(words) - len(np.unique(codes)) > len(words) // 2) * len(words) // 2
    return w, s


def features(texts: Iterator[str | None], idf: np.ndarray | None = None) -> np.ndarray:
    """One row a text: log counts, times idf, each bag of unit length."""
    rows = []
    for t in texts:
        w, s = bags(t)
        rows.append(np.concatenate([w, s]).astype(np.float32))
    x = np.log1p(np.array(rows, np.float32).reshape(-1, WORDS + SHAPES))
    if idf is not None:
        x *= idf
    for a, b, weight in ((0, WORDS, WORD_WEIGHT), (WORDS, WORDS + SHAPES, 1.0)):
        part = x[:, a:b]
        part *= weight / np.maximum(np.sqrt((part * part).sum(1, keepdims=True)), 1e-9)
    return x


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency of every bucket over all of `docs` (text); partitions send sums of fixed length."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(WORDS + SHAPES, np.int64), 0
        for f in frames:
            for t in f["text"]:
                df += np.concatenate(bags(t)) > 0
                n += 1
        yield pd.DataFrame({"k": np.arange(-1, WORDS + SHAPES), "n": np.r_[n, df]})

    got = docs.select("text").mapInPandas(tidy(count), "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(WORDS + SHAPES + 1)
    for r in got:
        df[r["k"] + 1] = r["n"]
    return (np.log((1 + df[0]) / (1 + df[1:])) + 0.1).astype(np.float32)


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """doc_id, y: at most `bound` labelled documents of each class outside the held-out fold, by a hash of doc_id.
    Null labels don't count; of several labels of a document the mean decides."""
    y = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("q"))
        .where("doc_id is not null and q is not null")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((F.avg("q") >= 0.5).cast("int").alias("y"))
        .join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    )
    order = F.xxhash64("doc_id", F.lit("quality sample"))
    return y.where("y = 0").orderBy(order, "doc_id").limit(bound).unionByName(y.where("y = 1").orderBy(order, "doc_id").limit(bound))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, bound: int = 2000, rank: int = 48) -> dict:
    """idf, basis, labelled vectors and labels: the model that every task gets (some 2 MB at the default bound).

    At most 2 * `bound` texts become features, on the executors; the driver holds these rows, 4 KB of bytes each, and
    decomposes their Gram matrix. Only the sample is bounded: document frequencies are those of all documents.
    """
    idf = document_frequencies(docs)
    sample = labelled_sample(docs, labels, bound)

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"y": f["y"], "x": [x.tobytes() for x in features(f["text"], idf)]})

    ids = [(r["doc_id"], r["y"]) for r in sample.collect()]
    if not ids:
        return {"idf": idf, "basis": np.zeros((WORDS + SHAPES, 1), np.float32), "vectors": np.zeros((0, 1), np.float32), "y": np.zeros(0)}
    known = docs.sparkSession.createDataFrame(ids, "doc_id long, y int")
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    got = picked.dropDuplicates(["doc_id"]).orderBy("doc_id").mapInPandas(tidy(rows), "y int, x binary").collect()
    x, y = np.frombuffer(b"".join(r["x"] for r in got), np.float32).reshape(-1, WORDS + SHAPES), np.array([r["y"] for r in got], np.float64)
    del got
    values, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
    basis = vectors[:, np.argsort(values)[::-1][:rank]].astype(np.float32)
    return {"idf": idf, "basis": basis, "vectors": unit(x @ basis), "y": y}


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def vote(x: np.ndarray, model: dict, k: int = 15, power: float = 8.0, block: int = 512) -> np.ndarray:
    """Score of each row of features: the labels of its `k` nearest labelled vectors, weighted by similarity ** power.
    Cosines are exact products of blocks of documents with all labelled vectors; without labels the score is 0.5."""
    known, y = model["vectors"], model["y"]
    if not len(y):
        return np.full(len(x), 0.5)
    out, k = np.empty(len(x)), min(k, len(y))
    for i in range(0, len(x), block):
        sim = unit(x[i : i + block] @ model["basis"]) @ known.T
        top = np.argpartition(sim, len(y) - k, axis=1)[:, len(y) - k :]
        w = np.clip(np.take_along_axis(sim, top, 1), 1e-6, 1.0).astype(np.float64) ** power
        out[i : i + block] = (w * y[top]).sum(1) / w.sum(1)
    return np.clip(out, 0.0, 1.0)


def scored(docs: DataFrame, model: dict, with_text: bool) -> DataFrame:
    """`docs` (text and any others) with a last column __score; the text is left out unless `with_text`."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    out = T.StructType([f for f in docs.schema if with_text or f.name != "text"]).add("__score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in pieces(batches, 1024):
            score = vote(features(b.column("text").to_pylist(), m["idf"]), m)
            kept = [(n, c) for n, c in zip(b.schema.names, b.columns) if with_text or n != "text"]
            yield pa.RecordBatch.from_arrays([c for _, c in kept] + [pa.array(score, pa.float64())], [n for n, _ in kept] + ["__score"])

    return docs.mapInArrow(tidy(run), out)


def quality_scores(docs: DataFrame, labels: DataFrame, bound: int = 2000) -> DataFrame:
    """doc_id, held_out, score, predicted, one row per input row.

    A null or empty text has the mark of no words and is scored by it; long texts are read whole; equal texts have
    equal scores; a null doc_id is not held out; an empty table gives an empty result; without labels all score 0.5.
    Only the text is an input of a score; columns other than doc_id and text are not looked at.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scored(rows, fit(docs, labels, bound), False).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted")
    )


def good_documents(docs: DataFrame, labels: DataFrame, bound: int = 2000) -> DataFrame:
    """The documents that score 0.5 or more; columns as given."""
    return scored(docs, fit(docs, labels, bound), True).where("__score >= 0.5").select(*docs.columns)
