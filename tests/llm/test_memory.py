"""What a Python worker holds between its tasks: it lives on beside its executor's heap, in stages without Python too."""

import ctypes
import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from vistrack.llm import linededup, minhash, quality

WORKER = """
import ctypes, gc, random, sys
import pyarrow as pa
from pyspark import cloudpickle

def held():
    return int(next(x for x in open("/proc/self/status") if x.startswith("VmRSS")).split()[1]) // 1024

def trimmed():
    gc.collect()
    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)
    return held()

r = random.Random(1)
text = lambda: "\\n".join(" ".join(f"w{r.randrange(200_000)}" for _ in range(12)) for _ in range(16))
b = pa.RecordBatch.from_pydict({"row": range(3000), "doc_id": range(3000), "text": [text() for _ in range(3000)]})
trimmed()
for run in cloudpickle.load(open(sys.argv[1], "rb")):
    for _ in run(iter([b])):
        pass
    run = None
    now = held()
    print(now - trimmed())
"""


def runs(spark, monkeypatch):
    """The functions that quality scores, parsed lines and sketches run in the workers."""
    docs, seen = spark.createDataFrame([], "row long, doc_id long, text string"), []
    model = {"idf": None, "vectors": [], "y": []}
    monkeypatch.setattr(quality, "vote", lambda x, m: x[:, 0])
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: seen.append(f))
    quality.scored(docs, model, True)
    linededup.parsed_lines(docs, 3)
    minhash.sketches(docs)
    return seen


@pytest.mark.skipif(not sys.platform.startswith("linux") or not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="needs glibc")
def test_a_worker_gives_back_what_its_tasks_no_longer_use(spark, monkeypatch, tmp_path):
    path = tmp_path / "runs"
    path.write_bytes(cloudpickle.dumps(runs(spark, monkeypatch)[1:]))
    repo = Path(__file__).resolve().parents[2]
    got = subprocess.run([sys.executable, "-c", WORKER, str(path)], cwd=repo, capture_output=True, text=True, timeout=300, env={"PYTHONPATH": ":".join([str(repo), *sys.path])})
    assert got.returncode == 0, got.stderr
    assert max(map(int, got.stdout.split())) < 10, got.stdout


def test_long_batches_keep_their_rows(spark, monkeypatch):
    texts = [f"some words of document {i}" if i % 7 else None for i in range(2500)]
    make = lambda a, b: pa.RecordBatch.from_arrays([pa.array(range(a, b), pa.int64()), pa.array(range(a, b), pa.int64()), pa.array(texts[a:b], pa.string())], ["row", "doc_id", "text"])
    score, lines, sketch = runs(spark, monkeypatch)
    for run, want in ((score, [*range(2500)]), (lines, [i for i in range(2500) if texts[i]]), (sketch, [*range(2500)])):
        out = pa.Table.from_batches(list(run(iter([make(0, 0), make(0, 2400), make(2400, 2500)]))))
        assert out.column("doc_id").to_pylist() == want
        if "text" in out.column_names:
            assert out.column("text").to_pylist() == texts
