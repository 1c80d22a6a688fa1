"""Near-dedup of texts and vectors, top-k search and line dedup against brute force, and their cases at the edge."""

import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from vistrack.llm import covertree, hnsw, linededup, minhash
from vistrack.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, id long, component string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0, 0, "") for i, t in rows], DOCS)


class Sets:
    """Union and find over anything, with the smallest member as root."""

    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if x]
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    s = {i: shingles(t) for i, t in rows}
    ids, parts = sorted(s), Sets(s)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(s[i] & s[j])
            if s[i] and s[j] and 100 * both >= 85 * (len(s[i]) + len(s[j]) - both):
                parts.join(i, j)
    return {i: (len(s[i]), parts.find(i)) for i in ids}


def corpus(seed, groups=12, members=25):
    """Groups of near copies in all degrees: single words changed, heads and tails cut, chains of edits, a common
    passage in all of them."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    passage, rows = [rng.choice(vocabulary) for _ in range(12)], []
    for g in range(groups):
        text = [rng.choice(vocabulary) for _ in range(rng.choice((4, 9, 30, 80, 200, 500)))]
        for _ in range(members):
            t = list(text)
            for _ in range(rng.randrange(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                t = t[rng.randrange(1 + len(t) // 8) :]
            if rng.random() < 0.4:
                t += passage
            if rng.random() < 0.4:
                text = t  # a chain: the next copies this one
            rows.append((rng.randrange(10**6) * 100 + len(rows) % 100, " ".join(t)))
    return list(dict(rows).items())


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, seed):
    rows = corpus(seed)
    want = brute_components(rows)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == want[i][1]) for i, r in got.items())


def test_near_duplicates_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "A b C"), (5, "a B c"), (5, "a B c"), (6, "a b"), (7, "Ä b c"), (8, "ä b c"), (None, "a b c"), (9, "x y " * 40_000), (10, "x y " * 40_001)]
    got = minhash.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}
    assert by[1] == (0, 1) and by[2] == (0, 2) and by[3] == (0, 3) and by[4] == (1, 4) and by[5] == (1, 4) and by[6] == (1, 6)
    assert by[7][1] == 7 and by[8][1] == 8  # only A-Z are lower-cased
    assert by[9] == (2, 9) and by[10] == (2, 9)
    assert minhash.near_duplicates(docs(spark, [])).count() == 0
    kept = minhash.distinct_documents(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns and 5 not in {r["doc_id"] for r in kept.collect()}


def test_one_row_of_each_group_is_left(spark):
    """Rows that repeat a doc_id, and rows without one, are copies like any others."""
    long_ = " ".join(f"w{i}" for i in range(60))
    rows = [(7, long_), (7, long_), (7, long_), (None, long_), (None, long_ + " x"), (7, "another text of six words"), (None, "no id at all here"), (None, "no id at all here"), (3, None), (3, None), (None, "")]
    got = sorted(((r["doc_id"], r["text"]) for r in minhash.distinct_documents(docs(spark, rows)).collect()), key=str)
    assert got == sorted([(7, long_), (7, "another text of six words"), (None, "no id at all here"), (3, None), (3, None), (None, "")], key=str)
    parts = {(r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    assert parts == {(56, 7, True), (56, 7, False), (57, 7, False), (1, 7, True), (1, None, True), (0, 3, True), (0, None, True)}
    assert minhash.distinct_documents(docs(spark, [])).count() == 0


def _lists(spark, rows):
    return spark.createDataFrame(rows, "v long, id long, c long, lead long, minor boolean")


def test_what_lists_share_is_sent_to_a_block_once(spark, monkeypatch):
    """Twenty lists of the same thirty ids, cut into blocks together: each pair of a minor member with any other one
    meets in every list, and a block gets an id once, whatever the number of lists."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    ids = range(30)
    members = _lists(spark, [(1000 + v, i, i, 0, i > 0) for v in range(20) for i in ids] + [(5000, i, i, 0, i > 0) for i in (0, 3)])
    known = spark.createDataFrame([(i, 2, [i, i + 1]) for i in ids], "id long, n long, sketch array<long>")

    def run(lists):
        got = [(v, *p) for v, x, y in lists for p in [(a, b, len(x), len(y)) for a in x["id"] for b in y["id"]]]
        return pd.DataFrame(got, columns=["v", "a", "b", "x", "y"]).astype("int64")

    seen = minhash._meeting(members, known, known.select("id", F.col("n").alias("w")), run, "v long, a long, b long, x long, y long")
    got = sorted((r["v"], r["a"], r["b"]) for r in seen.collect())
    assert got == sorted([(1000 + v, a, b) for v in range(20) for a in ids if a for b in ids] + [(5000, 3, b) for b in (0, 3)])

    def sent(lists):
        return pd.DataFrame({"n": [len({i for _, x, y in lists for i in [*x["id"], *y["id"]]})]})

    apart = minhash._dealt(members, known.select("id", F.col("n").alias("w"))).where("kind = 2").count()
    cells = minhash._meeting(members.where("v < 5000"), known, known.select("id", F.col("n").alias("w")), sent, "n long")
    assert apart == 0 and sum(r["n"] for r in cells.collect()) <= 30 * 4 + 29 * 4  # not 20 times as many


def test_lists_without_common_members_are_cut_apart(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rows = [(v, 1 + v * 100 + i, 1 + v * 100 + i, 0, True) for v in range(6) for i in range(20)] + [(v, 0, 0, 0, False) for v in range(6)]
    members = _lists(spark, rows)
    kinds = minhash._dealt(members, members.select("id").distinct().withColumn("w", F.lit(1).cast("long"))).select("kind").distinct().collect()
    assert [r["kind"] for r in kinds] == [2]


def test_small_blocks_find_the_same_groups(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 5)
    rows = corpus(3, groups=5, members=20)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_shuffles_of_written_tables_are_freed(spark):
    """No shuffle file of the tables that are written on the way is left, and the setting is as it was before."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    tracker = spark.sparkContext._jsc.sc().env().mapOutputTracker()
    left = lambda: tracker.shuffleStatuses().size()
    rows, before, was = corpus(4, groups=3, members=10), left(), spark.conf.get(key)
    got = minhash.near_duplicates(docs(spark, rows))
    assert left() - before <= 3 and spark.conf.get(key) == was
    assert got.count() == len(rows)


def test_needed_overlap_is_met_by_pairs_at_the_bound(spark):
    """Sets that share exactly 85 % share far more retained values than the prefixes ask for."""
    rng = np.random.default_rng(1)
    for _ in range(300):
        pool = rng.integers(0, 2**62, 400)
        a, b = np.sort(pool[:370]), np.sort(pool[30:])
        assert len(np.intersect1d(a[:64], b[:64])) >= 40


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + k, 401 + k) for k in range(60)] + [(7, 7), (1000, 600)] * 2
    parts = Sets(range(1001))
    for a, b in edges:
        parts.join(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    linked = {i for a, b in edges if a != b for i in (a, b)}
    assert got == {i: parts.find(i) for i in linked}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


VECS = "vec_id long, embedding array<float>, label int, part string, id long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "", 0) for i, v, label in rows], VECS)


def near_rows(n=900, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16))
    for k in range(0, 300):  # a dense group, and pairs
        x[k] = x[0] + rng.normal(size=16) * 0.05
    for k in range(300, 500, 2):
        x[k + 1] = x[k] + rng.normal(size=16) * 0.05
    x[600:650] = x[600]
    return [(int(i), x[i].astype(np.float32).tolist(), int(i % 3 == 0) if i >= 300 else 1) for i in range(n)]


def brute_links(rows):
    x, label = np.array([v for _, v, _ in rows], np.float64), np.array([c for _, _, c in rows])
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    link = (u @ u.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    parts = Sets(range(len(rows)))
    for i, j in zip(*np.nonzero(link)):
        parts.join(int(i), int(j))
    return link.sum(1), [parts.find(i) for i in range(len(rows))]


@pytest.mark.parametrize("shard_rows", [16384, 200])
def test_near_vectors_find_all_links(spark, shard_rows):
    rows = near_rows()
    n, part = brute_links(rows)
    got = {r["vec_id"]: r for r in hnsw.near_vectors(vectors(spark, rows), shard_rows=shard_rows).collect()}
    found = np.array([got[i]["n_links"] for i in range(len(rows))])
    assert (found <= n).all() and found.sum() >= 0.999 * n.sum()
    assert np.mean([got[i]["component_id"] == part[i] for i in range(len(rows))]) >= 0.999
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_near_vectors_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 0), (9, [2.0, 0.0], 0), (9, [2.0, 0.0], 0), (10, [1.0, 0.0, 0.0], 0), (11, [1e30, 1e28], 0), (12, [1.0, 0.0], 1)]
    got = hnsw.near_vectors(vectors(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got}
    assert all(by[i] == (0, i, True) for i in (1, 2, 3, 4, 5, 6, 7, 10, 12))
    assert by[8] == (3, 8, True) and by[9] == (3, 8, False) and by[11] == (3, 8, False)
    assert hnsw.near_vectors(vectors(spark, [])).count() == 0


def test_graph_recall():
    x = hnsw.unit(np.random.default_rng(0).normal(size=(3000, 64)))
    g = hnsw.Graph(x)
    q = hnsw.unit(x[:200] + np.random.default_rng(1).normal(size=(200, 64)) * 0.02)
    ids, _ = g.search(q.astype(np.float32), 64)
    assert np.mean([i in g.order[a[a >= 0]] for i, a in enumerate(ids)]) >= 0.97


def brute_top(rows, k=5):
    z = {i: [int(np.floor(256 * np.float64(np.float32(c)))) for c in v] for i, v, _ in rows}
    out = set()
    for i in z:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(z[i], z[j])), j) for j in z if j != i)[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    return out


@pytest.mark.parametrize("shard_rows", [16384, 150])
def test_cover_tree_top_k(spark, shard_rows):
    rows = near_rows(700, 8)
    got = {tuple(r) for r in covertree.nearest(vectors(spark, rows), shard_rows=shard_rows).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == brute_top(rows)


def test_cover_tree_covers():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(500, 8)) + 20 * rng.normal(size=8) for _ in range(12)]).round()
    t = covertree.cover_tree(x)
    assert sorted(t.order.tolist()) == list(range(len(x))) and (t.end[0], t.start[0]) == (len(x), 0)
    for k in range(len(t.start)):
        at = t.order[t.start[k] : t.end[k]]
        assert (np.sqrt(((x[at] - t.centre[k]) ** 2).sum(1)) <= t.radius[k] + 1e-9).all()
        cos = x[at] @ t.centre[k] / np.sqrt((x[at] ** 2).sum(1)) / t.norm[k]
        assert (np.arccos(np.clip(cos, -1, 1)) <= t.angle[k] + 1e-9).all()
        kids = range(t.first[k], t.last[k])
        assert not kids or [t.start[k], *(t.end[j] for j in kids)] == [*(t.start[j] for j in kids), t.end[k]]
    assert len(t.start) > 20


def plain_top(q, q_id, x, x_id, k):
    s = np.where(q_id[:, None] == x_id[None, :], -np.inf, q @ x.T)
    return {(i, int(x_id[j]), int(s[i, j])) for i in range(len(q)) for j in np.lexsort((x_id, -s[i]))[:k]}


@pytest.mark.parametrize("kind, most", [("clusters", 0.3), ("copies", 0.7), ("noise", 1.0)])
def test_cover_trees_prune_pairs(kind, most):
    """The share of pairs that are scored: few where points cluster, never more than all; results are exact anyway."""
    rng = np.random.default_rng(3)
    if kind == "clusters":
        x = (rng.normal(size=(40, 1, 64)) + 0.25 * rng.normal(size=(40, 200, 64))).reshape(-1, 64)
    elif kind == "copies":
        x = np.concatenate([rng.normal(size=(1000, 64)), rng.normal(size=(1, 64)) + 0.02 * rng.normal(size=(3000, 64))])
    else:
        x = rng.normal(size=(4000, 64))
    x = np.floor(256 * x / np.sqrt((x * x).sum(1, keepdims=True)))
    x_id = rng.permutation(len(x))
    q, q_id = x[::20], x_id[::20]
    row, id_, score, pairs = covertree.top_scores(q, q_id, covertree.cover_tree(q, 32), x, x_id, covertree.cover_tree(x), 5)
    assert set(zip(row.tolist(), id_.tolist(), score.tolist())) == plain_top(q, q_id, x, x_id, 5)
    assert pairs <= most * len(q) * len(x)


def test_large_components_of_any_size():
    q = np.array([[1e30, 1.0], [-3e20, 5.0], [2.0, 2.0]])
    row, id_, score = covertree.large_scores(q, np.array([0, 1, 2]), q, np.array([0, 1, 2]), 2)
    big, small = int(q[0, 0]), int(q[1, 0])
    assert list(zip(row.tolist(), id_.tolist(), score)) == [(0, 2, 2 * big + 2), (0, 1, big * small + 5), (1, 2, 2 * small + 10), (1, 0, big * small + 5), (2, 0, 2 * big + 2), (2, 1, 2 * small + 10)]


def test_cover_tree_edges(spark):
    rows = [(0, [1.0, 1.0], 0), (50, [1.0, float("nan")], 0), (1, [1.0, 1.0], 0), (2, [1.0, 1.0], None), (3, None, 0), (4, [], 0), (100, [-1.0, 0.0], 0), (100, [-1.0, 0.0], 0), (5, [1.0], 0)]
    got = sorted(tuple(r) for r in covertree.nearest(vectors(spark, rows)).select("query_id", "rank", "vec_id", "score").collect())
    s = 2 * 256 * 256
    assert got == [(0, 1, 1, s), (0, 2, 2, s), (0, 3, 100, -s // 2), (0, 4, 100, -s // 2), (100, 1, 0, -s // 2), (100, 2, 1, -s // 2), (100, 3, 2, -s // 2)]
    assert covertree.nearest(vectors(spark, [])).count() == 0


def test_large_components_are_exact(spark):
    rows = [(0, [1e9, 3.0], 0), (1, [1e9, 4.0], 0), (2, [1e9, 5.0], 0)]
    got = covertree.nearest(vectors(spark, rows)).collect()
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == [2, 1]


def test_repeated_lines_go_but_for_the_first(spark):
    long_ = " ".join(f"p{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    rows = [
        (1, f"own line one here that is long enough\n{long_}\nend"), (2, f"another start of a text that is not short\n{long_}"), (3, long_ + "\nunique words in this third text of ours today"),
        (4, "Posted by user 17 at 10:42 on day 3 in room 9"), (5, "Posted by user 4 at 09:01 on day 12 in room 2\nmine"), (6, "twice in one text only, said again here\ntwice in one text only, said again here"),
        (7, None), (8, ""), (9, "short\nshort"), (10, "short"), (None, long_),
    ]
    got = {r["doc_id"]: r for r in linededup.line_deduplicated(docs(spark, rows)).collect()}
    assert got[1]["text"] == rows[0][1] and got[2]["text"] == "another start of a text that is not short"
    assert got[3]["text"] == "unique words in this third text of ours today" and got[3]["n_chars"] == len(got[3]["text"])
    assert got[4]["text"] == rows[3][1] and got[5]["text"] == "mine"
    assert got[6]["text"] == rows[5][1] and got[7]["text"] is None and got[8]["text"] == "" and got[9]["text"] == "short\nshort" and got[10]["text"] == "short"
    assert got[None]["text"] == long_
    report = {r["doc_id"]: r for r in linededup.line_report(docs(spark, rows)).collect()}
    assert (report[3]["n_lines"], report[3]["n_dropped"]) == (2, 1) and report[7]["text_sha256"] is None
    assert linededup.line_deduplicated(docs(spark, [])).count() == 0


def test_exact_repeats_equal_brute_force(spark):
    rng = random.Random(4)
    pool = [" ".join(rng.choice("abcdefghij") * rng.randrange(1, 5) for _ in range(rng.randrange(8, 20))) for _ in range(80)]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.3 else f"own{'x' * i} " + " ".join(rng.choice("klmnopqrst") * rng.randrange(1, 9) for _ in range(9)) for _ in range(6))) for i in range(150)]
    first = {}
    for i, t in rows:
        for x in t.split("\n"):
            first.setdefault(x, i)
    want = {i: "\n".join(x for x in t.split("\n") if first[x] == i) for i, t in rows}
    got = {r["doc_id"]: r["text"] for r in linededup.line_deduplicated(docs(spark, rows)).collect()}
    assert sum(got[i] != want[i] for i in want) <= 2  # lines that differ in a few tokens are one template as well


def test_a_leaf_holds_several_templates(spark):
    """Lines of one length and head: two templates with a name as a field, one of them rarer, among unrelated lines."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(4))
    kinds = {
        "login": lambda: f"2024-01-02 10:00:01 INFO session of {word()} was opened from the office",
        "disk": lambda: f"2024-01-02 10:00:01 INFO volume {word()} is nearly full so clean it",
        "other": lambda: "2024-01-02 10:00:01 INFO " + " ".join(word() for _ in range(8)),
    }
    order = ["login"] * 40 + ["disk"] * 6 + ["other"] * 50
    rng.shuffle(order)
    rows = [(i, f"{kinds[k]()}\nmine{'x' * i}") for i, k in enumerate(order)]
    got = {r["doc_id"]: r["text"] for r in linededup.line_deduplicated(docs(spark, rows)).collect()}
    first = {k: order.index(k) for k in ("login", "disk")}
    assert {i for i, t in rows if got[i] == t} == {i for i, k in enumerate(order) if k == "other" or first[k] == i}


def test_evidence_has_no_step_and_clean_prose_stays(spark):
    """A line of k words goes from the document on at which (documents - 1) * k * k reaches the bound; prose with common
    heads and words stays; a text of 20,000 lines, half of them repeats, is done like any other."""
    rng = random.Random(12)
    lines = {k: " ".join(f"{chr(96 + k)}w{chr(97 + j)}" for j in range(k)) for k in range(1, 10)}
    needs = {k: 1 + -(-64 // (k * k)) for k in lines}
    pool = [f"{a}{b}" for a in ("ba", "ko", "li", "mu", "ne", "ro", "sa", "ti") for b in ("d", "l", "m", "n", "r", "s", "t", "x", "ven", "gor")]
    prose = lambda: "The old man " + " ".join(rng.choice(pool) for _ in range(rng.randrange(7, 12)))
    rows = [(i, "\n".join([prose() for _ in range(3)] + [x for k, x in lines.items() if i < needs[k] - k % 2])) for i in range(70)]
    big = "\n".join(f"row {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} of a long table with some words of its own" for i in range(10_000))
    rows += [(100, big), (101, big + "\n" + "\n".join(f"x{'y' * (i % 50)} {'z' * (i // 50)} own" for i in range(10_000)))]
    got = {r["doc_id"]: (r["text"] or "").split("\n") for r in linededup.line_deduplicated(docs(spark, rows)).collect()}
    for i in range(70):
        text = dict(rows)[i].split("\n")
        gone = [x for x in text if x not in got[i]]
        assert gone == [x for k, x in lines.items() if i and i < needs[k] and not k % 2]
    assert len(got[100]) >= 1 and len(got[101]) == 10_000


@pytest.mark.parametrize("slots", [1, 1 << 20])
def test_bitmap_keeps_every_row_with_a_key(spark, slots):
    rng = random.Random(3)
    values = [rng.randrange(1 << 63) for _ in range(300)] + [0, (1 << 63) - 1]
    rows = spark.createDataFrame([(v,) for v in values] * 2, "leaf long")
    keys = spark.createDataFrame([(v,) for v in values[::3]], "leaf long")
    got = [r["leaf"] for r in linededup.maybe_among(rows, keys, "leaf", slots).collect()]
    assert all(got.count(v) == 2 for v in values[::3])
    assert slots == 1 or len(got) == 2 * len(values[::3])
    assert linededup.maybe_among(rows, keys.limit(0), "leaf", slots).count() == 0
