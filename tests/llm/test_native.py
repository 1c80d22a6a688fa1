"""Mixing, secret scans, sharding and url filters against brute force, and their cases at the edge."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from vistrack.llm import kdshard, mix, secrets, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string"


def docs(spark, rows):
    """Documents with two more columns, whose names operators use themselves."""
    return spark.createDataFrame([(i, t, lang, source, len(t or ""), "x", "y") for i, t, lang, source in rows], DOCS)


EDGE = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, "one two three", None, "a"), (3, "one two three", None, "a"),
    (4, "x " * 60_000, "de", None), (None, "no id", "en", "b"), (5, "same text here", "en", "b"), (6, "same text here", "en", "b"), (7, "\u00a0 \x85w", "fr", "c"),
]


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def water_fill(sizes, weights):
    total, targets, open_ = sum(sizes.values()), {}, dict(sizes)
    while open_:
        left = total - sum(targets.values())
        level = left / sum(weights[s] for s in open_)
        full = [s for s in open_ if 3 * sizes[s] <= level * weights[s]]
        if not full:
            return targets | {s: level * weights[s] for s in open_}
        for s in full:
            targets[s] = 3 * sizes[s]
            open_.pop(s)
    return targets


def test_mix_targets_and_copies(spark):
    rows = [(i, "w " * (1 + i * 7 % 23), "en", f"s{i % 5}" if i % 11 else None) for i in range(600)] + [(1000 + i, "w", "en", "tiny") for i in range(4)]
    d = docs(spark, rows)
    got = mix.pareto_mix(d).toPandas()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += words(t)
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = water_fill(sizes, {s: 1 + k % 3 for k, s in enumerate(order)})
    by = {s: (r["target"].iloc[0], r["taken"].sum(), r["source_size"].iloc[0]) for s, r in ((None if k != k or k is None else k, g) for k, g in got.groupby("source", dropna=False))}
    for s in sizes:
        assert by[s][2] == sizes[s]
        assert by[s][0] == pytest.approx(want[s])
        assert abs(by[s][1] - want[s]) <= 23  # the largest document
    assert (got["taken"] == got["copies"] * got["size"]).all() and got["copies"].max() <= 3
    again = mix.pareto_mix(d.repartition(7)).toPandas()
    key = lambda f: sorted(zip(f["doc_id"], f["taken"]))
    assert key(got) == key(again)


def test_mix_prefers_longer_documents(spark):
    rows = [(i, "w " * (1 if i % 2 else 64), "en", "s0" if i < 400 else "s1") for i in range(800)]
    got = mix.pareto_mix(docs(spark, rows)).toPandas()
    first = got[got["source"] == "s0"]
    assert first[first["size"] == 64]["copies"].mean() > first[first["size"] == 1]["copies"].mean()


def test_mix_edges(spark):
    got = mix.pareto_mix(docs(spark, EDGE)).toPandas()
    assert len(got) == len(EDGE) and (got[got["size"] == 0]["taken"] == 0).all()
    assert mix.pareto_mix(docs(spark, [])).count() == 0
    out = mix.mixed_documents(docs(spark, EDGE))
    assert out.columns == docs(spark, EDGE).columns


def test_mix_gives_each_row_its_own_copies(spark):
    """Rows without an id, and rows that share one, come as often as the mix takes them."""
    rows = [(None if i % 4 == 0 else i % 9, f"t{i}" + " w" * (i * 5 % 31), "en", f"s{i % 3}") for i in range(240)]
    d = docs(spark, rows)
    out = mix.mixed_documents(d).toPandas()
    want = mix.pareto_mix(d).toPandas()
    assert len(out) == want["copies"].sum() and out["doc_id"].isna().sum() == want[want["doc_id"].isna()]["copies"].sum() > 0
    assert out["text"].map(words).sum() == want["taken"].sum()
    ids = lambda f, n: sorted(Counter(f["doc_id"].fillna(-1).repeat(n)).items())
    assert ids(out, 1) == ids(want, want["copies"])


ASSIGN = re.compile(r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def base(t):
    t = t or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(found)


def test_secret_spans(spark):
    noise = hashlib.sha256(b"1").hexdigest()
    texts = [
        "token: abc secret=token:abcdefgh", "é😀 PassWord = 'hunter2xyz' \u00e9 api_key:\"" + "k" * 9, "AKIAAKIA" + "B" * 20 + " akia", noise + " " + noise,
        "deadbeef" * 3 + "g" + "deadbeef" * 2, None, "", "APIKEY=1234567 password==x tokens=abcdef",
        "see X+zrZv/IbzjZUnhsbWlsecLbwjndTpG0ZynXOif7V+k and aaaaaaaaaaaaaaaaaaaa1111111111", "the_quick_brown_fox_jumps_1 over",
    ]
    d = docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)] + [(0, texts[0], "en", "s")])
    got = {r["doc_id"]: r for r in secrets.secret_spans(d).collect()}
    for i, t in enumerate(texts):
        b = base(t)
        n = Counter(k for _, k, _ in b)
        said = ",".join(f"{secrets.KINDS[k]}:{a}:{e}" for a, k, e in b)
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == (n[0], n[1], n[2]), t
        assert got[i]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert set(said.split(",")) - {""} <= set(got[i]["spans"].split(","))
    assert "random:4:47" in got[8]["spans"] and got[8]["spans"].count("random") == 1
    assert secrets.secret_spans(d).count() == len(texts) + 1
    assert secrets.secret_spans(docs(spark, [])).count() == 0
    masked = {r["doc_id"]: r["text"] for r in secrets.without_secrets(d).collect()}
    assert masked[3] == "<secret> <secret>" and masked[5] is None and masked[9] == texts[9]


def test_secrets_without_a_digit(spark):
    """Keys of letters only reach the battery; runs of words and of few symbols do not pass it."""
    rng = random.Random(11)
    key = lambda symbols, n: "".join(rng.choice(symbols) for _ in range(n))
    lower, both = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    keys = [key(a, n) for a in (lower, lower.upper(), both) for n in (24, 40, 64) for _ in range(20)]
    plain = ["internationalization" * 3, "ABCABCABC" * 6, "l" * 60, "na" * 30, "to-be-or-not-to-be-that-is-the-question-" * 2]
    d = docs(spark, [(i, f"see {t} here", "en", "s") for i, t in enumerate(keys + plain)])
    n = {r["doc_id"]: r["n_random"] for r in secrets.secret_spans(d).collect()}
    assert sum(n[i] for i in range(len(keys))) >= 0.9 * len(keys)
    assert [n[len(keys) + i] for i in range(len(plain))] == [0] * len(plain)


def numpy_battery(token):
    """p1, p2, p3 of one token, straight from the definitions."""
    symbols = next(x for _, made_of, x in secrets.ENCODINGS if re.fullmatch(made_of.strip("^$"), token))
    a, n = len(symbols), len(token)
    plain = token.lower() if a < 52 else token.replace("_", "/").replace("-", "+")
    v = np.array([symbols.index(c) for c in plain], float)
    tail = lambda z: 1 / (1 + math.exp(min(300, 1.5976 * max(-12, min(12, z)) + 0.070565992 * max(-12, min(12, z)) ** 3)))
    chi = sum((np.sum(v == s) - n / a) ** 2 / (n / a) for s in range(a))
    p1 = tail(((chi / (a - 1)) ** (1 / 3) - (1 - 2 / (9 * (a - 1)))) / math.sqrt(2 / (9 * (a - 1))))
    high = v * 2 >= a
    n1, n0, runs = high.sum(), (~high).sum(), 1 + (high[1:] != high[:-1]).sum()
    mean, var = 1 + 2 * n1 * n0 / n, 2 * n1 * n0 * (2 * n1 * n0 - n) / (n * n * (n - 1))
    p2 = min(1, 2 * tail(abs(runs - mean) / math.sqrt(var) if 2 * n1 * n0 > n else 12))
    d = v - v.mean()
    p3 = min(1, 2 * tail(abs((d[1:] * d[:-1]).sum() / (d * d).sum() + 1 / n) * math.sqrt(n) if (d * d).sum() > 0 else 12))
    return a, len(set(plain)), p1, p2, p3


def test_battery_equals_numpy(spark):
    rng = random.Random(5)
    alphabets = ["0123456789abcdef", "abcdefghijklmnopqrstuvwxyz234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCabcxyz019+/", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJ_-"]
    tokens = ["".join(rng.choice(x) for _ in range(n)) for x in alphabets for n in (20, 33, 70, 400)] + ["a" * 30, "ab" * 20, "the-quick-brown-fox-jumps-over"]
    got = secrets.battery(spark.createDataFrame([(t,) for t in tokens], "token string")).collect()
    assert len(got) == len(tokens)
    for r in got:
        a, distinct, *p = numpy_battery(r["token"])
        assert (r["a"], r["distinct"]) == (a, distinct)
        assert np.allclose([r["p1"], r["p2"], r["p3"]], p, rtol=1e-6, atol=1e-9), r["token"]
        half = -sum(map(math.log, p))
        assert r["p"] == pytest.approx(max(1e-30, math.exp(-half) * (1 + half + half * half / 2)), rel=1e-6)


def test_noise_follows_the_false_discovery_bound(spark):
    """Of one length class, the tokens up to the greatest p with p <= q * rank / m (by bins of p) are not noise."""
    rng = random.Random(6)
    tokens = ["".join(rng.choice("0123456789abcdef") for _ in range(32)) for _ in range(60)] + ["".join(rng.choice("0011223abc") for _ in range(32)) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in tokens], "token string")
    at = sorted((min(600, math.floor(-math.log10(r["p"]) * 20)), r["token"], r["distinct"]) for r in secrets.battery(df).collect())
    bins = [b for b, _, _ in at]
    reject = min((b for b in bins if 10 ** (-b / 20) <= 0.05 * sum(x >= b for x in bins) / len(bins)), default=None)
    want = {t for b, t, d in at if (reject is None or b < reject) and d >= 16 * (1 - (15 / 16) ** 32) / 2}
    assert {r["token"] for r in secrets.noise_tokens(df).collect()} == want and 30 < len(want) < 120


def test_secrets_of_a_long_text_in_linear_time(spark):
    """A text of a million characters and 30,000 tokens, each after a character of two UTF-16 units."""
    rng = random.Random(7)
    text = " \U0001f511".join("%032x" % rng.getrandbits(128) for _ in range(30_000))
    began = time.time()
    got = secrets.secret_spans(docs(spark, [(1, text, "en", "s")])).collect()[0]
    assert time.time() - began < 60
    want = [(m.start(), m.end()) for m in re.finditer("[0-9a-f]{24,}", text)]
    assert got["n_hex"] == 30_000 and got["spans"] == ",".join(f"hex:{a}:{b}" for a, b in want)


def test_masking_leaves_the_rest(spark):
    key = "0123456789abcdef" * 2
    texts = [f"token={key} {key}, {key}", f"\U0001f511{key}", key, "nothing", None, ""]
    d = spark.createDataFrame([(None if i % 2 else 1, t, str(i)) for i, t in enumerate(texts)], "doc_id long, text string, base string")
    got = {r["base"]: r["text"] for r in secrets.without_secrets(d).collect()}
    assert got == {"0": "<secret> <secret>, <secret>", "1": "\U0001f511<secret>", "2": "<secret>", "3": "nothing", "4": None, "5": ""}


def test_kd_shards(spark):
    rows = [(i, "t" * (i * 37 % 900), ("en", "de", "fr")[i % 3], f"s{i % 7}") for i in range(3000)] + [(10_000 + i, "copy" * 50, "en", "s0") for i in range(1500)]
    got = kdshard.shard_documents(docs(spark, rows)).toPandas()
    text = {i: t for i, t, _, _ in rows}
    assert (got["size"] == got["doc_id"].map(lambda i: len(text[i]) + 8)).all()
    assert (got["text_crc32"] == got["doc_id"].map(lambda i: zlib.crc32(text[i].encode()))).all()
    by = got.groupby("shard")["size"].sum()
    assert sorted(by.index) == list(range(24))
    assert by.max() - by.min() <= 0.1 * by.mean()  # a third of all rows are copies of one text
    assert got.groupby("shard")["slot"].apply(lambda s: sorted(s) == list(range(len(s)))).all()
    again = kdshard.shard_documents(docs(spark, rows[::-1])).toPandas()
    assert dict(zip(got["doc_id"], zip(got["shard"], got["slot"]))) == dict(zip(again["doc_id"], zip(again["shard"], again["slot"])))


def test_kd_shards_edges(spark):
    got = kdshard.shard_documents(docs(spark, EDGE)).toPandas()
    assert len(got) == len(EDGE) and got["shard"].between(0, 23).all()
    assert got[got["doc_id"] == 1]["text_crc32"].iloc[0] == 0 and got[got["doc_id"] == 1]["size"].iloc[0] == 8
    assert got.groupby("shard")["slot"].apply(lambda s: sorted(s) == list(range(len(s)))).all()
    assert kdshard.shard_documents(docs(spark, [])).count() == 0


def test_kd_shards_of_equal_rows(spark):
    """A third of all rows are one row, with an id or without: they are spread like any others."""
    for i in (None, 7):
        rows = [(i, "same text", "en", "s0")] * 600 + [(k + 100, "t" * (k * 37 % 90), "de", f"s{k % 7}") for k in range(1200)]
        got = kdshard.shard_documents(docs(spark, rows)).toPandas()
        by = got.groupby("shard")["size"].sum()
        assert sorted(by.index) == list(range(24)) and by.max() - by.min() <= 0.1 * by.mean()
        assert got.groupby("shard")["slot"].apply(lambda s: sorted(s) == list(range(len(s)))).all()


def test_mix_draws_rows_without_an_id_one_by_one(spark):
    """The sample isn't by size within a class: of equal rows without an id some are taken and some aren't."""
    rows = [(None, "w " * (8 + k % 2), "en", "a") for k in range(600)] + [(k, "w " * 9, "en", "b") for k in range(300)]
    got = mix.pareto_mix(docs(spark, rows)).toPandas()
    for _, own in got.groupby("source_size"):
        assert abs(own["taken"].sum() - own["target"].iloc[0]) <= 3 * own["size"].max()
    mine = got[got["doc_id"].isna()].groupby("size")["copies"]
    assert (mine.nunique() == 2).all()
    again = mix.pareto_mix(docs(spark, rows[::-1])).toPandas()
    key = lambda t: sorted(map(tuple, t[["doc_id", "size", "copies"]].fillna(-1).astype(int).to_numpy().tolist()))
    assert key(got) == key(again)


PAGES = "page_id long, url string, html string, host string"


def test_url_rules(spark):
    rows = [
        ("http://A.Example.ORG/es/x?y", "a.example.org", "/es/x", "example.org/es/", "block"), ("x://example.org/en/12#t", "example.org", "/en/12", "example.org/en/1", "block"),
        ("https://x.org/fr", "x.org", "/fr", "org/", "allow"), ("https://x.org", "x.org", "", None, "allow"), ("a://notexample.com/de/1", "notexample.com", "/de/1", "com/de/", "block"),
        ("mailto:x", "", "", None, "allow"), (None, "", "", None, "allow"), ("http://u@h.net:80/p/", "h.net:80".join(("u@", "")), "/p/", None, "allow"), ("http://xorg/", "xorg", "/", None, "allow"),
    ]
    d = spark.createDataFrame([(i, r[0], "<p>", "clash") for i, r in enumerate(rows)] + [(0, rows[0][0], None, "clash")], PAGES)
    got = urls.judge_pages(d).collect()
    assert len(got) == len(rows) + 1
    for g in got:
        assert (g["host"], g["path"], g["rule"], g["verdict"]) == rows[g["page_id"]][1:], rows[g["page_id"]]
    assert urls.judge_pages(spark.createDataFrame([], PAGES)).count() == 0
    assert urls.allowed_pages(d).columns == d.columns


def test_distrust_reaches_those_who_link_to_blocked_hosts(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/">x</a>' for h in hosts)
    rows = [
        ("http://bad.com/de/1", ""), ("http://farm.net/1", link("bad.com", "bad.com")), ("http://ring.net/1", link("farm.net")),
        ("http://good.org/1", link("fine.net")), ("http://fine.net/1", link("other.net")), ("http://other.net/1", ""), ("http://alone.net/", link("alone.net")),
    ]
    d = spark.createDataFrame([(i, u, h, "") for i, (u, h) in enumerate(rows)], PAGES)
    got = {g["host"]: g for g in urls.judge_pages(d).collect()}
    assert {h: g["verdict"] for h, g in got.items()} == {
        "bad.com": "block", "farm.net": "block", "ring.net": "block", "good.org": "allow", "fine.net": "allow", "other.net": "allow", "alone.net": "allow"
    }
    assert got["fine.net"]["trust"] > 0 == got["fine.net"]["distrust"] and got["farm.net"]["distrust"] > got["ring.net"]["distrust"] > 0


def test_ranks_equal_brute_force_pagerank(spark):
    """Personalised PageRank by power iteration on the dense matrix; chains, a cycle, hosts without links, two seeds."""
    rng = random.Random(8)
    names = [f"h{i:02d}" for i in range(40)]
    edges = {(a, b): float(rng.randint(1, 4)) for a in names[:30] for b in rng.sample(names, 3) if a != b} | {(names[i], names[i + 1]): 1.0 for i in range(30, 38)}
    edges |= {("h38", "h37"): 2.0}
    good, bad = {"h01": 0.75, "h39": 0.25}, {"h05": 1.0}
    hosts = spark.createDataFrame([(h, good.get(h, 0.0), bad.get(h, 0.0)) for h in names], "host string, good double, bad double")
    links = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src string, dst string, weight double")
    got = {r["host"]: r for r in urls.propagate(hosts, links, {"good": False, "bad": True}, tolerance=1e-5).collect()}

    def ranks(seed, back):
        m, s = np.zeros((40, 40)), np.array([seed.get(h, 0.0) for h in names])
        for (a, b), w in edges.items():
            m[(names.index(a), names.index(b))[::-1] if not back else (names.index(a), names.index(b))] = w
        out = m.sum(0)
        m = m / np.where(out > 0, out, 1)
        r = s
        for _ in range(400):
            flow = 0.85 * m @ r
            r = flow + (1 - flow.sum()) * s
        return r

    for kind, seed, back in (("good", good, False), ("bad", bad, True)):
        assert np.allclose([got[h][kind] for h in names], ranks(seed, back), atol=1e-5)
    assert {r["good"] for r in urls.propagate(hosts.withColumn("good", F.lit(0.0)), links, {"good": False}).collect()} == {0.0}


def test_ranks_of_the_least_links_are_kept(spark):
    hosts = spark.createDataFrame([("a", 1.0), ("b", 0.0), ("c", 0.0)], "host string, good double")
    links = spark.createDataFrame([("a", "b", 1e17), ("a", "c", 1.0)], "src string, dst string, weight double")
    got = {r["host"]: r["good"] for r in urls.propagate(hosts, links, {"good": False}).collect()}
    assert got["b"] == pytest.approx(0.85 / 1.85) and got["c"] == pytest.approx(0.85e-17 / 1.85)


def test_url_filter_keeps_rows_without_an_id(spark):
    d = spark.createDataFrame([(None, "http://a.com/de/1", None, "x"), (None, "http://a.com/fr/1", None, "y"), (3, "http://a.com/fr/1", "z" * 2_000_000, "z"), (3, None, None, "w")], PAGES)
    assert sorted(r[d.columns[-1]] for r in urls.allowed_pages(d).collect()) == ["w", "y", "z"]


def test_kd_splits_equal_sorted_medians(spark):
    """Each split against sorting the node's rows: the widest dimension, at the weighted quantile."""
    rng = random.Random(9)
    rows = [(i, rng.randint(1, 50), rng.random() ** 3, rng.random() * 0.8, 0.25) for i in range(900)] + [(i, 20, 0.5, 0.1, 0.25) for i in range(900, 1000)]
    df = spark.createDataFrame(rows, "i long, w long, a double, b double, c double")
    got = {r["i"]: r["shard"] for r in kdshard.kd_partition(df, "w", ["a", "b", "c"], 7, bins=64, passes=6, tolerance=0.0).collect()}

    def split(part, first, shards):
        if shards == 1:
            return {r[0]: first for r in part}
        dim = max(range(3), key=lambda d: (max(r[2 + d] for r in part) - min(r[2 + d] for r in part), d))
        values, want = sorted({r[2 + dim] for r in part}), sum(r[1] for r in part) * (shards // 2) / shards
        below = lambda cut: sum(r[1] for r in part if r[2 + dim] < cut)
        cut = min([*values, float("inf")], key=lambda v: abs(below(v) - want))
        left, right = [r for r in part if r[2 + dim] < cut], [r for r in part if r[2 + dim] >= cut]
        return split(left, first, shards // 2) | split(right, first + shards // 2, shards - shards // 2)

    assert got == split(rows, 0, 7)
    assert kdshard.kd_partition(df.where("i < 0"), "w", ["a", "b", "c"], 7).count() == 0


def test_kd_walk_stays_small(spark, monkeypatch):
    """No pass, and no plan that asks for a row's shard more than once, holds the walk more than a few times: a condition on
    the node or shard once drew the walk into itself, 121 comparisons for five levels."""
    df = spark.createDataFrame([(i, 1 + i % 7, (i * 37 % 101) / 101, (i * 53 % 997) / 997) for i in range(1000)], "i long, w long, a double, b double")
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    plans, collect = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda d: plans.append(plan(d)) or collect(d))
    got = kdshard.kd_partition(df, "w", ["a", "b"], 24)
    plans += [plan(kdshard.numbered(got, "shard", ["i"], 4)), plan(got.where("shard < 5"))]
    assert len(plans) > 6 and max(p.count(">=") for p in plans) <= 6
    by = [r["sum(w)"] for r in got.groupBy("shard").sum("w").collect()]
    assert len(by) == 24 and sum(by) == sum(1 + i % 7 for i in range(1000)) and max(by) - min(by) <= 30
