"""Byte-level BPE encoding and decoding by merge replay.

A batch of documents is cut into words; the batch's distinct new words are laid end to end, and an inverted index
from token pair to positions replays the merges over all of them at once, in rank order, touching only the
neighbours of what has merged. The rank file and the pattern are parameters; nothing is trained.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alone, tidy


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: lines of base64 token and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


class Merges:
    """Ranks as pair tables. A pair's rank is that of the bytes of its two tokens together."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.byte = np.full(256, -1, np.int64)
        for t, i in ranks.items():
            if len(t) == 1:
                self.byte[t[0]] = i
        pairs = {}
        for t, i in ranks.items():
            for k in range(1, len(t)):
                a, b = ranks.get(t[:k]), ranks.get(t[k:])
                if a is not None and b is not None:
                    pairs[(a << 20) | b] = i
        self.codes = np.fromiter(sorted(pairs), np.int64, len(pairs))
        self.found = np.fromiter((pairs[c] for c in self.codes.tolist()), np.int64, len(pairs))
        self.pairs = pairs

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it is none or where a side is negative (a word's end)."""
        if not len(self.codes):
            return np.full(len(a), -1, np.int64)
        code = (a << 20) | b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where((self.codes[at] == code) & (a >= 0) & (b >= 0), self.found[at], -1)

    def one(self, word: bytes) -> list[int]:
        """A single word, merge by merge: the lowest rank first, the leftmost of equals."""
        ids = [int(self.byte[b]) for b in word]
        while len(ids) > 1:
            rank, at = min(((r, i) for i in range(len(ids) - 1) if (r := self.pairs.get((ids[i] << 20) | ids[i + 1])) is not None), default=(None, 0))
            if rank is None:
                break
            ids[at : at + 2] = [rank]
        return ids

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word. A word that is a token itself is that token."""
        out: list[list[int] | None] = [[r] if (r := self.ranks.get(w)) is not None else None for w in words]
        rest = [k for k, r in enumerate(out) if r is None]
        if not rest:
            return out
        # All words end to end, each followed by a -1 that no pair crosses.
        flat = b"".join(words[k] + b"\0" for k in rest)
        lengths = np.fromiter((len(words[k]) + 1 for k in rest), np.int64, len(rest))
        ends = np.cumsum(lengths)
        tok = self.byte[np.frombuffer(flat, np.uint8)]
        tok[ends - 1] = -1
        n = len(tok)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[-1], prv[0] = n - 1, 0
        index: dict[int, list[np.ndarray]] = {}

        def add(at: np.ndarray, rank: np.ndarray) -> list[int]:
            order = np.argsort(rank, kind="stable")
            rank, at = rank[order], at[order]
            cut = np.flatnonzero(np.diff(rank)) + 1
            new = []
            for r, x in zip(rank[np.r_[0, cut]].tolist(), np.split(at, cut)):
                if r in index:
                    index[r].append(x)
                else:
                    index[r] = [x]
                    new.append(r)
            return new

        rank = self.rank(tok[:-1], tok[1:])
        at = np.flatnonzero(rank >= 0)
        heap = add(at, rank[at]) if len(at) else []
        heapq.heapify(heap)
        odd = []
        while heap:
            r = heapq.heappop(heap)
            got = index.pop(r)
            p = np.sort(np.concatenate(got)) if len(got) > 1 else got[0]
            q = nxt[p]
            ok = self.rank(tok[p], tok[q]) == r  # else one side has merged otherwise
            p, q = p[ok], q[ok]
            if not len(p):
                continue
            clash = np.isin(q, p)
            if clash.any():  # overlapping pairs, as in "aaa": the leftmost goes first
                keep, dead = [], -1
                for i, (a, b) in enumerate(zip(p.tolist(), q.tolist())):
                    if a != dead:
                        keep.append(i)
                        dead = b
                p, q = p[keep], q[keep]
            tok[p], tok[q] = r, -2
            after = nxt[q]
            nxt[p] = after
            prv[after] = p
            before = prv[p]
            right = self.rank(tok[p], tok[after])
            left = self.rank(tok[before], tok[p])
            left[before == p] = -1
            at, rk = np.concatenate([p, before]), np.concatenate([right, left])
            keep = rk >= 0
            if keep.any():
                at, rk = at[keep], rk[keep]
                if (rk <= r).any():  # a merge that should have come before: such words are done one by one
                    odd.append(at[rk <= r])
                for x in add(at, rk):
                    heapq.heappush(heap, x)
        live = tok >= 0
        per = np.add.reduceat(live, np.r_[0, ends[:-1]])
        ids, at = tok[live].tolist(), 0
        for k, m in zip(rest, per.tolist()):
            out[k] = ids[at : at + m]
            at += m
        if odd:
            for j in np.unique(np.searchsorted(ends, np.concatenate(odd), side="right")).tolist():
                out[rest[j]] = self.one(words[rest[j]])
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Codec:
    """A worker's words with their ids and what these decode to; with more than `kept` it starts anew."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, kept: int = 500_000):
        self.merges, self.find, self.kept = Merges(ranks), regex.compile(pattern).findall, kept
        self.ids: dict[str, str] = {}
        self.back: dict[str, bytes] = {}

    def learn(self, texts: list[list[str]]) -> None:
        new = set().union(*texts) if texts else set()
        if len(self.ids) + len(new) > self.kept:
            self.ids, self.back = {}, {}
        new = [w for w in new if w not in self.ids]
        for w, ids in zip(new, self.merges.replay([w.encode("utf-8", "surrogatepass") for w in new])):
            self.ids[w] = ",".join(map(str, ids))
            self.back[w] = self.merges.decode(ids)


_codecs: dict[tuple, Codec] = {}


def codec(ranks: dict[bytes, int], pattern: str, kept: int) -> Codec:
    """The Python worker's codec: built once and kept between its tasks."""
    key = (hash(frozenset(ranks.items())), pattern, kept)
    alone(_codecs)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(ranks, pattern, kept)
    return _codecs[key]


def _batches(texts: pd.Series, chars: int) -> Iterator[list[str]]:
    part, n = [], 0
    for t in texts:
        part.append(t if t is not None else "")
        n += len(part[-1])
        if n >= chars:
            yield part
            part, n = [], 0
    if part:
        yield part


def encoded(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False, chars: int = 16_000_000, kept: int = 500_000) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with `with_ids` also ids (array<int>); one row per input row.

    Ids are those of ordinary text, without special tokens. A null or empty text has no tokens; a very long text is
    encoded whole; equal texts have equal ids; an empty table gives an empty result; columns other than doc_id and
    text are not looked at. The rank file (some 50,000 lines) is read on the driver and broadcast. A worker holds the
    words of some `chars` characters of text and the ids of `kept` distinct words; neither changes a result.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(ranks.value, pattern, kept)
        for f in frames:
            at = 0
            for part in _batches(f["text"], chars):
                rows, words = [], [c.find(t) for t in part]
                c.learn(words)
                for k, w in enumerate(words):
                    words[k] = None  # the words of a batch are most of what a worker holds
                    ids = ",".join(map(c.ids.__getitem__, w))
                    back = hashlib.sha256(b"".join(map(c.back.__getitem__, w))).hexdigest()
                    rows.append((ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), back, np.fromstring(ids, np.int32, sep=",") if with_ids else None))
                out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "ids"])
                out.insert(0, "doc_id", f["doc_id"].to_numpy()[at : at + len(part)])
                at += len(part)
                yield out if with_ids else out.drop(columns="ids")

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(tidy(run), schema)


def decoded(ids: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, data (binary): the bytes that each row's `ids` stand for; null ids stand for nothing."""
    ranks = ids.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = {i: t for t, i in ranks.value.items()}
        join: Callable = lambda x: b"" if x is None else b"".join(tokens[int(i)] for i in x)
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "data": f["ids"].map(join)})

    return ids.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInPandas(run, "doc_id long, data binary")
