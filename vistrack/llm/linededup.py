"""Line dedup by a log-template tree of fixed depth.

A line goes down the tree by its number of tokens, then by its leading tokens; tokens with digits are variable from
the start. In a leaf, a position is constant if nearly all its lines hold the same token there; a leaf that is
constant in most positions is one template with variable fields, and lines that agree with its constants are its
instances. Other lines of the leaf are grouped by the tokens they agree in, and each group is made a template in the
same way, until no group is left; so a leaf holds any number of templates. Lines of no template are templates of
their own. A template that recurs across documents is kept where it occurs first (by doc_id) and dropped everywhere
else.

A line is carried as its place, two digests and four bytes a token, never as text. Constants come from counts per
(group, position, token), and all else from sums and joins; sums per key are written before they are joined to the
rows they were taken from, so that adaptive execution can split a leaf, line or template with a third of all lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alone, pieces, tidy, written

_digit = re.compile(r"\d")


class _Tokens(dict):
    """token -> 64-bit hash, that of a variable field for a token with a digit."""

    def __missing__(self, token: str) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[token] = xxhash.xxh3_64_intdigest(("\0" if _digit.search(token) else token).encode("utf-8", "surrogatepass"))
        return h


_tokens = _Tokens()


def parsed_lines(docs: DataFrame, depth: int) -> DataFrame:
    """doc_id, line, n, leaf, own, sig of every line with tokens: its number in the text, token count, the digests of
    its way down the tree and of all its tokens, and its tokens as four bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()  # this operator's own table comes and goes with the task
        for b in pieces(batches):
            doc, line, n, leaf, own, sig = [], [], [], [], [], []
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                for k, x in enumerate((t or "").split("\n")):
                    w = x.split()
                    if not w:
                        continue
                    h = np.fromiter(map(_tokens.__getitem__, w), np.uint64, len(w))
                    doc.append(i)
                    line.append(k)
                    n.append(len(w))
                    leaf.append(xxhash.xxh3_64_intdigest(h[:depth].tobytes(), seed=len(w)) >> 1)
                    own.append(xxhash.xxh3_64_intdigest(h.tobytes()) >> 1)
                    sig.append((h >> np.uint64(32)).astype(">u4").tobytes())
            cols = [pa.array(doc, pa.int64()), pa.array(line, pa.int32()), pa.array(n, pa.int32()), pa.array(leaf, pa.int64()), pa.array(own, pa.int64()), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "line", "n", "leaf", "own", "sig"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    return rows.mapInArrow(tidy(run), "doc_id long, line int, n int, leaf long, own long, sig binary")


def fields(lines: DataFrame) -> DataFrame:
    """g, pos, token of the distinct lines' tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            per, pos, token = _flat(b.column("sig").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("g").to_numpy(), per)), pa.array(pos.astype(np.int32)), pa.array(token)], ["g", "pos", "token"])

    return lines.select("g", "sig").mapInArrow(tidy(run), "g long, pos int, token long")


def _flat(sigs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens per line; the place of each token in its line, and the token."""
    sigs = [np.frombuffer(s, ">u4") for s in sigs]
    per = np.fromiter(map(len, sigs), np.int64, len(sigs))
    pos = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    return per, pos, np.concatenate([*sigs, np.zeros(0, ">u4")]).astype(np.int64)


def keys(lines: DataFrame, depth: int) -> DataFrame:
    """own, key: a digest of (leaf, position, token) for each token below the head, which all lines of a leaf share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            per, pos, token = _flat(b.column("sig").to_pylist())
            below = pos >= depth
            x = np.repeat(b.column("leaf").to_numpy().astype(np.uint64), per)[below] * np.uint64(0x9E3779B97F4A7C15)
            x += (pos[below] * 2**32 + token[below]).astype(np.uint64)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("own").to_numpy(), per)[below]), pa.array(x.astype(np.int64))], ["own", "key"])

    return lines.select("leaf", "own", "sig").mapInArrow(tidy(run), "own long, key long")


def regrouped(rest: DataFrame, depth: int, same: float, salt: int) -> DataFrame:
    """`rest` (distinct lines of no template so far) with a new g: lines of a leaf that agree in the share of `same`
    of their positions in which their tokens are commonest among the leaf's rest. Lines with fewer positions that
    recur at all are left out; as the rest only shrinks they can't be in a template later."""
    k = keys(rest, depth)
    often = written(k.groupBy("key").count().where("count > 1"), "often")
    marks = k.join(often, "key").groupBy("own").agg(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("c"), "key"))).alias("s"))
    need = F.greatest(F.lit(0), F.ceil(same * F.octet_length("sig") / 4).cast("int") - depth)
    at = rest.drop("g").join(marks, "own", "left").withColumn("s", F.coalesce("s", F.array().cast("array<struct<c:bigint,key:bigint>>")))
    g = F.xxhash64("leaf", F.lit(salt), F.sort_array(F.slice(F.col("s.key"), F.lit(1), need)))
    return at.where(F.size("s") >= need).select("leaf", "own", "sig", "lo", "hi", g.alias("g"))


def templates(lines: DataFrame, same: float, agree: float) -> DataFrame:
    """g, constants: the groups g of distinct lines that are templates, as a map from position to token.

    Only groups with lines of several documents and several distinct lines are looked at. A position is constant if
    a share of `agree` of the group's distinct lines hold its commonest token; a group is a template if a share of
    `same` of its positions is constant.
    """
    sizes = lines.groupBy("g").agg(F.count("*").alias("lines"), F.max(F.octet_length("sig") / 4).alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    sizes = written(sizes.where("lines > 1 and lo < hi").select("g", "lines", "n"), "sizes")
    tops = fields(lines.join(sizes.select("g"), "g", "left_semi")).groupBy("g", "pos", "token").count().groupBy("g", "pos").agg(F.max(F.struct("count", F.col("token"))).alias("top"))
    tops = tops.join(sizes, "g").where(F.col("top.count") >= agree * F.col("lines"))
    found = tops.groupBy("g").agg(F.count("*").alias("c"), F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "top.token"))).alias("constants"))
    return found.where(F.col("c") >= same * F.col("n")).select("g", "constants")


def maybe_among(rows: DataFrame, keys: DataFrame, name: str, slots: int = 1 << 20) -> DataFrame:
    """`rows` without most of those whose column `name` (long, 0 or more) isn't in `keys`; none that is goes.

    What is broadcast is a bitmap of at most `slots` rows of 64 bits, whatever the number of keys: a thirtieth as many
    keys as bits let a thirtieth of the other rows pass, and very many let all pass. An exact join is to follow.
    """
    slot = F.shiftright(name, 6) % slots
    bits = keys.groupBy(slot.alias("__slot")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({name} % 64 as int))")).alias("__bits"))
    at = rows.join(F.broadcast(bits), slot == F.col("__slot"))
    return at.where(F.getbit("__bits", F.col(name) % 64) == 1).drop("__slot", "__bits")


def line_forms(lines: DataFrame, depth: int, same: float, agree: float) -> DataFrame:
    """own, form, held of the distinct lines that are instances of a template: it, and how many tokens it holds constant.

    A leaf is one group at first. Lines that don't agree with their group's template, or have none, are grouped anew
    within their leaf by what they agree in, until no group is a template. A group made by `regrouped` always is one,
    and a fifth of its lines at least agree with it, so the rest shrinks in every round.
    """
    shared = lines.groupBy("leaf").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min("own").alias("a"), F.max("own").alias("b"))
    shared = written(shared.where("lo < hi and a < b").select("leaf"), "shared")
    # most lines are alone in their leaf: their tokens are left out before the shuffle; by `own` alone, which says the
    # leaf as well, so that the lines of a leaf are dealt anew
    rest = maybe_among(lines, shared, "leaf").groupBy("own").agg(*(F.min(c).alias(c) for c in ("leaf", "sig")), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    rest = rest.join(shared, "leaf", "left_semi")
    rest, found, salt = written(rest.withColumn("g", F.col("leaf")), "distinct"), [], 0
    while True:
        forms = written(templates(rest, same, agree), "templates")
        if salt and (forms.isEmpty() or salt > 1 and found[-1].isEmpty()):
            return reduce(DataFrame.unionByName, found)
        fits = F.coalesce(agreement(F.col("sig"), F.col("constants")) >= 0.9, F.lit(False))
        at = rest.join(forms, "g", "left").withColumn("fits", fits).withColumn("held", F.size("constants"))
        at = written(at.drop("constants"), "fitted")
        found.append(at.where("fits").select("own", F.col("g").alias("form"), "held"))
        salt += 1
        rest = written(regrouped(at.where("not fits").drop("fits", "held"), depth, same, salt), "rest")


def agreement(sig, constants):
    """Share of a template's constants that a line's tokens agree with."""
    token = lambda i: F.conv(F.hex(F.substring(sig, i * 4 + 1, 4)), 16, 10).cast("long")
    hits = F.size(F.filter(constants, lambda c: token(c["pos"]) == c["token"]))
    return hits / F.size(constants)


def repeated_lines(docs: DataFrame, depth: int = 3, same: float = 0.6, agree: float = 0.8, evidence: int = 64) -> DataFrame:
    """doc_id, lines (sorted numbers): the lines to drop, for the documents that have any.

    A template recurs if (documents - 1) times the square of the tokens it holds constant is `evidence` or more: two
    documents do for 8 tokens in common, 4 for 5 tokens, 65 for a line of one word, as short lines meet by chance.
    """
    lines = written(parsed_lines(docs, depth), "lines")
    forms = line_forms(lines, depth, same, agree)
    at = lines.select("doc_id", "line", "n", "own").join(forms.hint("merge"), "own", "left")
    at = written(at.select("doc_id", "line", F.coalesce("held", "n").alias("held"), F.coalesce("form", "own").alias("form")), "forms")
    seen = at.groupBy("form", "doc_id").agg(F.max("held").alias("held")).groupBy("form").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first"), F.max("held").cast("long").alias("held"))
    seen = written(seen.where(F.col("held") * F.col("held") * (F.col("docs") - 1) >= evidence).select("form", "first"), "seen")
    return at.join(seen.hint("merge"), "form").where("doc_id <> first").groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def without_lines(docs: DataFrame, drop: DataFrame) -> DataFrame:
    """`docs` with `__lines` dropped from the text, and how many lines there were and went as __n, __dropped."""
    at = docs.join(drop.select(F.col("doc_id").alias("__id"), F.col("lines").alias("__lines")).hint("merge"), F.col("doc_id").cast("long") == F.col("__id"), "left").drop("__id")
    at = at.withColumn("__parts", F.when(F.col("__lines").isNotNull(), F.split("text", "\n", -1)))
    numbers = F.array_except(F.sequence(F.lit(0), F.size("__parts") - 1), "__lines")  # by hashing, so linear in the lines
    kept = F.array_join(F.transform(numbers, lambda i: F.get("__parts", i)), "\n")
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return at.select(
        *(F.when(F.col("__lines").isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(c) for c in docs.columns),
        F.coalesce(breaks + 1, F.lit(0)).cast("long").alias("__n"),
        F.coalesce(F.size("__lines"), F.lit(0)).cast("long").alias("__dropped"),
    )


def line_deduplicated(docs: DataFrame, **how) -> DataFrame:
    """The documents without the lines whose template an earlier document has; n_chars, if there, is counted anew.

    A null text stays null and has no lines; an empty text or line is never dropped; a line repeated within one
    document only is kept; a long text is parsed whole. Rows with one doc_id are one document; a row without a
    doc_id is left as it is. A text may come out empty. An empty table gives an empty result; other columns pass.
    """
    out = without_lines(docs, repeated_lines(docs, **how)).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def line_report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_lines, n_dropped, text_sha256 (of what is left; null for a null text), one row per input row."""
    out = without_lines(docs.select("doc_id", "text"), repeated_lines(docs, **how))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__n").alias("n_lines"), F.col("__dropped").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
