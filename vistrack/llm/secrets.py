"""Secret scans: patterns plus a battery of randomness tests, in DataFrame operations only.

The base patterns give spans of three kinds. The method adds spans of a fourth kind, `random`: tokens whose symbols
pass for uniform noise in the encoding inferred for them. Per token a chi-squared test of the alphabet, a runs test
and a serial-correlation test give three p-values, combined by Fisher's rule. Tokens of one length class share a
Benjamini-Hochberg bound, so the share of noise wrongly put aside as structured text stays below `q` at every length;
what the bound doesn't reject, and is long enough for its alphabet, is a secret.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

ASSIGN = r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: `AKIA[A-Z0-9]+` of 20 and `[0-9a-f]+` of 24 characters or more: a run that is too short holds no longer match, so
#: the least length stands in the pattern.
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
#: A candidate for the battery: a run of symbols of the text encodings.
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")
#: Encodings in the order of inference: name, what a token must be made of, its symbols in order.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef"),
    ("letters", r"^(?:[A-Z]+|[a-z]+)$", LOWER),
    ("base32", r"^(?:[A-Z2-7]+|[a-z2-7]+)$", LOWER + "234567"),
    ("base36", r"^(?:[A-Z0-9]+|[a-z0-9]+)$", DIGITS + LOWER),
    ("mixed", r"^[A-Za-z]+$", UPPER + LOWER),
    ("base62", r"^[A-Za-z0-9]+$", DIGITS + UPPER + LOWER),
    ("base64", r"^[A-Za-z0-9+/_-]+$", UPPER + LOWER + DIGITS + "+/"),
)
#: A symbol's number in its encoding as one character, so that numbers sort as characters do.
CODES = "".join(map(chr, range(48, 112)))
BINS, PER_DECADE = 600, 20


SPAN = "array<struct<start:int,kind:int,end:int,token:string>>"


def starts(lengths: Column) -> Column:
    """The sum of all elements before each: [3, 1, 4] gives [0, 3, 4].

    An array that grows by one element a step is copied at every step, so the sums run over pieces of about the root
    of the length, and over the pieces' totals.
    """
    n = F.size(lengths)
    piece = F.ceil(F.sqrt(n)).cast("int")

    def scan(x: Column) -> Column:
        begin = F.struct(F.lit(0).alias("all"), F.array().cast("array<int>").alias("before"))
        return F.aggregate(x, begin, lambda s, y: F.struct((s["all"] + y).alias("all"), F.concat(s["before"], F.array(s["all"])).alias("before")))

    pieces = F.transform(F.sequence(F.lit(0), F.ceil(n / piece).cast("int") - 1), lambda k: scan(F.slice(lengths, k * piece + 1, piece)))
    whole = scan(F.transform(pieces, lambda x: x["all"]))["before"]
    return F.when(n > 0, F.flatten(F.zip_with(pieces, whole, lambda x, at: F.transform(x["before"], lambda y: y + at)))).otherwise(F.array().cast("array<int>"))


def with_spans(df: DataFrame, text: str, **patterns: tuple[str, int]) -> DataFrame:
    """Adds a column per name of `patterns` (pattern, kind): array<struct<start, kind, end, token>> of the leftmost
    non-overlapping matches; code points, end exclusive.

    A text is cut once into its matches and once into the gaps between them. The lengths of both in turn, summed up,
    are the places, so that the time grows with the length of the text and not with its square.
    """
    for name, (pattern, _) in patterns.items():
        df = df.withColumn(f"__{name}", F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
    for name, (pattern, _) in patterns.items():  # most texts have no match and aren't cut
        gaps = F.when(F.size(f"__{name}") > 0, F.transform(F.split(text, pattern, -1), F.length))
        df = df.withColumn(f"__{name}_gaps", F.coalesce(gaps, F.array().cast("array<int>")))
    for name in patterns:
        both = F.zip_with(F.slice(f"__{name}_gaps", F.lit(1), F.size(f"__{name}")), f"__{name}", lambda g, m: g + F.length(m))
        df = df.withColumn(f"__{name}_steps", both)
    for name in patterns:
        df = df.withColumn(f"__{name}_ends", F.zip_with(starts(F.col(f"__{name}_steps")), f"__{name}_steps", lambda at, step: at + step))
    for name, (_, kind) in patterns.items():
        span = lambda m, end: F.struct((end - F.length(m)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), m.alias("token"))  # noqa: B023, E731
        df = df.withColumn(name, F.zip_with(f"__{name}", f"__{name}_ends", span))
    return df.drop(*(f"__{n}{s}" for n in patterns for s in ("", "_gaps", "_steps", "_ends")))


def with_base(df: DataFrame, text: str, **more: tuple[str, int]) -> DataFrame:
    """Adds `base`: the spans of the three base kinds by start, then kind as listed; and the columns `more`."""
    df = with_spans(df, text, __assign=(ASSIGN, 0), __access=(ACCESS, 1), __hex=(HEX, 2), **more)
    assign = F.filter("__assign", lambda x: F.length(F.regexp_extract(x["token"], ASSIGN, 1)) >= 6)
    return df.withColumn("base", F.sort_array(F.concat(assign, "__access", "__hex"))).drop("__assign", "__access", "__hex")


def joined(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def normal_tail(z: Column) -> Column:
    """Upper tail of the standard normal, by the logistic form of Page's approximation; never 0."""
    y = F.least(F.greatest(z, F.lit(-12.0)), F.lit(12.0)) * 1.5976 + F.pow(F.least(F.greatest(z, F.lit(-12.0)), F.lit(12.0)), F.lit(3)) * 0.070565992
    return 1 / (1 + F.exp(F.least(y, F.lit(300.0))))


def battery(tokens: DataFrame) -> DataFrame:
    """Adds n, a, distinct, p: length, alphabet size, symbols that occur and the combined p-value of each `token` under
    "uniform noise in its encoding". Sums are of whole numbers, so reruns agree to the last digit."""
    code = bits = F.lit(None).cast("string")
    size = F.lit(None).cast("int")
    for _, made_of, symbols in reversed(ENCODINGS):
        a, fits = len(symbols), F.rlike(F.col("token"), F.lit(made_of))
        plain = F.lower("token") if a < 52 else F.translate("token", "_-", "/+")
        code = F.when(fits, F.translate(plain, symbols, CODES[:a])).otherwise(code)
        size = F.when(fits, a).otherwise(size)
    t = tokens.withColumn("a", size).withColumn("code", code).where("a is not null")
    for a in sorted({len(x[2]) for x in ENCODINGS}):
        bits = F.when(F.col("a") == a, F.translate("code", CODES[:a], "0" * ((a + 1) // 2) + "1" * (a // 2))).otherwise(bits)
    t = t.withColumn("bits", bits).withColumn("parts", F.split("code", ""))
    t = t.withColumn("counts", F.regexp_extract_all(F.array_join(F.sort_array("parts"), ""), F.lit(r"(.)\1*"), F.lit(0)))
    value = lambda c: (F.ascii(c) - ord(CODES[0])).cast("long")
    t = t.withColumn("v", F.transform("parts", value)).withColumn("n", F.length("code").cast("double"))
    zero = F.lit(0).cast("long")
    total = lambda f: F.aggregate("counts", zero, lambda s, x: s + f(value(x), F.length(x).cast("long")))
    t = t.withColumns({"squares": total(lambda v, m: m * m), "sum": total(lambda v, m: m * v), "power": total(lambda v, m: m * v * v)})
    t = t.withColumns({
        "mean": F.col("sum") / F.col("n"),
        "next": F.aggregate(F.sequence(F.lit(1), F.size("v") - 1), zero, lambda s, i: s + F.get("v", i) * F.get("v", i - 1)),
        "n1": F.length(F.replace("bits", F.lit("0"), F.lit(""))).cast("double"),
        "runs": F.regexp_count("bits", F.lit("0+|1+")),
        "distinct": F.size("counts"),
    })
    # 1. chi-squared of the alphabet, by Wilson and Hilferty's cube root
    chi, df = F.col("squares") * F.col("a") / F.col("n") - F.col("n"), F.col("a") - 1.0
    t = t.withColumn("p1", normal_tail((F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))))
    # 2. runs of the upper and lower half of the alphabet
    twice = 2 * F.col("n1") * (F.col("n") - F.col("n1"))
    sd = F.sqrt(twice * (twice - F.col("n")) / (F.col("n") * F.col("n") * (F.col("n") - 1)))
    z = F.when(twice > F.col("n"), F.abs(F.col("runs") - 1 - twice / F.col("n")) / sd).otherwise(12.0)
    t = t.withColumn("p2", F.least(F.lit(1.0), 2 * normal_tail(z)))
    # 3. serial correlation at lag one, from the sums of values, of their squares and of neighbours' products
    var = F.col("power") - F.col("sum") * F.col("mean")
    ends = F.get("v", F.lit(0)) + F.element_at("v", -1)
    lag = F.col("next") - F.col("mean") * (2 * F.col("sum") - ends) + (F.col("n") - 1) * F.col("mean") * F.col("mean")
    z = F.when(var > 1e-9, F.abs(lag / var + 1 / F.col("n")) * F.sqrt("n")).otherwise(12.0)
    t = t.withColumn("p3", F.least(F.lit(1.0), 2 * normal_tail(z)))
    half = -(F.log("p1") + F.log("p2") + F.log("p3"))
    p = F.exp(-half) * (1 + half + half * half / 2)
    return t.withColumn("p", F.greatest(F.lit(1e-30), p)).select(*tokens.columns, "n", "a", "distinct", "p1", "p2", "p3", "p")


def noise_tokens(tokens: DataFrame, q: float = 0.05) -> DataFrame:
    """The tokens that the battery takes for noise.

    Bounds come from counts per (length class, p bin), a table of fixed size, so no length class is sorted. A token
    needs at least half as many symbols as would be distinct in a like number of fair draws.
    """
    t = battery(tokens).withColumn("class", F.floor(F.log2("n") * 2).cast("int"))
    t = t.withColumn("bin", F.least(F.floor(-F.log10("p") * PER_DECADE), F.lit(BINS)).cast("int"))
    t = written(t.drop("p1", "p2", "p3"), "battery")
    counts = t.groupBy("class", "bin").count()
    down, whole = Window.partitionBy("class").orderBy(F.desc("bin")), Window.partitionBy("class")
    bound = (
        counts.withColumn("below", F.sum("count").over(down))
        .withColumn("m", F.sum("count").over(whole))
        .where(F.pow(F.lit(10.0), -F.col("bin") / PER_DECADE) <= q * F.col("below") / F.col("m"))
        .groupBy("class")
        .agg(F.min("bin").alias("reject"))
    )
    t = t.join(bound, "class", "left")
    fair = F.col("a") * (1 - F.pow(1 - 1.0 / F.col("a"), F.col("n")))
    return t.where((F.col("reject").isNull() | (F.col("bin") < F.col("reject"))) & (F.col("distinct") >= fair / 2))


def clear_of_base(found: DataFrame) -> DataFrame:
    """row, t: the spans of `tokens` that overlap no span of `base`, both sorted by place within a row."""
    every = found.select("row", F.explode(F.concat("base", "tokens")).alias("t"))
    here = Window.partitionBy("row").orderBy("t.start", "t.kind", "t.end")
    after = Window.partitionBy("row").orderBy(F.desc("t.start"), F.desc("t.kind"), F.desc("t.end"))
    base = F.col("t.kind") < KINDS.index("random")
    at = every.withColumn("ended", F.max(F.when(base, F.col("t.end"))).over(here)).withColumn("next", F.min(F.when(base, F.col("t.start"))).over(after))
    free = (F.coalesce("ended", F.lit(0)) <= F.col("t.start")) & (F.col("next").isNull() | (F.col("next") >= F.col("t.end")))
    return at.where(~base & free).select("row", "t")


def secret_spans(docs: DataFrame, q: float = 0.05) -> DataFrame:
    """Spans of secrets in every whole text: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    One row per input row, equal rows included. A null or empty text has no spans (the digest is that of an empty
    text); a very long text is one row like any other, scanned in time that grows with its length; an empty table
    gives an empty result; columns other than doc_id and text are not looked at. A random span overlaps no base span.
    """
    found = spans_by_row(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), q)
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.sort_array(F.concat("base", "noise"))).alias("spans"),
        F.size("noise").cast("long").alias("n_random"),
    )


def spans_by_row(docs: DataFrame, q: float, keep_text: bool = False) -> DataFrame:
    """The columns of `docs` (text only with `keep_text`), base and noise: the spans of each row."""
    found = with_base(docs.withColumn("__t", F.coalesce("text", F.lit(""))), "__t", tokens=(TOKEN, KINDS.index("random"))).drop("__t", *() if keep_text else ("text",))
    found = written(found.withColumn("row", F.monotonically_increasing_id()), "spans")
    noise = noise_tokens(clear_of_base(found).select("row", "t", F.col("t.token").alias("token")), q)
    noise = noise.groupBy("row").agg(F.collect_list("t").alias("noise"))
    return found.join(noise, "row", "left").withColumn("noise", F.coalesce("noise", F.array().cast(SPAN))).drop("row", "tokens")


def without_secrets(docs: DataFrame, mask: str = "<secret>", q: float = 0.05) -> DataFrame:
    """The documents with the characters of all spans replaced by `mask`, once for spans that overlap; columns as given.

    Rows are masked by their own spans, with or without a doc_id and whatever others share it.
    """
    found = spans_by_row(docs.select(F.struct(*docs.columns).alias("__doc"), "text"), q, keep_text=True)
    hidden = F.flatten(F.transform(F.concat("base", "noise"), lambda x: F.sequence(x["start"], x["end"] - 1)))
    found = found.withColumn("__hidden", F.array_distinct(hidden))
    found = found.withColumns({  # where hidden stretches begin and end
        "__from": F.sort_array(F.array_except("__hidden", F.transform("__hidden", lambda p: p + 1))),
        "__to": F.sort_array(F.array_except(F.transform("__hidden", lambda p: p + 1), "__hidden")),
        "__chars": F.split(F.coalesce("text", F.lit("")), ""),
    })
    piece = lambda a, n: F.array_join(F.slice("__chars", a + 1, n), "")
    before = lambda i: F.when(i > 0, F.get("__to", i - 1)).otherwise(0)
    shown = F.transform("__from", lambda s, i: F.concat(piece(before(i), s - before(i)), F.lit(mask)))
    last = F.element_at("__to", -1)
    done = F.concat(F.array_join(shown, ""), piece(last, F.greatest(F.lit(0), F.size("__chars") - last)))
    found = found.withColumn("__done", F.when(F.size("__hidden") > 0, done).otherwise(F.col("text")))
    return found.select(*(F.col("__done").alias(c) if c == "text" else F.col(f"__doc.{c}") for c in docs.columns))
