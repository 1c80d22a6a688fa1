"""URL filters: rules for some paths, and trust propagated over the host graph for all the rest.

Hosts that rules allow are trusted seeds and hosts that rules block are distrusted seeds, each by the share of their
pages. Trust flows along links (personalised PageRank); distrust flows against them, to those who link to blocked
hosts. A host with more distrust than `threshold` times its trust is blocked.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed, small, written

#: Addresses in the attributes that name another page.
LINK = r"""(?i:href|src)\s*=\s*["']([^"']*)["']"""

#: Units of rank mass in all seeds together, and what counts them: sums of whole numbers don't depend on their order.
UNITS, WHOLE = 1e30, "decimal(38,0)"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules in force.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def after_scheme(url: Column) -> Column:
    """What follows the first `://`; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule's name, or null; a rule fits its host and all subdomains if the path starts with its own."""
    best = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        best = F.when(((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path)), r.name).otherwise(best)
    return best


def verdict_of(rule: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    out = F.lit(None).cast("string")
    for r in rules:
        out = F.when(rule == r.name, r.verdict).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, weight: links between different hosts, counted. Relative links stay on their host and give no edge.
    Links are counted per (host, host) before the shuffle, so a host with a third of all pages is a few rows."""
    links = pages.select("host", F.explode(F.regexp_extract_all(F.col("html"), F.lit(LINK), F.lit(1))).alias("link"))
    dst = F.when(F.startswith("link", F.lit("//")), host_of(F.concat(F.lit("x:"), F.col("link")))).otherwise(host_of(F.col("link")))
    return links.select(F.col("host").alias("src"), dst.alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def propagate(hosts: DataFrame, edges: DataFrame, seeds: dict[str, bool], damping: float = 0.85, tolerance: float = 1e-5, rounds: int = 200) -> DataFrame:
    """host and, by name, a rank for each column of `seeds` (shares of `hosts`): personalised PageRank over `edges`
    (src, dst, weight), taken backwards where `seeds` says so.

    The mass of hosts without links returns to the seeds, which only scales all ranks alike. So a round passes on just
    what the round before brought: mass = seed, then damping * mass over the links, and so on. Ranks are the sums of
    all rounds, scaled to 1. Rounds go on until what is passed on is less than `tolerance` of the seeds; more than
    `rounds` are an error. Mass is counted in whole units of 1e-30, so reruns agree to the last digit whatever the
    order of the sums, and what a round loses to rounding, half a unit a link and 1e-16 of the mass, stays far below
    the tolerance with any number of links. Without any seed every rank is 0.
    """
    ways = [(name, "dst", "src") if back else (name, "src", "dst") for name, back in seeds.items()]
    share = None
    for name, a, b in ways:
        way = edges.select(F.lit(name).alias("kind"), F.col(a).alias("src"), F.col(b).alias("dst"), "weight")
        share = way if share is None else share.unionByName(way)
    out = written(share.groupBy("kind", "src").agg(F.sum("weight").alias("out")), "out")
    share = written(share.join(small(out), ["kind", "src"]).select("kind", "src", "dst", (damping * F.col("weight") / F.col("out")).alias("share")), "share")
    units = lambda c: (F.coalesce(F.col(c), F.lit(0.0)) * UNITS).cast(WHOLE)
    flow = written(hosts.select("host", F.explode(F.array(*(F.struct(F.lit(n).alias("kind"), units(n).alias("mass")) for n in seeds))).alias("s")).select("s.kind", "host", "s.mass").where("mass > 0"), "flow")
    parts = [flow]
    for _ in range(rounds):
        flow = flow.join(share.withColumnRenamed("src", "host"), ["kind", "host"]).groupBy("kind", F.col("dst").alias("host"))
        flow = checkpointed(flow.agg(F.sum((F.col("mass").cast("double") * F.col("share")).cast(WHOLE)).cast(WHOLE).alias("mass")).where("mass > 0"))
        moved = flow.groupBy("kind").agg(F.sum("mass").alias("m")).agg(F.max("m")).first()[0] or 0  # one number
        if moved:
            parts.append(flow)
        if moved < tolerance * UNITS:
            break
    else:
        raise RuntimeError(f"ranks did not settle in {rounds} rounds")
    sums = reduce(DataFrame.unionByName, parts).groupBy("host").agg(*(F.sum(F.when(F.col("kind") == n, F.col("mass"))).alias(f"__{n}") for n in seeds))
    sums = written(sums, "ranks")
    total = sums.agg(*(F.sum(f"__{n}").cast("double").alias(n) for n in seeds)).first()
    at = hosts.select("host").join(sums, "host", "left")
    return at.select("host", *((F.coalesce(F.col(f"__{n}").cast("double"), F.lit(0.0)) / (total[n] or 1.0)).alias(n) for n in seeds))


def host_verdicts(judged: DataFrame, edges: DataFrame, threshold: float = 1.0) -> DataFrame:
    """host, trust, distrust, method ('allow' or 'block') for every host of `judged` (host, by_rule) and of the links."""
    share = lambda v: F.avg(F.coalesce((F.col("by_rule") == v).cast("double"), F.lit(0.0)))
    seeds = judged.where("host <> ''").groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad"))
    linked = edges.select(F.explode(F.array("src", "dst")).alias("host")).distinct()
    hosts = linked.join(seeds, "host", "full_outer").select("host", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("good", "bad")))
    hosts = checkpointed(hosts)
    total = hosts.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    hosts = hosts.select("host", *((F.col(c) / (total[c] or 1.0)).alias(c) for c in ("good", "bad")))
    ranks = propagate(hosts, edges, {"good": False, "bad": True}).withColumnsRenamed({"good": "trust", "bad": "distrust"})
    return ranks.withColumn("method", F.when(F.col("distrust") > threshold * F.col("trust"), "block").otherwise("allow"))


def judge_pages(pages: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 1.0, as_is: bool = False) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every page, one row per input row.

    A null url, or one without `://`, has an empty host and path and no rule, and is allowed: the method knows
    nothing against it. A null html has no links. Equal rows are judged alike; an empty table gives an empty result;
    columns other than page_id, url and html are not looked at. With `as_is` page_id may be of any type.
    """
    at = pages.select((F.col("page_id") if as_is else F.col("page_id").cast("long")).alias("page_id"), "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    edges = written(host_edges(at), "edges")
    judged = at.drop("html").withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules)).withColumn("by_rule", verdict_of(F.col("rule"), rules))
    hosts = written(host_verdicts(judged, edges, threshold), "hosts")
    verdict = F.coalesce("by_rule", "method", F.lit("allow")).alias("verdict")
    return judged.join(small(hosts), "host", "left").select("page_id", "host", "path", "rule", verdict, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("trust", "distrust")))


def allowed_pages(pages: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 1.0) -> DataFrame:
    """The pages whose verdict is not `block`; columns as given."""
    judged = judge_pages(pages.select(F.struct(*pages.columns).alias("page_id"), "url", "html"), rules, threshold, as_is=True)
    return judged.where("verdict <> 'block'").select("page_id.*")
