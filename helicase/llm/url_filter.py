"""URL filters: rules on host and path first; else a host's verdict by trust and distrust propagated over links.

Hosts are vertices; a page's absolute links are edges from its host, weighted by their number. Trust is a personalised
PageRank from trusted seeds along the links; distrust is one from blocked seeds against them (who links to a blocked
host is suspect). Seeds are hosts most of whose pages the rules allow or block. Both walks are one table of edges with
a column that tells them apart, and one join and one aggregation a step. A host whose distrust exceeds its trust and a
share of an average seed's is blocked.

Every step aggregates before its shuffle, and a host's pages are only counted, so a host with a third of all pages is
one row a task; steps go on until the ranks have converged; ranks are joined back to pages by an ordinary join, whose skew adaptive execution splits.

Defined cases: a null url, or one without ``://``, has an empty host and path, no rule and is allowed; null html has no
links; links to a host without pages count as edges; links to the own host don't. Without seeds or links no host is
blocked but by rules. Repeated rows are counted as often as they occur and keep a row each. Extra columns stay, except
those named like the output columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helicase.llm import _common as c

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:https?:)?//([^"'\s/?#<>]+)"""


@dataclass(frozen=True)
class Rule:
    """Fits host and all its subdomains where the path starts with path."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as struct (rule, verdict), or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


#: Ranks are within so much of an average seed's share, in all of a walk's hosts together; far below any threshold.
TOLERANCE = 1e-3
#: More steps than any walk needs: what moves shrinks by the damping in each.
MOST_STEPS = 400


def propagate(edges: DataFrame, seeds: DataFrame, steps: int | None = None, damping: float = 0.85) -> DataFrame:
    """Personalised PageRank: edges (walk, src, dst, w), seeds (walk, host, seed) with seeds of a walk summing to 1;
    returns (walk, host, rank). Mass at a host without edges returns to the seeds. Without steps, until it has converged;
    with them, so many."""
    out = edges.groupBy("walk", "src").agg(F.sum("w").alias("total"))
    share = c.checkpoint(edges.join(out, ["walk", "src"]).select("walk", "src", "dst", (F.col("w") / F.col("total")).alias("p")))
    seeds = c.checkpoint(seeds)
    rank = seeds.select("walk", "host", F.col("seed").alias("rank"))
    sizes = {r["walk"]: r["k"] for r in seeds.groupBy("walk").agg(F.count("*").alias("k")).collect()} if steps is None else {}
    before = rank
    for step in range(MOST_STEPS if steps is None else steps):
        flow = rank.join(share, (rank.walk == share.walk) & (rank.host == share.src)).select(rank.walk, F.col("dst").alias("host"), (F.col("rank") * F.col("p") * damping).alias("m"))
        flow = flow.groupBy("walk", "host").agg(F.sum("m").alias("m"))
        kept = flow.groupBy("walk").agg(F.sum("m").alias("moved"))
        back = seeds.join(kept, "walk", "left").select("walk", "host", (F.col("seed") * (1.0 - F.coalesce("moved", F.lit(0.0)))).alias("m"))
        rank = flow.unionByName(back).groupBy("walk", "host").agg(F.sum("m").alias("rank"))
        if step % 3 == 2:
            rank = c.checkpoint(rank)
            if steps is None:
                # between two written tables: what is still to move is at most the geometric series of these steps' change
                both = rank.select("walk", "host", "rank").unionByName(before.select("walk", "host", (-F.col("rank")).alias("rank")))
                change = both.groupBy("walk", "host").agg(F.abs(F.sum("rank")).alias("d")).groupBy("walk").agg(F.sum("d").alias("d")).collect()
                rest = max((r["d"] * sizes[r["walk"]] for r in change), default=0.0) * damping**3 / (1 - damping**3)
                before = rank
                if rest <= TOLERANCE:
                    return rank
    if steps is None:
        raise RuntimeError(f"ranks have not converged in {MOST_STEPS} steps")
    return rank


def judge(
    pages: DataFrame, url_col: str = "url", html_col: str = "html", rules: Sequence[Rule] = RULES, steps: int | None = None, threshold: float = 0.1
) -> DataFrame:
    """pages with host, path, rule, verdict, trust and distrust; trust and distrust are in average seeds' shares."""
    out = ("host", "path", "rule", "verdict", "trust", "distrust")
    keep = [x for x in pages.columns if x not in out]
    col = lambda x: F.col(f"`{x}`")
    read = pages.select(*[col(x) for x in keep], host_of(col(url_col)).alias("__host"), path_of(col(url_col)).alias("__path"))
    read = read.withColumn("__m", matched(F.col("__host"), F.col("__path"), rules))

    count = lambda v: F.sum(F.when(F.col("__m.verdict") == v, 1).otherwise(0))
    hosts = read.where("__host <> ''").groupBy("__host").agg(F.count("*").alias("n"), count("allow").alias("a"), count("block").alias("b"))
    walk = F.when(F.col("a") * 2 > F.col("n"), "trust").when(F.col("b") * 2 > F.col("n"), "distrust")
    seeded = c.checkpoint(hosts.select(walk.alias("walk"), F.col("__host").alias("host")).where("walk IS NOT NULL"))
    sizes = seeded.groupBy("walk").agg(F.count("*").alias("k"))
    seeds = seeded.join(F.broadcast(sizes), "walk").select("walk", "host", (1.0 / F.col("k")).alias("seed"))  # two rows at most

    target = F.translate(F.regexp_replace(F.col("dst"), r"^[^@]*@", ""), UPPER, LOWER)
    links = read.select(F.col("__host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce(col(html_col), F.lit("")), F.lit(LINK), F.lit(1))).alias("dst"))
    links = links.select("src", target.alias("dst")).where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("w"))
    links = c.checkpoint(links)
    edges = links.select(F.lit("trust").alias("walk"), "src", "dst", "w").unionByName(
        links.select(F.lit("distrust").alias("walk"), F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    )
    ranks = propagate(edges, seeds, steps).join(F.broadcast(sizes), "walk")
    score = lambda v: F.coalesce(F.sum(F.when(F.col("walk") == v, F.col("rank") * F.col("k"))), F.lit(0.0))
    scores = c.checkpoint(ranks.groupBy("host").agg(score("trust").alias("__trust"), score("distrust").alias("__distrust")))

    joined = read.join(scores.withColumnRenamed("host", "__host"), "__host", "left")
    t, d = F.coalesce("__trust", F.lit(0.0)), F.coalesce("__distrust", F.lit(0.0))
    verdict = F.coalesce("__m.verdict", F.when((d > t) & (d >= threshold), "block").otherwise("allow"))
    return joined.select(
        *[col(x) for x in keep], F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__m.rule").alias("rule"), verdict.alias("verdict"),
        t.alias("trust"), d.alias("distrust"),
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(c.table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")
