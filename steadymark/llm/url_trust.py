"""URL filter: rules on host and path, and trust propagated over the link graph of hosts.

Trust starts at hosts with pages that a rule allows and follows links (personalised PageRank); distrust
starts at hosts with pages that a rule blocks and follows links backwards, as linking to a bad host is bad.
Only DataFrame operations: hosts and edges are aggregated, each iteration is a join and a sum.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steadymark.llm.common import Scratch, keep, scratch

#: Rounds of the iteration between two cuts of its lineage.
ROUNDS_A_CUT = 4
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, its subdomains and the paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith(f".{self.host}")) & path.startswith(self.path)


#: The rules of the query; fixed values.
RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(pages: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` and the rule's ``decided`` verdict; the longest rule wins."""
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    rule = decided = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = r.fits(F.col("host"), F.col("path"))
        rule, decided = F.when(fits, r.name).otherwise(rule), F.when(fits, r.verdict).otherwise(decided)
    return parsed.withColumns({"rule": rule, "decided": decided})


def host_edges(pages: DataFrame) -> DataFrame:
    """``src``, ``dst``, ``weight``: distinct links between hosts in the pages, and between a host and its parent.

    Links are absolute ``href`` values; relative ones stay on their host and carry nothing. A host is tied
    both ways to the nearest enclosing domain: a subdomain answers for its owner.
    """
    links = (
        pages.select("host", F.explode(F.regexp_extract_all("html", F.lit(r"""(?i)href\s*=\s*["']?((?:[a-z]+:)?//[^"'\s>]+)"""), F.lit(1))).alias("url"))
        .select(F.col("host").alias("src"), host_of(F.when(F.col("url").startswith("//"), F.concat(F.lit("http:"), "url")).otherwise(F.col("url"))).alias("dst"))
        .where((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst")))
        .groupBy("src", "dst")
        .agg(F.log1p(F.count("*")).alias("weight"))
    )
    parent = F.regexp_extract("host", r"\A[^.]+\.([^.]+\..+)\z", 1)
    owned = pages.where(F.col("host") != "").select("host", parent.alias("parent")).where(F.col("parent") != "").distinct()
    tied = owned.select(F.inline(F.array(
        F.struct(F.col("host").alias("src"), F.col("parent").alias("dst"), F.lit(1.0).alias("weight")),
        F.struct(F.col("parent").alias("src"), F.col("host").alias("dst"), F.lit(1.0).alias("weight")),
    )))
    return links.unionByName(tied).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def page_rank(s: Scratch, nodes: DataFrame, edges: DataFrame, seed: str, damping: float, rounds: int) -> DataFrame:
    """``host``, ``rank``: personalised PageRank from the non-negative column ``seed`` of ``nodes``.

    Seeds are scaled to add to 1; without any, all ranks are 0. What reaches a host without links out ends there.
    """
    total = nodes.agg(F.sum(seed).alias("total")).where("total > 0")
    start = nodes.join(F.broadcast(total), how="left").select("host", (F.coalesce(F.col(seed) / F.col("total"), F.lit(0.0)) * (1 - damping)).alias("start"))
    start = s.cut(start)
    out = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    links = s.cut(edges.join(out, "src").select("src", "dst", (damping * F.col("weight") / F.col("out")).alias("part")))
    rank = start.withColumnRenamed("start", "rank")
    for i in range(1, rounds + 1):
        moved = rank.join(links, F.col("host") == F.col("src")).groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("rank") * F.col("part")).alias("got"))
        rank = start.join(moved, "host", "left").select("host", (F.col("start") + F.coalesce("got", F.lit(0.0))).alias("rank"))
        if i % ROUNDS_A_CUT == 0:
            rank = s.cut(rank)
    return rank


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, damping: float = 0.85, rounds: int = 8, threshold: float = 1.0) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``trust`` and ``distrust`` of every row of ``pages``.

    A page without a rule is blocked if the distrust of its host exceeds its trust and ``threshold`` times
    the mean distrust of a host. A host's seed is the share of its pages that rules allow or block.

    A null url, or one without ``://``, has an empty host and path, fits no rule and is allowed. A null or
    empty html has no links. Repeated rows are judged one by one and count as pages. An empty table gives
    no rows. Other columns are ignored.
    """
    spark = pages.sparkSession
    with scratch(spark) as s:
        parsed = ruled(pages, rules)
        judged = s.cut(parsed.drop("html"))
        hosts = judged.where(F.col("host") != "").groupBy("host").agg(
            F.avg(F.when(F.col("decided") == "allow", 1.0).otherwise(0.0)).alias("trusted"),
            F.avg(F.when(F.col("decided") == "block", 1.0).otherwise(0.0)).alias("blocked"),
        )
        edges = s.cut(host_edges(parsed))
        ends = edges.select(F.col("src").alias("host")).union(edges.select("dst")).distinct()
        nodes = s.cut(ends.join(hosts, "host", "full_outer").fillna(0.0, ["trusted", "blocked"]))
        trust = page_rank(s, nodes, edges, "trusted", damping, rounds)
        back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
        distrust = page_rank(s, nodes, back, "blocked", damping, rounds)
        scored = trust.withColumnRenamed("rank", "trust").join(distrust.withColumnRenamed("rank", "distrust"), "host")
        mean = scored.agg(F.avg("distrust").alias("mean"))
        scores = s.cut(scored.join(F.broadcast(mean), how="left").withColumn("bad", (F.col("distrust") > F.col("trust")) & (F.col("distrust") > threshold * F.col("mean"))))
        verdict = F.coalesce("decided", F.when(F.col("bad"), "block"), F.lit("allow"))
        return keep(judged.join(scores, "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust"))
