"""URL verdicts from rules, and for the rest from trust and distrust spread over the host graph.

Rules (verdict, host, path start) fit a host and its subdomains; the longest rule that fits wins. Hosts of
pages that an allow rule decides are trusted seeds, those that a block rule decides are blocked seeds. Trust
is a personalised PageRank from the trusted seeds along host links; distrust one from the blocked seeds
against the links, so a host that links to blocked ones is distrusted. A host without a deciding rule is
allowed if trust - threshold >= distrust.

Host edges are the absolute links of the pages (also those that begin with ``//``) and, both ways, each host and the
domain above it (with less weight), up to the registrable domain: two labels, or three where the last two are a
country and a short label such as ``co.uk``. Top-level domains are no nodes, so hosts are not tied together by one. Links
are summed per pair of hosts before any ranking, so a hot host is one node with summed edges. What nodes without
out-edges hold returns to the seeds, so ranks sum to 1. Rounds go on until the ranks change by less than ``tolerance``.

Null urls and urls without ``://`` have empty host and path; they have no node and get the verdict of no
trust and no distrust. Null html has no links. Repeated rows are pages like others (and count as such among seeds and
links); extra columns are not read; an empty table gives an empty table. Very long pages are one row each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialize

Rule = tuple[str, str, str]  # verdict, host, path start


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def deciding_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null. ``rules`` is a short list."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, link_weight: float = 1.0, domain_weight: float = 0.25) -> DataFrame:
    """(src, dst, weight) from pages (host, html), summed per pair of hosts."""
    link = F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(r"""(?i)\b(?:href|src)\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?(//[^/?#"'>\s]+)"""), F.lit(1))))
    links = pages.where("host != ''").select(F.col("host").alias("src"), link.alias("to")).select("src", host_of(F.concat(F.lit(":"), "to")).alias("dst"))
    links = links.where("src != dst and dst != ''").groupBy("src", "dst").agg((F.count("*") * link_weight).alias("weight"))
    hosts = pages.select("host").unionByName(links.select(F.col("dst").alias("host"))).where("host != ''").distinct()
    labels = F.split("host", r"\.")
    least = F.when((F.size(labels) > 2) & (F.length(F.element_at(labels, -1)) == 2) & (F.length(F.element_at(labels, -2)) <= 3), 3).otherwise(2)
    chain = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - least + 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    steps = hosts.select(F.explode(F.zip_with(chain, F.slice(chain, 2, F.size(chain)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("s"))
    steps = steps.where("s.b is not null and s.a != '' and s.b != ''").select("s.a", "s.b").distinct()
    both = steps.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(steps.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    return links.unionByName(both.select("src", "dst", F.lit(domain_weight).alias("weight"))).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def spread(edges: DataFrame, seeds: DataFrame, damping: float = 0.6, tolerance: float = 1e-4, most_rounds: int = 300, cut_every: int = 3) -> DataFrame:
    """(host, trust, distrust). ``seeds`` has host, trusted, blocked (weights >= 0).

    Both walks run in one table: ``kind`` 0 follows the edges, 1 goes against them. Ranks are first summed without
    what returns from nodes that have no out-edges, y = seed + damping * P y, one join and one aggregate over hosts a
    round; as that mass goes to the seeds as well, the ranks are y divided by its sum. The sum only grows, by less and
    less each round (at most by the factor ``damping``), and is looked at every ``cut_every`` rounds, when ranks are written.
    """
    walk = edges.select(F.lit(0).alias("kind"), "src", "dst", "weight").unionByName(edges.select(F.lit(1).alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    out = walk.groupBy("kind", "src").agg(F.sum("weight").alias("out"))
    walk = materialize(walk.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("weight") / F.col("out")).alias("share")), "walk")
    start = seeds.select(F.lit(0).alias("kind"), "host", F.col("trusted").alias("seed")).unionByName(seeds.select(F.lit(1).alias("kind"), "host", F.col("blocked").alias("seed"))).where("seed > 0")
    whole = start.groupBy("kind").agg(F.sum("seed").alias("whole"))
    rank = start = materialize(start.join(F.broadcast(whole), "kind").select("kind", "host", (F.col("seed") / F.col("whole")).alias("rank")), "seeds")  # whole: two rows
    total = 0.0
    for k in range(1, most_rounds + 1):
        moved = rank.join(walk, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank"))
        rank = moved.unionByName(start).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if k % cut_every == 0:
            rank = materialize(rank, "rank")
            before, total = total, rank.agg(F.sum("rank")).first()[0] or 0.0
            if total - before <= tolerance * total:
                break
    whole = rank.groupBy("kind").agg(F.sum("rank").alias("whole"))
    rank = rank.join(F.broadcast(whole), "kind").withColumn("rank", F.col("rank") / F.col("whole"))  # whole: two rows
    both = rank.groupBy("host").agg(F.sum(F.when(F.col("kind") == 0, F.col("rank"))).alias("trust"), F.sum(F.when(F.col("kind") == 1, F.col("rank"))).alias("distrust"))
    return both.select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def judge_urls(pages: DataFrame, rules: Sequence[Rule], threshold: float = 0.0, **options) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every row of pages (page_id, url, html)."""
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    decided = parsed.withColumn("decided", deciding_rule(F.col("host"), F.col("path"), rules))
    edges = materialize(host_edges(parsed.select("host", "html")), "edges")
    seeds = decided.where("host != '' and decided is not null").groupBy("host").agg(
        F.sum((F.col("decided.verdict") == "allow").cast("double")).alias("trusted"), F.sum((F.col("decided.verdict") == "block").cast("double")).alias("blocked")
    )
    seeds = seeds.select("host", F.log1p("trusted").alias("trusted"), F.log1p("blocked").alias("blocked"))  # a host's pages vote less and less
    ranks = spread(edges, seeds, **options)
    # a verdict per host first, so that the join's small side has one row a host
    judged = materialize(ranks, "trust")
    found = decided.drop("html").join(judged, "host", "left").withColumns({"trust": F.coalesce("trust", F.lit(0.0)), "distrust": F.coalesce("distrust", F.lit(0.0))})
    own = F.when(F.col("trust") - threshold >= F.col("distrust"), "allow").otherwise("block")
    return found.select("page_id", "host", "path", F.col("decided.rule").alias("rule"), F.coalesce(F.col("decided.verdict"), own).alias("verdict"), "trust", "distrust")
