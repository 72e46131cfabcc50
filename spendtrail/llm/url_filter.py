"""URL filters: rules by host and path, and link-graph propagation of trust and distrust for the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendtrail.llm.common import UPPER, attach_groups, cut

TASK_LINKS = 1 << 17  # links a task of a round takes; it decides the cost alone, never the result


@dataclass(frozen=True)
class Rule:
    """``text`` is the host, the first slash and what follows, the path that a url's path must start with."""

    text: str
    verdict: str  # allow or block

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null and where there is no ://."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Text of the longest rule that fits, else null. A rule fits its host and all subdomains, by the start of the path."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(rule.text)).otherwise(out)
    return out


def verdict_of(rule: Column, rules: list[Rule]) -> Column:
    out = F.lit(None).cast("string")
    for r in rules:
        out = F.when(rule == r.text, F.lit(r.verdict)).otherwise(out)
    return out


def host_links(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(src, dst, weight) between different hosts: absolute and protocol-relative href and src targets, counted, and one link
    each way between a host and each of its parent domains, whether or not these have pages; a top-level domain is no parent. ``pages`` has a column host."""
    tag = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
    target = F.explode(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(tag), 1))
    linked = pages.where("host <> ''").select(F.col("host").alias("src"), target.alias("dst")).select("src", F.translate("dst", UPPER, UPPER.lower()).alias("dst"))
    hosts = pages.where("host <> ''").select("host").distinct()
    labels = F.split("host", r"\.")
    parents = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(2), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("parent")).where("parent <> host and instr(parent, '.') > 0")
    kin = parents.select(F.col("host").alias("src"), F.col("parent").alias("dst"))
    both = kin.unionByName(kin.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return linked.unionByName(both).where("src <> dst and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 0.01, rounds: int = 100, task_links: int = TASK_LINKS) -> DataFrame:
    """(host, rank): personalised PageRank over ``links`` (src, dst, weight) from ``seeds`` (host, weight); see ``propagate_sides``."""
    side = F.lit(0).alias("side")
    return propagate_sides(links.select(side, "src", "dst", "weight"), seeds.select(side, "host", "weight"), damping, tolerance, rounds, task_links).drop("side")


def propagate_sides(links: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 0.01, rounds: int = 100, task_links: int = TASK_LINKS) -> DataFrame:
    """(side, host, rank): personalised PageRank of each side by itself, over ``links`` (side, src, dst, weight) from ``seeds``
    (side, host, weight). Sides are few.

    Ranks are in units of seed weight; what reaches a host without out-links ends there. Hosts never reached are absent. No
    seeds: no rows. Rounds go on until one changes all ranks of each side together by ``tolerance`` of its seeds' weight or
    less, which every fourth shows; if ``rounds`` don't bring that about, an error says so. Each round is one join on the source
    and one sum by target, with partial sums first, and cuts the lineage. It runs in one task for every ``task_links`` links, as
    many rounds over a small graph would else be mostly empty tasks, and joins by merging, so nothing goes through the driver.
    Hosts with more than ``task_links`` links, which are fewer than tasks, are broadcast to theirs instead, wherever these lie.
    """
    tasks = 1 + links.count() // task_links
    start = cut(seeds.groupBy("side", "host").agg(F.sum("weight").cast("double").alias("rank")).coalesce(tasks))
    mass = {side: total for side, total in start.groupBy("side").agg(F.sum("rank")).collect()}
    out = cut(links.groupBy("side", "src").agg(F.sum("weight").alias("out"), F.count("*").alias("n")).coalesce(tasks))
    hubs = None if tasks == 1 or out.where(F.col("n") > task_links).isEmpty() else cut(out.where(F.col("n") > task_links).select("side", F.col("src").alias("host"), "out"))
    edges = links.select("side", F.col("src").alias("host"), "dst", "weight")
    share = (damping * F.col("weight") / F.col("out")).alias("share")
    spread = None
    if hubs is not None:
        spread = cut(edges.join(F.broadcast(hubs), ["side", "host"]).select("side", "host", "dst", share).repartition(tasks))
        edges = edges.join(F.broadcast(hubs), ["side", "host"], "left_anti")
    edges = edges.join(out.select("side", F.col("src").alias("host"), "out"), ["side", "host"]).select("side", "host", "dst", share)
    edges = cut(edges.coalesce(tasks))
    teleport = start.select("side", "host", ((1 - damping) * F.col("rank")).alias("rank"))
    ranks = start
    for r in range(rounds):
        passed = ranks.hint("merge").join(edges, ["side", "host"])
        if spread is not None:
            passed = passed.unionByName(spread.join(F.broadcast(ranks.join(F.broadcast(hubs.drop("out")), ["side", "host"])), ["side", "host"]).select(passed.columns))
        moved = passed.select("side", F.col("dst").alias("host"), (F.col("rank") * F.col("share")).alias("rank"))
        after = cut(moved.coalesce(tasks).unionByName(teleport).groupBy("side", "host").agg(F.sum("rank").alias("rank")).coalesce(tasks))
        if r % 4 == 3:
            both = after.hint("merge").join(ranks.withColumnRenamed("rank", "old"), ["side", "host"], "full").coalesce(tasks)
            moved_by = F.sum(F.abs(F.coalesce("rank", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))
            if all(change <= tolerance * mass[side] for side, change in both.groupBy("side").agg(moved_by).collect()):
                return after
        ranks = after
    raise RuntimeError(f"ranks did not settle in {rounds} rounds")


def url_verdicts(pages: DataFrame, rules: list[Rule], threshold: float = 0.75, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every row of ``pages``.

    Where a rule fits, the longest gives the verdict. Else the host's standing does: trust is personalised PageRank from the
    hosts of allowed pages, distrust the same over reversed links from hosts of blocked pages (who links to the blocked
    is suspect). Both are taken as shares of what their seeds gave out, t and d, so that neither side prevails by its number of
    seeds; a host with d / (t + d) above ``threshold`` is blocked, which at 0.75 means that its part of all distrust is over
    three times its part of all trust. All others, and urls without a host, are allowed. A seed host's weight is its number of such pages. Null urls have an empty host and path. Repeated rows each
    keep their row. No rows: no rows. Columns of the same names in the input are ignored.
    """
    judged = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url_"), F.col(html_col).alias("html_"))
    judged = judged.select("page_id", host_of(F.col("url_")).alias("host"), path_of(F.col("url_")).alias("path"), "html_")
    judged = judged.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    judged = judged.withColumn("ruled", verdict_of(F.col("rule"), rules))
    links = cut(host_links(judged, "html_"))
    standing = judged.groupBy("host").agg(F.count("*").alias("pages"), *[F.count_if(F.col("ruled") == v).alias(v) for v in ("allow", "block")])
    standing = cut(standing)
    reverse = links.select(F.lit("distrust").alias("side"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    seeds = [standing.where((F.col(v) > 0) & (F.col("host") != "")).select(F.lit(side).alias("side"), "host", F.col(v).alias("weight")) for side, v in (("trust", "allow"), ("distrust", "block"))]
    ranks = propagate_sides(links.select(F.lit("trust").alias("side"), "src", "dst", "weight").unionByName(reverse), seeds[0].unionByName(seeds[1]))
    both = ranks.groupBy("host").agg(*[F.sum(F.when(F.col("side") == side, F.col("rank")).otherwise(0.0)).alias(side) for side in ("trust", "distrust")])
    known = standing.select("host", "pages").join(both, "host", "left").na.fill(0.0, ["trust", "distrust"])
    given = F.when(F.col("host") != "", F.col("allow")), F.when(F.col("host") != "", F.col("block"))
    total, *mass = standing.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in (F.col("pages"), *given)]).first()
    t, d = (F.col(side) / float(max(n, 1)) for side, n in zip(("trust", "distrust"), mass, strict=True))
    known = cut(known.withColumn("share", F.coalesce(F.try_divide(d, t + d), F.lit(0.0))))
    by_host = F.when(F.col("share") > threshold, "block").otherwise("allow")
    return attach_groups(judged.drop("html_"), known, "host", "pages", total).select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("ruled", by_host).alias("verdict"),
        "trust",
        "distrust",
    )
