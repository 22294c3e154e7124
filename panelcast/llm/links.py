"""URL filters: rules by host and path, and trust propagated over the graph of hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import ascii_lower, discard, stored

#: Share of the score that follows links, and the change of the sum that ends the rounds. At this
#: damping they take some 85; that many more than the bound mean an error, not an end.
DAMPING, TOLERANCE, ROUNDS = 0.85, 1e-6, 1000
#: Distrust as a share of trust and distrust from which a host is blocked.
THRESHOLD = 0.5


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return ascii_lower(F.coalesce(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rules(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does. A rule like
    ``example.com/en/`` fits its host and all subdomains if the path starts with the rule's path."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule = F.when(fits, text).otherwise(rule)
        verdict = F.when(fits, says).otherwise(verdict)
    return rule, verdict


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, weight): links of pages to other hosts, counted per pair of hosts. Relative
    links stay on the host and count for nothing."""
    target = r"""(?i)(?:href|src)\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""
    links = pages.select(
        host_of(F.col(url_col)).alias("src"),
        F.explode(F.regexp_extract_all(F.col(html_col), F.lit(target), 1)).alias("_url"),
    )
    absolute = F.when(F.col("_url").startswith("//"), F.concat(F.lit("x:"), "_url")).otherwise(F.col("_url"))
    links = links.select("src", host_of(absolute).alias("dst"))
    links = links.where("src <> dst and src <> '' and dst <> ''")
    return links.groupBy("src", "dst").agg(F.count("*").alias("weight"))


def propagate(
    links: DataFrame,
    seeds: DataFrame,
    damping: float = DAMPING,
    rounds: int = ROUNDS,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """Personalised PageRank: (host, score) for (host, seed) and weighted links (src, dst, weight).

    Links are one row per pair of hosts, weighted by their share of the source's links, so a hub's
    contributions are summed before they are shuffled. What reaches a host without links goes back
    to the seeds, in their shares: that only scales all scores, so they are summed to 1 at the end.
    Rounds go on until the scores change by less than ``tolerance`` in sum; ``rounds`` of them
    without reaching it are an error. Every round is stored, which keeps plans short and survives
    lost executors, and the one before it deleted."""
    total = seeds.agg(F.sum("seed")).first()[0] or 0
    if not total:
        return seeds.select("host", F.lit(0.0).alias("score"))
    base = stored(
        seeds.where("seed > 0").select("host", (F.col("seed") / F.lit(float(total))).alias("seed")), "seeds"
    )
    out = links.groupBy("src").agg(F.sum("weight").alias("_all"))
    shares = stored(
        links.join(out, "src").select("src", "dst", (F.col("weight") / F.col("_all")).alias("share")),
        "shares",
    )
    score = base.select("host", F.col("seed").alias("score"))
    if shares.isEmpty():
        return score
    before = None
    for _ in range(rounds):
        moved = shares.join(score, shares["src"] == score["host"]).select(
            F.col("dst").alias("host"), (F.col("share") * F.col("score") * damping).alias("score")
        )
        own = base.select("host", (F.col("seed") * (1 - damping)).alias("score"))
        after = stored(moved.unionByName(own).groupBy("host").agg(F.sum("score").alias("score")), "rank")
        change = after.withColumnRenamed("score", "_new").join(score, "host", "full").agg(
            F.sum(F.abs(F.coalesce("_new", F.lit(0.0)) - F.coalesce("score", F.lit(0.0)))), F.sum("_new")
        )
        moved_by, mass = change.first()
        if before is not None:
            discard(before)
        score = before = after
        if moved_by < tolerance:
            return score.select("host", (F.col("score") / F.lit(mass)).alias("score"))
    raise RuntimeError(f"scores still change by {moved_by} after {rounds} rounds")


def judge_hosts(ruled: DataFrame, links: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(host, trust, distrust, verdict) for pages (host, verdict) that rules have judged or not.

    Hosts are seeds of trust by the share of their pages that rules allow, and trust flows along
    links. They are seeds of distrust by the share that rules block, and distrust flows against the
    links, to those who link to them. A host is blocked when distrust exceeds ``threshold`` of
    both together; hosts that neither reaches are allowed."""
    hosts = ruled.where("host <> ''").groupBy("host").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("verdict") == "allow").alias("good"),
        F.count_if(F.col("verdict") == "block").alias("bad"),
    )
    hosts = stored(hosts, "hosts")
    seed = lambda c: F.col(c) / F.col("n")
    links = stored(links, "host-links")
    trust = propagate(links, hosts.select("host", seed("good").alias("seed")))
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    distrust = propagate(back, hosts.select("host", seed("bad").alias("seed")))
    scored = (
        hosts.select("host")
        .join(trust.withColumnRenamed("score", "trust"), "host", "left")
        .join(distrust.withColumnRenamed("score", "distrust"), "host", "left")
        .fillna(0.0, ["trust", "distrust"])
    )
    blocked = F.col("distrust") > threshold * (F.col("trust") + F.col("distrust"))
    return scored.withColumn("verdict", F.when(blocked, "block").otherwise("allow"))


def judge_pages(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict.

    A page gets the verdict of its longest rule, or else of its host in the link graph. Null urls
    and urls without ``://`` have an empty host and path; no rule fits them and they are allowed.
    Null html has no links; repeated rows are repeated; an empty table gives an empty result."""
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    ruled = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    ruled = stored(ruled.withColumns({"rule": rule, "verdict": verdict}), "ruled")
    judged = stored(judge_hosts(ruled, host_links(pages, url_col, html_col)), "judged")
    named = judged.select("host", F.col("verdict").alias("_own"))
    done = ruled.where("verdict is not null")
    rest = ruled.where("verdict is null").join(named, "host", "left")
    rest = rest.withColumn("verdict", F.coalesce("_own", F.lit("allow"))).drop("_own")
    return done.unionByName(rest).select(id_col, "host", "path", "rule", "verdict")
