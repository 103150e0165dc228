"""URL filters: rules by host and path, and for the rest a verdict per host from trust and distrust that spread over links.

Trust is a personalised PageRank that starts at hosts with allowed URLs and follows links; distrust is one that starts at
hosts with blocked URLs and follows links backwards, since who links to a bad host answers for it. The mass that a host
receives is shared by all that a bad host is linked from, so verdicts go by its part of what the host would receive if
every host were a seed: a threshold per host. Only DataFrame functions are used.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_names, keyed_join, written

#: (verdict, host, path): a rule fits its host and all subdomains if the URL's path starts with the rule's path.
Rule = tuple[str, str, str]

LINK = r"""(?i)\bhref\s*=\s*["']?((?:https?:)?//[^\s"'<>]+)"""


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)).otherwise("")
    return F.translate(F.coalesce(rest, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty for null or without ://."""
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise(""), F.lit(""))


def first_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(verdict, rule) of the longest rule that fits, else null. The rules are part of the expression: a short list."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, at, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(start))
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(at + start).alias("rule"))).otherwise(out)
    return out


def host_edges(df: DataFrame, url: str, html: str) -> DataFrame:
    """(src, dst, share): links between different hosts, share = the link's part of all links that leave src."""
    links = df.select(host_of(F.col(url)).alias("src"), F.explode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(LINK), F.lit(1))).alias("_link"))
    links = links.select("src", host_of(F.concat(F.lit("x:"), F.regexp_replace("_link", "(?i)^https?:", ""))).alias("dst"))
    edges = links.where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    edges = written(edges)
    out = edges.groupBy(F.col("src").alias("_src")).agg(F.sum("n").alias("_all"))
    return keyed_join(edges, written(out), [("src", "_src")], F.xxhash64("dst"), "inner").select("src", "dst", (F.col("n") / F.col("_all")).alias("share"))


def spread_trust(hosts: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 30, tolerance: float = 1e-6) -> DataFrame:
    """(host, trust, distrust, trust_in, distrust_in) from hosts (host, trusted, blocked: shares of its URLs) and edges (src, dst, share).

    trust is the personalised PageRank from the trusted shares along links, distrust that from the blocked shares along
    reversed links, where a host's mass is dealt to those that link to it by the links' shares. A host without links
    onward gives its mass back to the seeds, so each sums to its seeds. trust_in and distrust_in are what a host receives
    over links, divided by what it would receive if every host were a seed of 1: between 0 and 1, however many hosts a mass is
    shared by; 0 if it receives nothing. Here a host passes on what it receives by the share of its URLs that no rule
    judges: a seed stands for itself.

    The PageRank is added up by the length of the walks from the seeds: a round carries each host's masses over one more
    link, and is written to the shared folder. It ends after ``rounds``, or once what is left is less than ``tolerance`` of
    the seeds' sum. Edges of a hub host are dealt to many tasks.
    """
    into = edges.groupBy("dst").agg(F.sum("share").alias("_in")).withColumnRenamed("dst", "_dst")
    backward = keyed_join(edges, written(into), [("dst", "_dst")], F.xxhash64("src"), "inner").select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("share") / F.col("_in")).alias("share"))
    both = written(edges.select(F.lit("trust").alias("kind"), "src", "dst", "share").unionByName(backward))
    free = written(hosts.select(F.col("host").alias("_of"), (1.0 - F.col("trusted") - F.col("blocked")).alias("open")))
    graph = written(keyed_join(both, free, [("src", "_of")], F.xxhash64("dst")).select("kind", "src", "dst", "share", F.coalesce("open", F.lit(1.0)).alias("open")))
    own = lambda kind, of: F.struct(F.lit(kind).alias("kind"), F.col(of).alias("mass"))
    seeds = hosts.select("host", F.explode(F.array(own("trust", "trusted"), own("distrust", "blocked"))).alias("_s")).select("_s.kind", "host", "_s.mass")
    linked = graph.select("kind", F.col("src").alias("host")).union(graph.select("kind", "dst")).distinct().withColumn("mass", F.lit(0.0))
    now = written(seeds.unionByName(linked).groupBy("kind", "host").agg(F.sum("mass").alias("mass"), F.sum("mass").alias("seen"), F.lit(1.0).alias("one")).withColumn("step", F.lit(0)))
    sums = lambda m: {r["kind"]: (r["mass"], r["one"]) for r in m.groupBy("kind").agg(F.sum("mass").alias("mass"), F.sum("one").alias("one")).collect()}  # noqa: E731  two rows
    start, walks = sums(now), [now]
    for step in range(1, rounds + 1):
        there = now.select(F.col("kind").alias("_kind"), F.col("host").alias("_host"), "mass", "seen", "one")
        moved = keyed_join(graph, there, [("kind", "_kind"), ("src", "_host")], F.xxhash64("dst"), "inner")
        part = lambda c, onward: F.sum(F.lit(damping) * F.col("share") * F.col(c) * onward).alias(c)
        onward = F.col("open") if step > 1 else F.lit(1.0)
        now = written(moved.groupBy("kind", F.col("dst").alias("host")).agg(part("mass", F.lit(1.0)), part("seen", onward), part("one", onward)).withColumn("step", F.lit(step)))
        walks.append(now)
        left = sums(now)
        if all(a <= tolerance * b for k, v in left.items() for a, b in zip(v, start[k], strict=True)):
            break
    every = walks[0]
    for w in walks[1:]:
        every = every.unionByName(w)
    far = F.col("step") > 0
    one = written(every.groupBy("kind", "host").agg(F.sum("mass").alias("all"), F.sum(F.when(far, F.col("seen")).otherwise(0.0)).alias("seen"), F.sum(F.when(far, F.col("one")).otherwise(0.0)).alias("one")))
    total = {r["kind"]: r["all"] for r in one.groupBy("kind").agg(F.sum("all").alias("all")).collect()}
    scale = lambda kind: float(start[kind][0] / total[kind]) if total.get(kind) else 0.0
    of = lambda kind, value, name: F.coalesce(F.max(F.when(F.col("kind") == kind, value)), F.lit(0.0)).alias(name)
    received = F.when(F.col("one") > 0, F.col("seen") / F.col("one"))
    return one.groupBy("host").agg(*[of(k, F.col("all") * scale(k), k) for k in ("trust", "distrust")], *[of(k, received, f"{k}_in") for k in ("trust", "distrust")])


def filter_urls(df: DataFrame, url: str, html: str, rules: Sequence[Rule], threshold: float = 0.5, damping: float = 0.85, rounds: int = 30) -> DataFrame:
    """Adds host, path, rule, verdict, trust and distrust.

    A URL under a rule has the longest rule's verdict. Any other is blocked if its host's bad side exceeds its good side by
    more than ``threshold``: the bad side is the blocked share of its URLs, or ``damping`` times the distrust that it receives
    where that is more (see spread_trust), the good side likewise by its allowed share and received trust. URLs without a
    host take part in no link and are allowed. Null HTML has no links. Columns named like the added ones are replaced;
    repeated rows each get the verdict; an empty table stays empty.
    """
    added = ("host", "path", "rule", "verdict", "trust", "distrust")
    rows = df.drop(*added)
    rule, key, over = free_names(rows, "_rule", "_host", "_over")
    u = F.col(url)
    rows = rows.withColumn("host", host_of(u)).withColumn("path", path_of(u)).withColumn(rule, first_rule(F.col("host"), F.col("path"), rules))
    share = lambda v: F.avg(F.coalesce((F.col(rule)["verdict"] == v).cast("double"), F.lit(0.0)))
    hosts = written(rows.where("host <> ''").groupBy("host").agg(share("allow").alias("trusted"), share("block").alias("blocked")))
    scores = spread_trust(hosts, written(host_edges(df, url, html)), damping, rounds)
    side = lambda own, received: F.greatest(F.col(own), damping * F.col(received))
    scores = hosts.join(scores, "host").select(F.col("host").alias(key), "trust", "distrust", (side("blocked", "distrust_in") - side("trusted", "trust_in")).alias(over))
    out = keyed_join(rows, written(scores), [("host", key)], F.xxhash64(u))  # one host can have a third of all URLs
    method = F.when(F.col(over) > threshold, "block").otherwise("allow")
    out = out.withColumn("rule", F.col(rule)["rule"]).withColumn("verdict", F.coalesce(F.col(rule)["verdict"], method))
    return out.select(*[c for c in rows.columns if c not in (rule, "host", "path")], *added)
