"""Verdicts on urls: rules first, else what the links between hosts say of a host.

1. A rule (verdict, host, path) fits a host and its subdomains where the url's path starts with the rule's path; the longest
   fitting rule decides. Each host looks its rules up once, by its own name and every name above it.
2. Hosts with allowed pages are trusted seeds, hosts with blocked pages are blocked seeds, weighted by the number of such
   pages. Trust follows links (personalised PageRank from the trusted seeds); distrust goes against them, from a blocked host to
   those that link to it. Both are sums over the walks of up to `rounds` links, damped by `damping` a link. A host
   passes its trust on by the share of its pages that link to each other host, and its distrust back likewise.
3. A host whose share of distrust in trust and distrust together exceeds `threshold` is blocked, any other one is allowed.

Edges are counted per pair of hosts before anything is shuffled by host, so a host that holds a third of all pages or links
is one row per neighbour. A round joins what the last one sent with the edges and sums it by receiver;
each is written to the shared folder. Pages never move: the verdicts of hosts come to them, by broadcast if they are
few, else by a join salted over the paths of a host.

Defined results: a null url, or one without `://`, has an empty host and path, no rule, and is allowed. An empty host is no node.
Null html has no links. Links in comments, scripts and styles don't count; a host's links to itself neither. Two rules of one
length and the same host and path: block wins. A linked host without pages of its own counts as one page with the path `/`.
Repeated pages count as often as they stand. Without rules all is allowed. An empty table gives no rows. Other columns are
kept by `judge`; its own are under the names it returns, and a clashing input column is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.session import cut, saved

#: The rules of the contract: (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

DAMPING, ROUNDS, THRESHOLD = 0.85, 30, 0.5
#: Up to this many hosts (some 100 MB) their verdicts are sent to all tasks.
MOST_SENT = 500_000
_SALT = 32

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What is no markup: comments, scripts and styles, also where they are never closed.
_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script[\x09-\x0D\x20]*>|\z)|<style\b.*?(?:</style[\x09-\x0D\x20]*>|\z)"
#: The host a link goes to; links within a site have none.
_LINK = r"""(?i)<a[\x09-\x0D\x20](?:[^<>]*?[\x09-\x0D\x20])?href[\x09-\x0D\x20]*=[\x09-\x0D\x20]*["']?[\x09-\x0D\x20]*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'<>\x09-\x0D\x20]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def linked_hosts(html: Column) -> Column:
    """Distinct hosts that a page links to."""
    markup = F.regexp_replace(F.coalesce(html, F.lit("")), _HIDDEN, " ")
    return F.array_distinct(F.transform(F.regexp_extract_all(markup, F.lit(_LINK), 1), lambda h: F.translate(h, _UPPER, _LOWER)))


def rule_table(df: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame) -> DataFrame:
    if isinstance(rules, DataFrame):
        return rules.select("verdict", "host", "path")
    return df.sparkSession.createDataFrame(list(rules), "verdict string, host string, path string")


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): each host's rules, the longest first."""
    parts = F.split("host", "[.]")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    named = rules.select(F.col("host").alias("_above"), "path", "verdict", F.concat("host", "path").alias("rule")).distinct()
    found = hosts.select("host", F.explode(above).alias("_above")).join(named, "_above")
    each = F.struct((-F.length("rule")).alias("length"), (F.col("verdict") != "block").alias("allows"), "rule", "path", "verdict")
    return found.groupBy("host").agg(F.array_sort(F.collect_list(each)).alias("rules"))


def fitting(rules: Column, path: Column) -> Column:
    """The longest rule that fits, as a struct, or null."""
    return F.get(F.filter(rules, lambda r: F.startswith(path, r["path"])), F.lit(0))


def host_edges(pages: DataFrame) -> DataFrame:
    """(source, target, n): how many pages of one host link to another host. `pages` = (host, links)."""
    each = pages.where("host != ''").select(F.col("host").alias("source"), F.explode("links").alias("target"))
    return each.where("source != target").groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) of every host that a seed reaches.

    `seeds` = (host, trust, distrust), `edges` = (source, target, n). Trust flows from source to target, distrust back.
    """
    out = edges.groupBy("source").agg(F.sum("n").alias("sent"))
    into = edges.groupBy("target").agg(F.sum("n").alias("got"))
    shared = edges.join(out, "source").join(into, "target")
    flows = saved(
        shared.select(F.col("source").alias("host"), F.col("target").alias("to"), (damping * F.col("n") / F.col("sent")).alias("forth"), F.lit(0.0).alias("back"))
        .unionByName(shared.select(F.col("target").alias("host"), F.col("source").alias("to"), F.lit(0.0).alias("forth"), (damping * F.col("n") / F.col("got")).alias("back")))
        .groupBy("host", "to").agg(F.sum("forth").alias("forth"), F.sum("back").alias("back")))
    sent = cut(seeds.select("host", ((1 - damping) * F.col("trust")).alias("trust"), ((1 - damping) * F.col("distrust")).alias("distrust")))
    total = sent
    for _ in range(rounds):
        received = sent.join(flows, "host").select(F.col("to").alias("host"), (F.col("trust") * F.col("forth")).alias("trust"), (F.col("distrust") * F.col("back")).alias("distrust"))
        sent = cut(received.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")).where("trust > 0 or distrust > 0"))
        if sent.isEmpty():
            break
        total = total.unionByName(sent)
    return total.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame = RULES, threshold: float = THRESHOLD, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """`pages` (url, html) with host, path, rule, verdict, trust and distrust of the host."""
    named = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), linked_hosts(F.col("html")).alias("links"))
    slim = saved(named)
    edges = saved(host_edges(slim))
    own = slim.where("host != ''").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    linked = edges.select(F.col("target").alias("host")).distinct().join(own.select("host").distinct(), "host", "left_anti")
    counted = own.unionByName(linked.select("host", F.lit("/").alias("path"), F.lit(1).cast("bigint").alias("n")))
    hosts = counted.select("host").distinct()
    fits = saved(host_rules(hosts, rule_table(pages, rules)))
    ruled = counted.join(fits, "host").withColumn("_verdict", fitting(F.col("rules"), F.col("path"))["verdict"]).where("_verdict is not null")
    seeds = ruled.groupBy("host").agg(*[
        F.sum(F.when(F.col("_verdict") == v, F.col("n")).otherwise(0)).cast("double").alias(name) for v, name in (("allow", "trust"), ("block", "distrust"))])
    scores = propagate(seeds, edges, damping, rounds)
    share = F.round(F.try_divide("distrust", F.col("trust") + F.col("distrust")), 9)  # null where neither reaches a host
    verdicts = saved(
        hosts.join(fits, "host", "left").join(scores, "host", "left").fillna(0.0, ["trust", "distrust"])
        .select("host", "rules", "trust", "distrust", F.when(share > threshold, "block").otherwise("allow").alias("_method")))
    rest = pages.select(*[f"`{c}`" for c in pages.columns if c not in ("host", "path", "rule", "verdict", "trust", "distrust", "_salt")])
    rows = rest.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    if verdicts.limit(MOST_SENT + 1).count() <= MOST_SENT:
        met = rows.join(F.broadcast(verdicts), "host", "left")
    else:
        salted = verdicts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALT - 1))))
        met = rows.withColumn("_salt", F.pmod(F.xxhash64("path"), F.lit(_SALT)).cast("int")).join(salted, ["host", "_salt"], "left").drop("_salt")
    rule = fitting(F.col("rules"), F.col("path"))
    return met.select(
        *[f"`{c}`" for c in rest.columns], "host", "path", rule["rule"].alias("rule"),
        F.coalesce(rule["verdict"], F.col("_method"), F.lit("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
