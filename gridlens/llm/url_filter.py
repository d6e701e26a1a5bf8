"""URL filter with redirect equivalence, in DataFrame operations only.

A rule names a host and the start of a path; it fits the host and its subdomains, and the longest one that fits
decides.  Redirects (a table of pairs, or refresh tags in a page) and canonical links make addresses aliases of each
other; their connected components are found by distributed contraction.  An address without a rule is blocked if any
alias is blocked by a rule.  An explicit allow rule always wins for the address it fits, and does not unblock others.

Addresses are the same node if they differ in fragment or in the case of scheme and host only.

Defined results: a missing address, or one without ``://``, has empty host and path, fits no rule and has no aliases;
missing html has no links; repeated rows are each returned; links without a usable target are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.llm.components import connected_components
from gridlens.llm.tables import bind, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """Address without fragment, scheme and host in lower case; null without a host."""
    head = lambda u: F.regexp_extract(u, r"(?s)^(.*?://[^/?#]*)", 1)
    whole = lambda u, h: F.concat(F.translate(h, UPPER, LOWER), u.substr(F.length(h) + 1, F.length(u)))
    bare = F.regexp_extract(F.trim(url), r"(?s)^([^#]*)", 1)
    return bind(bare, lambda u: bind(head(u), lambda h: F.when(F.length(h) > 0, whole(u, h))))


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null; of equals an allow rule, then the last by name.

    Rules are part of the expression: a list of bounded length that every task holds.
    """
    if not rules:
        return F.lit(None).cast("struct<rule: string, verdict: string>")
    table = F.array(*[F.struct(F.lit(len(r.host) + len(r.path)).alias("size"), F.lit(r.verdict == "allow").alias("allow"),
                               F.lit(r.host + r.path).alias("rule"), F.lit(r.host).alias("host"), F.lit(r.path).alias("path"),
                               F.lit("." + r.host).alias("below"), F.lit(r.verdict).alias("verdict")) for r in rules])
    fits = F.filter(table, lambda r: ((host == r["host"]) | F.endswith(host, r["below"])) & F.startswith(path, r["path"]) & (host != ""))
    best = F.array_max(fits)
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def _resolved(base: Column, target: Column) -> Column:
    """Target of a link on a page: absolute, on the same scheme, the same host, or the same folder."""
    target = F.trim(F.replace(target, F.lit("&amp;"), F.lit("&")))
    scheme = F.regexp_extract(base, r"(?s)^(.*?:)//", 1)
    host = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(path_of(base), r"(?s)^(.*/)", 1)
    return (
        F.when((F.length(target) == 0) | F.startswith(target, F.lit("#")), None)
        .when(F.contains(target, F.lit("://")), target)
        .when(F.startswith(target, F.lit("//")), F.concat(scheme, target))
        .when(F.startswith(target, F.lit("/")), F.concat(host, target))
        .otherwise(F.concat(host, F.when(folder == "", "/").otherwise(folder), target))
    )


def _attribute(tag: Column, name: str) -> Column:
    value = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.regexp_replace(value, r"""^["']|["']$""", "")


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source, target) addresses of canonical links and refresh tags outside comments; a useless target is null."""
    page = pages.select(F.col(url).cast("string").alias("source"), F.col(html).cast("string").alias("page"))
    page = page.filter(F.col("source").isNotNull() & F.col("page").rlike(r"(?i)canonical|http-equiv"))
    page = page.withColumn("page", F.regexp_replace("page", r"(?s)<!--.*?-->", ""))
    tags = page.select("source", F.explode(F.regexp_extract_all("page", F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))).alias("tag"))
    canonical = F.lower(_attribute(F.col("tag"), "rel")).rlike(r"(^|\s)canonical(\s|$)")
    refresh = F.lower(_attribute(F.col("tag"), "http-equiv")) == "refresh"
    to = F.when(canonical, _attribute(F.col("tag"), "href")).when(
        refresh, F.regexp_replace(F.regexp_extract(_attribute(F.col("tag"), "content"), r"(?is)url\s*=\s*(.*)$", 1), r"""^["']|["']$""", ""))
    return tags.select("source", bind(to, lambda t: _resolved(F.col("source"), t)).alias("target"))


def judge_urls(pages: DataFrame, rules: Sequence[Rule], *, redirects: DataFrame | None = None, key: str = "page_id",
               url: str = "url", html: str | None = "html", default: str = "allow") -> DataFrame:
    """Per row: key, host, path, rule (or null), verdict and ``by_alias`` (blocked for an alias).

    ``redirects`` has columns ``source`` and ``target``; ``default`` is the verdict where nothing speaks.
    """
    rows = pages.select(F.col(key).alias("_key"), F.col(url).cast("string").alias("_url"))
    rows = rows.withColumn("host", host_of(F.col("_url"))).withColumn("path", path_of(F.col("_url")))
    rows = rows.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    links = [page_links(pages, url, html)] if html else []
    if redirects is not None:
        links.append(redirects.select(F.col("source").cast("string"), F.col("target").cast("string")))
    blocked = None
    if links:
        found = links[0] if len(links) == 1 else links[0].union(links[1])
        edges = stored(found.select(node_of(F.col("source")).alias("source"), node_of(F.col("target")).alias("target"))
                       .filter("source <> target").distinct())
        named = edges.select(F.explode(F.array("source", "target")).alias("url")).distinct()
        named = named.select(F.xxhash64("url").alias("node"), rule_for(host_of(F.col("url")), path_of(F.col("url")), rules)["verdict"].alias("own"))
        roots = connected_components(edges.select(F.xxhash64("source").alias("u"), F.xxhash64("target").alias("v")), "u", "v")
        bad = named.filter("own = 'block'").join(roots, "node").select("root").distinct()
        blocked = stored(roots.join(bad, "root").select(F.col("node").alias("_node"), F.lit(True).alias("_blocked")))
        rows = rows.withColumn("_node", F.xxhash64(node_of(F.col("_url")))).join(blocked, "_node", "left")
    else:
        rows = rows.withColumn("_blocked", F.lit(None).cast("boolean"))
    by_alias = F.col("_rule").isNull() & F.coalesce("_blocked", F.lit(False)) & (F.col("host") != "")
    return rows.select(
        F.col("_key").alias(key), "host", "path", F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", F.when(by_alias, "block").otherwise(default)).alias("verdict"), by_alias.alias("by_alias"))
