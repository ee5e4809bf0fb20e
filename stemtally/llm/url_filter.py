"""URL rules, and block decisions carried to aliases over redirects and canonical links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemtally.functions.lineage import cut_lineage
from stemtally.llm.common import ascii_lower, carried, small
from stemtally.llm.components import connected_components

Rule = tuple[str, str, str]  # verdict, host, path


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: then up to ``?``, ``#`` or the end. Else both empty."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return ascii_lower(F.coalesce(F.regexp_extract(url, parts, 1), F.lit(""))), F.coalesce(F.regexp_extract(url, parts, 2), F.lit(""))


def url_node(url: Column) -> Column:
    """The address without its fragment, scheme and host lower-cased; null without ``://``."""
    bare = F.split_part(url, F.lit("#"), F.lit(1))
    head = F.regexp_extract(bare, r"(?s)^(.*?://[^/?]*)", 1)
    return F.when(F.length(head) > 0, F.concat(ascii_lower(head), F.substring(bare, F.length(head) + 1, F.length(bare))))


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source, target) of every ``<link rel=canonical>`` and ``<meta http-equiv=refresh>`` outside comments and scripts.

    Relative targets are resolved against the page; ``../`` is not folded.
    """
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script\s*>", "")
    tags = F.regexp_extract_all(bare, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    tag = F.col("tag")
    canonical = F.when(tag.rlike(r"(?is)^<link\b.*\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b"), F.regexp_extract(tag, r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)", 1))
    refresh = F.when(tag.rlike(r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh\b"), F.regexp_extract(tag, r"(?is)\burl\s*=\s*[\"']?\s*([^\"'\s>;]+)", 1))
    hits = (
        pages.filter(F.col(html).rlike(r"(?i)canonical|http-equiv") & F.col(url).contains("://"))
        .select(F.col(url).alias("url"), F.explode(tags).alias("tag"))
        .select("url", F.replace(F.coalesce(canonical, refresh), F.lit("&amp;"), F.lit("&")).alias("to")).filter(F.length("to") > 0)
    )
    to, scheme = F.col("to"), F.split_part("url", F.lit("://"), F.lit(1))
    site = F.regexp_extract("url", r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract("url", r"(?s)^.*?://[^/?#]*((?:[^?#]*/)?)", 1)
    full = (
        F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to).when(to.startswith("//"), F.concat(scheme, F.lit(":"), to))
        .when(to.startswith("/"), F.concat(site, to)).otherwise(F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), to))
    )
    return hits.select(F.col("url").alias("source"), full.alias("target"))


def apply_rules(urls: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(host, path, rule, verdict) for each distinct host and path of ``urls`` that a rule fits; the longest rule wins, then allow.

    A rule fits its host and all its subdomains where the path starts with the
    rule's path. Hosts are matched by an equality join on their suffixes.
    """
    spark = urls.sparkSession
    known = spark.createDataFrame([(v, h, p) for v, h, p in rules], "verdict string, r_host string, r_path string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    return (
        urls.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("r_host"))
        .join(small(known), "r_host").filter(F.col("path").startswith(F.col("r_path")))
        .groupBy("host", "path")
        .agg(F.max(F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"), (F.col("verdict") == "allow").alias("a"), F.concat("r_host", "r_path").alias("rule"), "verdict")).alias("m"))
        .select("host", "path", "m.rule", "m.verdict")
    )


def judge(pages: DataFrame, rules: Sequence[Rule], redirects: DataFrame | None = None, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` without the html, with ``judged`` (host, path, rule, verdict, alias_of).

    Addresses that redirects (source, target) or canonical links connect are
    aliases of each other. A page's own longest rule decides; without one it
    is blocked if an alias is blocked by rule and none is allowed by rule,
    else allowed. Aliases need not be pages. Null urls and those without
    ``://`` have empty host and path, no rule and the verdict allow. alias_of
    is the smallest address of the class, null without links. A given column
    ``judged`` is replaced, no other name matters.
    """
    host, path = host_path(F.col(url))
    links = page_links(pages, url, html)
    if redirects is not None:
        links = links.unionByName(redirects.select("source", "target"))
    edges = links.select(url_node(F.col("source")).alias("u"), url_node(F.col("target")).alias("v"))
    classes = cut_lineage(connected_components(edges), "aliases")

    h, p = host_path(F.col("node"))
    named = classes.select("node", "component", h.alias("host"), p.alias("path"))
    rows = pages.select(carried(pages, html, "judged"), url_node(F.col(url)).alias("_node"), host.alias("_host"), path.alias("_path"))
    hits = cut_lineage(apply_rules(rows.select(F.col("_host").alias("host"), F.col("_path").alias("path")).union(named.select("host", "path")), rules), "rules")
    decided = (
        named.join(hits, ["host", "path"], "left").groupBy("component")
        .agg(F.bool_or(F.col("verdict") == "block").alias("blocked"), F.bool_or(F.col("verdict") == "allow").alias("allowed"))
    )
    spread = classes.join(decided, "component").select("node", F.col("component").alias("_alias"), (F.coalesce("blocked", F.lit(False)) & ~F.coalesce("allowed", F.lit(False))).alias("_spread"))
    own = hits.select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.col("rule").alias("_rule"), F.col("verdict").alias("_verdict"))
    out = (
        rows.join(own, (F.col("_host") == F.col("_h")) & (F.col("_path") == F.col("_p")), "left")
        .join(spread, F.col("_node") == F.col("node"), "left")
    )
    verdict = F.coalesce("_verdict", F.when(F.col("_spread"), F.lit("block")), F.lit("allow"))
    return out.select(
        "row.*",
        F.struct(F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), verdict.alias("verdict"), F.col("_alias").alias("alias_of")).alias("judged"),
    )
