"""URL filters with redirect equivalence, as DataFrame operations only.

Rules are (action, host, path): a rule fits its host and all subdomains, if the
url's path starts with the rule's path; the longest rule wins.  Urls without a
rule take the decision of their aliases: redirects (meta refresh) and canonical
links are edges between urls, connected components over them propagate block
decisions, and an explicit allow anywhere in the component takes precedence
over its blocks.  Default: allow.

Every closed tag counts, whatever its length.  Targets are resolved against the
page's url (a ``base`` tag is not read), ``&amp;`` in them is decoded; targets of
schemes without ``//`` are no urls.

Defined cases: a null url, or one without ``://``, has an empty host and path,
no rule and no aliases; null html has no links; repeated rows are judged alike;
extra columns are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postcast.llm.common import Scratch, ascii_lower, connected_components

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)"
# For the oracle SQL: one tag of at most about 2,000 characters; unclosed tags can't make matching quadratic.
CANONICAL = r"(?is)<link\b[^<>]{0,1000}?\brel\s{0,9}=\s{0,9}[\"']?canonical\b[^<>]{0,1000}>"
REFRESH = r"(?is)<meta\b[^<>]{0,1000}?\bhttp-equiv\s{0,9}=\s{0,9}[\"']?refresh\b[^<>]{0,1000}>"
HREF = r"(?is)\bhref\s{0,9}=\s{0,9}[\"']?([^\"'\s>]+)"
REFRESH_URL = r"(?is)\burl\s{0,9}=\s{0,9}[\"']?([^\"'\s>]+)"

# Of the text between < and >, whatever its length.
LINK_TAG = r"(?is)^link\b.*?\brel\s*+=\s*+[\"']?canonical\b"
META_TAG = r"(?is)^meta\b.*?\bhttp-equiv\s*+=\s*+[\"']?refresh\b"
TAG_HREF = r"(?is)\bhref\s*+=\s*+[\"']?([^\"'\s>]+)"
TAG_URL = r"(?is)\burl\s*+=\s*+[\"']?([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def url_key(url: Column) -> Column:
    """Host, path and query: urls that differ only in scheme or fragment are one
    node.  Null where there is no ``://``."""
    return F.when(url.contains("://"), F.concat(host_of(url), path_of(url), F.regexp_extract(url, PARTS, 3)))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, action) of the longest rule that fits, else null.  The rule
    list is a parameter of the job; it compiles into one expression."""
    fits = []
    for action, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits.append(F.when(((host == h) | host.endswith("." + h)) & path.startswith(p),
                           F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action"))))
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,action:string>")


def _without_dots(path: Column) -> Column:
    """An absolute path without its . and .. segments."""
    kept = F.aggregate(F.split(path, "/", -1), F.array().cast("array<string>"), lambda done, part:
                       F.when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1))))
                       .when(part == ".", done).otherwise(F.concat(done, F.array(part))))
    end = F.when(path.rlike(r"/\.\.?$"), "/").otherwise("")
    return F.when(path.contains("/."), F.concat(F.array_join(kept, "/"), end)).otherwise(path)


def resolved(target: Column, url: Column) -> Column:
    """The target as an absolute url; null where it is none."""
    path, rest = F.regexp_extract(target, r"^[^?#]*", 0), F.regexp_extract(target, r"(?s)[?#].*$", 0)
    folder = F.regexp_extract(path_of(url), r"(?s)^.*/", 0)
    full = F.when(path == "", path_of(url)).when(path.startswith("/"), _without_dots(path)) \
        .otherwise(_without_dots(F.concat(F.when(folder == "", "/").otherwise(folder), path)))
    query = F.when((path == "") & ~rest.startswith("?"), F.regexp_extract(url, PARTS, 3)).otherwise(rest)
    return F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target) \
        .when(target.startswith("//"), F.concat(F.lit("http:"), target)) \
        .when((target != "") & ~target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"),
              F.concat(F.lit("http://"), host_of(url), full, query))


def link_edges(pages: DataFrame) -> DataFrame:
    """(a, b): from a page's url to the targets of its canonical links and of its
    redirects."""
    pieces = F.split("html", "<", -1)
    tags = F.filter(F.slice(pieces, F.lit(2), F.size(pieces)),
                    lambda p: p.rlike(r"(?i)^(?:link|meta)\b") & p.contains(">"))
    targets = F.transform(F.transform(tags, lambda p: F.substring_index(p, ">", 1)), lambda t:
                          F.when(t.rlike(LINK_TAG), F.regexp_extract(t, TAG_HREF, 1))
                          .when(t.rlike(META_TAG), F.regexp_extract(t, TAG_URL, 1)))
    links = pages.where("html IS NOT NULL").where(F.col("url").contains("://")) \
        .select("url", F.explode(targets).alias("target")).where("target IS NOT NULL")
    to = resolved(F.replace(F.col("target"), F.lit("&amp;"), F.lit("&")), F.col("url"))
    return links.select(url_key(F.col("url")).alias("a"), url_key(to).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]],
               edges: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, and ``component`` (the smallest url
    key of the aliases, null without aliases), one row per row of ``pages``
    (page_id, url, html).  ``edges(a, b)``: further alias pairs of url keys,
    such as a crawler's redirect log."""
    scratch = Scratch(pages.sparkSession, "url_filters")
    links = scratch.save(link_edges(pages).select("a", "b"), "links")
    if edges is not None:
        links = links.unionByName(edges.select("a", "b"))
    comp = connected_components(links, scratch)
    # rules on every node, also on targets that are no page themselves
    node_url = F.concat(F.lit("//://"), F.col("node"))
    hit = rule_of(host_of(node_url), path_of(node_url), rules)
    decided = comp.withColumn("_action", hit["action"]).groupBy("component").agg(
        F.max((F.col("_action") == "allow").cast("int")).alias("_a"),
        F.max((F.col("_action") == "block").cast("int")).alias("_b"))
    alias = comp.join(decided, "component").select(
        F.col("node").alias("_key"), "component",
        F.when(F.coalesce("_a", F.lit(0)) == 1, "allow").when(F.coalesce("_b", F.lit(0)) == 1, "block")
        .otherwise("allow").alias("_alias"))
    d = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                     url_key(F.col("url")).alias("_key"))
    d = d.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    return d.join(alias, "_key", "left").select(
        "page_id", "host", "path", F.col("_rule")["rule"].alias("rule"),
        F.coalesce(F.col("_rule")["action"], "_alias", F.lit("allow")).alias("verdict"), "component")
