"""URL filters with redirect equivalence, in DataFrame operations only.

Rules judge a url by its host and path. Pages that redirect to each other, or name another url as canonical, are one
resource: their urls are linked, connected components are computed in Spark, and the decisions of the rules on any url
of a component, also on a target that is no page itself, reach its aliases. A url's own rule always holds. An alias
without a rule is blocked if a url of its component is blocked by a rule, unless another one is explicitly allowed.
Pages without rule and links are allowed.

Defined results: null, or a url without "://", has an empty host and path, no rule, no links, and is allowed; null html
has no links; every canonical link and refresh of a page counts, but not what stands in comments, scripts, styles and text
areas, nor tags without a target; very long urls and pages are read whole; an empty table gives no rows; pages that repeat
are judged alike; relative targets are resolved against the page's host (a target that
begins neither with "/" nor with a scheme, "?" or "#" against its folder); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .components import connected_components

#: (verdict, rule): a rule is a host, which stands for its subdomains too, and the beginning of a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: What is no markup: comments, and elements whose content is text.
_UNREAD = r"(?is)<!--.*?(?:-->|$)|<script\b.*?(?:</script\s*>|$)|<style\b.*?(?:</style\s*>|$)|<textarea\b.*?(?:</textarea\s*>|$)"
#: A link or meta tag; quoted values may hold ">", unless quotes are left open.
_TAGS = r"(?is)<(?:link|meta)(?=[\s/])(?:(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+>)"
_TARGET = r"(?is)\burl\s*=\s*['\"]?([^\"'>\s]+)"


def _value(tag: Column, name: str) -> Column:
    """The value of an attribute, quoted or not; empty if there is none."""
    pattern = rf"(?is)[\s\"'/]{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))"
    return F.concat(*(F.regexp_extract(tag, pattern, g) for g in (1, 2, 3)))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def _ruled(h: Column, p: Column, rules: Sequence[tuple[str, str]], value: int) -> Column:
    """The verdict (0) or text (1) of the longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule[1].partition("/")
        fits = ((h == name) | h.endswith("." + name)) & p.startswith(slash + rest)
        found = F.when(fits, F.lit(rule[value])).otherwise(found)
    return found


def _key(url: Column) -> Column:
    """What urls of one resource share: no scheme and no fragment."""
    rest = F.regexp_replace(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1), "^$", "/")
    return F.when(F.contains(url, F.lit("://")), F.concat(host(url), rest))


def links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(u, v): keys of a page and of every url that it redirects to or names as canonical, among other relations too."""
    tags = pages.select(
        F.col(url_col).alias("url"), F.explode(F.regexp_extract_all(F.regexp_replace(F.col(html_col), _UNREAD, " "), F.lit(_TAGS), F.lit(0))).alias("tag"),
    ).where(F.contains("url", F.lit("://")))
    tag = F.col("tag")
    canonical = tag.rlike(r"(?i)^<link") & _value(tag, "rel").rlike(r"(?i)(^|\s)canonical(\s|$)")
    refresh = tag.rlike(r"(?i)^<meta") & _value(tag, "http-equiv").rlike(r"(?i)^\s*refresh\s*$")
    target = F.when(canonical, F.trim(_value(tag, "href"))).when(refresh, F.regexp_extract(_value(tag, "content"), _TARGET, 1))
    targets = tags.select("url", target.alias("to")).where("to <> ''")
    to, base = F.replace("to", F.lit("&amp;"), F.lit("&")), F.regexp_extract("url", r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_extract("url", r"(?s)^.*?://[^/?#]*([^?#]*)", 1), "[^/]*$", "")
    whole = (
        F.when(to.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), to)
        .when(to.startswith("//"), F.concat(F.lit("http:"), to))
        .when(to.startswith("/"), F.concat(base, to))
        .when(to.startswith("#"), F.col("url"))
        .when(to.startswith("?"), F.concat(base, path(F.col("url")), to))
        .otherwise(F.concat(base, F.when(folder == "", F.lit("/")).otherwise(folder), to))
    )
    return targets.select(_key(F.col("url")).alias("u"), _key(whole).alias("v"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: (id, host, path, rule, verdict)."""
    component = connected_components(links(pages, url_col, html_col))
    # the key of a node is a host, then a path, so rules judge it like a url
    as_url = F.concat(F.lit("x://"), F.col("node"))
    nodes = component.unionAll(component.select(F.col("root").alias("node"), "root").distinct())
    found = nodes.withColumn("own", _ruled(host(as_url), path(as_url), rules, 0)).where("own is not null")
    decided = found.groupBy("root").agg(F.when(F.bool_or(F.col("own") == "allow"), "allow").otherwise("block").alias("shared"))
    shared = nodes.join(decided.withColumnRenamed("root", "_root"), F.expr("root = _root")).select("node", "shared")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    rows = rows.select("id", _key(F.col("url")).alias("key"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rows = rows.withColumns({"rule": _ruled(F.col("host"), F.col("path"), rules, 1), "own": _ruled(F.col("host"), F.col("path"), rules, 0)})
    return rows.join(shared, F.expr("key = node"), "left").select("id", "host", "path", "rule", F.coalesce("own", "shared", F.lit("allow")).alias("verdict"))


def verdicts(pages: DataFrame) -> DataFrame:
    return judge(pages).withColumnRenamed("id", "page_id")
