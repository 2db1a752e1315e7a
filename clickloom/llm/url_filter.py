"""URL filter with redirect equivalence, in DataFrame operations only.

Rules judge a URL by host (with all subdomains) and path; the longest rule wins. Pages that a
redirect (meta refresh, or a table of redirects) or a canonical link makes equivalent form components; a page without a
rule of its own is allowed if its component holds an allowed address, else blocked if it holds a blocked
one, else allowed. So block decisions reach aliases, and explicit allow rules have precedence.

Only addresses with such an edge enter the components; what is joined back is one row for each of them.

Defined cases: a null url, or one without "://", has an empty host and path, no rule and no alias, and is allowed. Null html
has no links. Repeated rows each keep a row. Of rules of equal length the first in the list wins. Other
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import written
from .components import connected_components

#: (verdict, host, path): the rules, fixed values.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def rest_of(url: Column) -> Column:
    """What follows the first "://"; null and other urls: empty."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))


def host_of(rest: Column) -> Column:
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, value) -> Column:
    """value(verdict, host, path) of the longest rule that fits, else null."""
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ordered]
    return F.coalesce(*[F.when(f, F.lit(value(*r))) for f, r in zip(fits, ordered)])


def without_dots(path: Column) -> Column:
    """A path with its "." and ".." parts resolved."""
    none = F.array().cast("array<string>")
    step = lambda kept, part: F.when(part == ".", kept).when(part == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1)))).otherwise(F.concat(kept, F.array(part)))
    folder = F.when(path.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    return F.when(path.contains("/."), F.concat(F.array_join(F.aggregate(F.split(path, "/"), none, step), "/"), folder)).otherwise(path)


def address(rest: Column) -> Column:
    """The node of an address: host, path and query, without scheme and fragment; dots in the path resolved."""
    path = without_dots(path_of(rest))
    query = F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)", 1)
    return F.concat(host_of(rest), F.when(path == "", F.lit("/")).otherwise(path), query)


def page_edges(pages: DataFrame) -> DataFrame:
    """(a, b): addresses of pages and of their canonical links and meta refreshes, if not in comments or scripts."""
    url, page = F.col("url"), F.col("html")
    attribute = lambda tag, name: F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", 0)
    value = lambda text: F.regexp_replace(F.regexp_replace(text, r"(?is)^[^=]*=\s*[\"']?", ""), r"[\"']$", "")
    canonical = F.regexp_extract(page, r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*>", 0)
    refresh = F.regexp_extract(page, r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*>", 0)
    later = F.regexp_extract(value(attribute(refresh, "content")), r"(?is)\burl\s*=\s*[\"']?([^\"']+)", 1)
    links = pages.filter(url.isNotNull() & page.isNotNull() & page.rlike(r"(?i)canonical|http-equiv"))
    links = links.select(url, F.regexp_replace(page, r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?</\1\s*>", " ").alias("html"))
    links = links.select("url", F.explode(F.array(value(attribute(canonical, "href")), later)).alias("to"))
    links = links.select("url", F.regexp_replace(F.trim("to"), "&amp;", "&").alias("to")).filter("to != '' and instr(url, '://') > 0")
    links = written(links, "canonical")

    def resolved(rest: Column) -> Column:
        to, host, folder = F.col("to"), host_of(rest), F.regexp_extract(path_of(rest), r"^(.*/)", 1)
        return (
            F.when(to.contains("://"), rest_of(to))
            .when(to.startswith("//"), F.substring(to, F.lit(3), F.length(to)))
            .when(to.startswith("/"), F.concat(host, to))
            .when(to.startswith("?"), F.concat(host, path_of(rest), to))
            .otherwise(F.concat(host, F.when(folder == "", F.lit("/")).otherwise(folder), to))
        )

    rest = rest_of(F.col("url"))
    return links.select(let(rest, address).alias("a"), let(let(rest, resolved), address).alias("b"))


def judge(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict); redirects: an optional table (source, target) of urls."""
    pages = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    edges = page_edges(pages)
    if redirects is not None:
        known = redirects.filter("instr(source, '://') > 0 and instr(target, '://') > 0")
        edges = edges.unionByName(known.select(let(rest_of(F.col("source")), address).alias("a"), let(rest_of(F.col("target")), address).alias("b")))
    nodes = connected_components(edges)
    host, path = F.regexp_extract("node", r"^([^/?#]*)", 1), F.regexp_extract("node", r"^[^/?#]*([^?#]*)", 1)
    judged = nodes.withColumn("own", longest_rule(host, path, lambda v, h, p: v))
    parts = judged.groupBy("component").agg(F.max(F.col("own") == "allow").alias("allowed"), F.max(F.col("own") == "block").alias("blocked")).filter("blocked and not coalesce(allowed, false)")
    aliases = written(nodes.join(parts.select("component"), "component", "left_semi").select(F.col("node").alias("address"), F.lit("block").alias("inherited")), "aliases")
    rest = rest_of(F.col("url"))
    rows = pages.select("page_id", host_of(rest).alias("host"), path_of(rest).alias("path"), F.when(F.instr("url", "://") > 0, let(rest, address)).alias("address"))
    rows = rows.withColumn("rule", longest_rule(F.col("host"), F.col("path"), lambda v, h, p: h + p)).withColumn("own", longest_rule(F.col("host"), F.col("path"), lambda v, h, p: v))
    return rows.join(aliases, "address", "left").select("page_id", "host", "path", "rule", F.coalesce("own", "inherited", F.lit("allow")).alias("verdict"))
