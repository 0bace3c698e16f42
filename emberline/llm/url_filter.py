"""URL filters with redirect equivalence.

A rule allows or blocks a host, its subdomains and the paths below it; the longest fitting rule decides. Redirects and
canonical links make URLs aliases of one another: the connected components over these links are computed in a
distributed way, and a block that fits any alias of a page's component holds for the page, unless the page has a rule of
its own. An explicit allow takes precedence: a component with an explicitly allowed alias is not blocked by way of its
other aliases.

Defined cases: a null url or one without :// has empty host and path, fits no rule, has no aliases and is allowed;
repeated rows are judged alike; null or empty html has no links; an empty table gives an empty result; columns named
host, path, rule or verdict are replaced, all others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import lower_ascii
from ._components import components

#: (verdict, host, path) of the production rules.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

_AUTHORITY = r"(?s)^.*?://([^/?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, _AUTHORITY, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """What an alias is known by: the url without its fragment, its host in lower case; null without ://."""
    whole = F.regexp_extract(url, r"(?s)^(.*?://)[^/?#]*([^#]*)", 0)
    scheme = F.regexp_extract(url, r"(?s)^(.*?://)[^/?#]*([^#]*)", 1)
    rest = F.regexp_extract(url, r"(?s)^(.*?://)[^/?#]*([^#]*)", 2)
    return F.when(F.length(whole) > 0, F.concat(scheme, host_of(url), rest))


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct<len, name, verdict> of the longest rule that fits, else null. Looks up every suffix of the host once."""
    by_host: dict[str, list] = {}
    for verdict, h, p in rules:
        entry = F.struct(F.lit(len(h + p)).alias("len"), F.lit(h + p).alias("name"), F.lit(verdict).alias("verdict"), F.lit(p).alias("path"))
        by_host.setdefault(h, []).append(entry)
    table = F.create_map(*[x for h, entries in by_host.items() for x in (F.lit(h), F.array(*entries))])
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    found = F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(table, s)), lambda a: a.isNotNull()))
    return F.array_max(F.filter(found, lambda r: F.startswith(path, r["path"])))


def page_links(pages: DataFrame) -> DataFrame:
    """(src, dst): redirect (meta refresh) and canonical-link edges that the pages' html declares, as nodes."""
    html = F.col("html")
    link = F.regexp_extract(html, r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", 0)
    canonical = F.regexp_extract(link, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    meta = F.regexp_extract(html, r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", 0)
    refresh = F.regexp_extract(meta, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>;]+)", 1)
    rows = pages.where("html is not null and url is not null").select(
        "url", F.explode(F.array(canonical, refresh)).alias("to")
    )
    to = F.replace(F.col("to"), F.lit("&amp;"), F.lit("&"))
    scheme = F.regexp_extract("url", r"(?s)^(.*?:)//", 1)
    root = F.regexp_extract("url", r"(?s)^.*?://[^/?#]*", 0)
    folder = F.regexp_extract("url", r"(?s)^.*?://[^/?#]*(?:[^?#]*/)?", 0)
    whole = (
        F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(F.startswith(to, F.lit("//")), F.concat(scheme, to))
        .when(F.startswith(to, F.lit("/")), F.concat(root, to))
        .otherwise(F.concat(F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/"))), to))
    )
    return (
        rows.where("to <> ''")
        .select(node_of(F.col("url")).alias("src"), node_of(whole).alias("dst"))
        .where("src is not null and dst is not null and src <> dst")
    )


def judge_urls(pages: DataFrame, links: DataFrame, rules=RULES) -> DataFrame:
    """Adds host, path, rule and verdict to every row with a url. links: (src, dst) nodes as node_of gives them."""
    of_node = components(links)
    fit = longest_rule(host_of(F.col("node")), path_of(F.col("node")), rules)
    told = (
        of_node.withColumn("v", fit["verdict"])
        .groupBy("component")
        .agg(F.max(F.col("v") == "block").alias("blocked"), F.max(F.col("v") == "allow").alias("allowed"))
    )
    aliases = of_node.join(told, "component").select(
        F.col("node").alias("__node"), (F.col("blocked") & ~F.coalesce("allowed", F.lit(False))).alias("__blocked")
    )
    out = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    out = out.withColumn("__rule", longest_rule(F.col("host"), F.col("path"), rules)).withColumn("__at", node_of(F.col("url")))
    out = out.join(aliases, out["__at"] == aliases["__node"], "left")
    return out.withColumns(
        {
            "rule": F.col("__rule")["name"],
            "verdict": F.when(F.col("__rule").isNotNull(), F.col("__rule")["verdict"])
            .when(F.col("__blocked"), F.lit("block"))
            .otherwise(F.lit("allow")),
        }
    ).drop("__rule", "__at", "__node", "__blocked")
