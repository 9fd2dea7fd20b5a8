"""URL filters with redirect equivalence.

Addresses that lead to one another are one site in several guises: pages are linked to the address their canonical
link names, to the target of their redirect, and to their own address in plain form. Connected components over these
links carry decisions to aliases that no rule names. An explicit allow in a component goes before any block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodspark.llm.common import stored
from floodspark.llm.components import components

#: The rules of the production query as (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Host prefixes and query keys that name a guise of a page, not another page.
GUISES = ("www.", "m.", "blog.")
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def small(text: Column) -> Column:
    """A-Z as a-z, all else as it is."""
    return F.translate(text, CAPITALS, SMALL)


def host_of(url: Column) -> Column:
    return F.coalesce(small(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def plain_address(url: Column) -> Column:
    """Host and path without what only changes a page's guise: scheme, leading www., m. or blog., query, fragment,
    a closing slash or .html. Null without a host."""
    host, path = host_of(url), path_of(url)
    bare = F.regexp_replace(host, "^(" + "|".join(g.replace(".", "\\.") for g in GUISES) + ")", "")
    return F.when(host != "", F.concat(bare, F.regexp_replace(path, r"(\.html|/)$", "")))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule (by host and path together) that fits, as struct(rule, verdict); null where none does.

    A rule fits its host and all subdomains where the path starts with the rule's; of equally long ones the first in
    alphabetical order wins.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tags(kind: str) -> Column:
    return F.regexp_extract_all("html", F.lit(rf"(?i)<{kind}[\s/][^>]*>"), F.lit(0))


def attribute(tag: Column, name: str) -> Column:
    """The value of the first attribute of that name, without quotes and outer space; null without one."""
    all_of = F.regexp_extract_all(tag, F.lit(r"""[^\s"'>/=]+\s*=\s*(?:"[^">]*|'[^'>]*|[^\s"'>][^\s>]*)"""), F.lit(0))
    named = F.get(F.filter(all_of, lambda a: a.rlike(rf"(?i)^{name}\s*=")), F.lit(0))
    return F.regexp_replace(F.regexp_replace(named, r"""^[^=]*=\s*["']?\s*""", ""), r"\s+$", "")


def without_dots(url: Column) -> Column:
    """A url without the . and .. segments of its path."""
    path = path_of(url)
    parts = F.split(F.regexp_replace(path, r"(/\.\.?)$", "$1/"), "/")
    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"), lambda have, part: F.when(part == ".", have).when(
        part == "..", F.slice(have, 1, F.greatest(F.size(have) - 1, F.lit(0)))).otherwise(F.concat(have, F.array(part))))
    short = F.concat(F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), F.lit("/"), F.array_join(kept, "/"), F.regexp_extract(url, r"(?s)^[^?#]*(.*)", 1))
    return F.when(path.rlike(r"/\.\.?(/|$)"), short).otherwise(url)


def joined(target: Column, base: Column) -> Column:
    """The url that a link names on a page of url ``base``, dots as they are. Null for schemes without ://, and where the
    link is relative and the page has no host."""
    root, path = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1), path_of(base)
    return (F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
            .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (target == "") | (host_of(base) == ""), F.lit(None))
            .when(target.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), target))
            .when(target.startswith("/"), F.concat(root, target))
            .when(target.rlike("^[?#]"), F.concat(root, path, target))
            .otherwise(F.concat(root, F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, "[^/]*$", "")), target)))


def page_links(pages: DataFrame) -> DataFrame:
    """(address, target): from each page's plain address to the urls of all its canonical links and redirects.

    Relative links count from the page's base element, or else from its url.
    """
    canonical = F.transform(F.filter(tags("link"), lambda t: F.array_contains(F.split(small(attribute(t, "rel")), r"\s+"), "canonical")),
                            lambda t: attribute(t, "href"))
    after = lambda t: F.regexp_extract(attribute(t, "content"), r"""(?is)^\s*[\d.]*\s*(?:[;,]|\s)\s*(?:url\s*=\s*)?(?:"([^"]*)|'([^']*)|(.*))""", 0)
    named = lambda t: F.regexp_replace(F.regexp_replace(after(t), r"""(?i)^\s*[\d.]*\s*(?:[;,]|\s)\s*(?:url\s*=\s*)?["']?\s*""", ""), r"\s+$", "")
    loose = lambda t: F.regexp_extract(t, r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)""", 1)
    refresh = F.transform(F.filter(tags("meta"), lambda t: small(attribute(t, "http-equiv")) == "refresh"),
                          lambda t: F.coalesce(F.nullif(named(t), F.lit("")), loose(t)))
    href = F.get(F.filter(F.transform(tags("base"), lambda t: attribute(t, "href")), lambda h: h.isNotNull()), F.lit(0))
    held = pages.select("address", "url", href.alias("href"), F.concat(canonical, refresh).alias("targets"))
    based = held.select("address", F.coalesce(joined(F.col("href"), F.col("url")), "url").alias("base"), F.explode("targets").alias("target"))
    whole = based.select("address", joined(F.col("target"), F.col("base")).alias("whole")).filter("whole IS NOT NULL")
    return whole.select("address", without_dots(F.col("whole")).alias("target"))


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, component (least plain address it is equivalent to).

    A page with a fitting rule has the rule's verdict. Any other has its component's: allow where any page or link
    target of the component is allowed by a rule, else block where any is blocked by one, else allow. ``redirects``
    (source, target urls) adds links. A null url, or one without ://, has empty host and path, belongs to no component and is allowed.
    Null html has no links; repeated rows are judged alike; other columns are ignored.
    """
    html = F.col("html") if "html" in pages.columns else F.lit(None).cast("string")
    known = pages.select("page_id", F.col("url"), html.alias("html"), plain_address(F.col("url")).alias("address"))
    links = page_links(known)
    if redirects is not None:
        links = links.union(redirects.select(plain_address(F.col("source")), "target"))
    ruled = lambda url: rule_for(host_of(F.col(url)), path_of(F.col(url)), rules)
    links = stored(links.select("address", plain_address(F.col("target")).alias("other"), ruled("target").alias("ruled")), "links")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = stored(known.select("page_id", host.alias("host"), path.alias("path"), "address", ruled("url").alias("ruled")), "judged")
    found = components(links, "address", "other")
    placed = judged.join(found, judged["address"] == found["node"], "left").select(
        judged["*"], F.coalesce("component", "address").alias("component"))
    targets = links.select("other", "ruled").distinct().join(found, F.col("other") == found["node"], "left").select(
        F.coalesce("component", "other").alias("component"), "ruled")
    decided = (placed.select("component", "ruled").union(targets).filter("ruled IS NOT NULL AND component IS NOT NULL")
               .groupBy("component").agg(F.min("ruled.verdict").alias("decision")))
    return placed.join(decided, "component", "left").select(
        "page_id", "host", "path", F.col("ruled.rule").alias("rule"),
        F.coalesce(F.col("ruled.verdict"), F.col("decision"), F.lit("allow")).alias("verdict"), "component")
