"""URL rules, with block decisions carried over to addresses that redirect to each other.

Each rule names a host (with its subdomains) and a beginning of the path; the longest rule that fits a
page's address decides. Pages that no rule fits take part in an equivalence: canonical links and
refresh redirects in the HTML, and redirects given besides, are edges between addresses; in each
connected component a blocked address blocks the pages without a rule, unless an address of the
component is explicitly allowed. What is left is allowed.

An address is host, path and query: schemes and fragments are not told apart. A link is the href of a link tag whose rel
holds canonical, or the url in the content of a refresh meta tag; it is read as a browser reads it (character references,
. and .., links from the page's host or folder); places in the page and other schemes are none. DataFrame expressions only. Null URLs and URLs without "://" have an empty host and path, no rule and no edges: allowed. Null
or empty HTML has no links. Repeated rows stay; further columns of pages are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components

ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parts of a URL: all before "://", host, path, query.
HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
QUERY = r"(?s)^.*?://[^/?#]*[^?#]*([^#]*)"
#: Tags (a > between quotes ends none, a < outside them does), and the attributes of a tag one after another. Possessive
#: throughout: no long page makes the matcher go back or deep.
LINK_TAG, META_TAG = (rf"""(?is)<{name}\s(?:[^<>"']++|"[^"]*+"|'[^']*+')*+>""" for name in ("link", "meta"))
ATTRIBUTE = r"""(?is)[^\s=>"'/]++\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]++)"""
#: The address in a refresh tag's content.
REFRESH_URL = r"""(?is)\burl\s*=\s*["']?\s*([^"'\s]+)"""
#: Links with a scheme, and those of another kind than addresses.
ABSOLUTE, SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://", r"^[A-Za-z][A-Za-z0-9+.-]*:"
#: Character references that occur in addresses.
REFERENCES = (("(?i)&quot;|&#34;|&#x22;", '"'), ("&#39;|(?i)&#x27;|&apos;", "'"), ("(?i)&lt;|&#60;|&#x3c;", "<"), ("(?i)&gt;|&#62;|&#x3e;", ">"), ("&#47;|(?i)&#x2f;", "/"), ("(?i)&amp;|&#38;|&#x26;", "&"))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def address_of(url: Column) -> Column:
    """Host, path and query; null where there is no host."""
    host = host_of(url)
    return F.when(host != "", F.concat(host, path_of(url), F.regexp_extract(url, QUERY, 1)))


def without_dots(path: Column) -> Column:
    """The path without . and .. segments."""
    segments = F.split(path, "/")
    last = F.element_at(segments, -1)
    kept = F.aggregate(
        segments,
        F.lit(""),
        lambda so_far, own: F.when(own == "..", F.regexp_replace(so_far, "/[^/]*$", "")).when((own == ".") | (own == ""), F.when(own == "", F.concat(so_far, F.lit("/"))).otherwise(so_far)).otherwise(F.concat(so_far, F.lit("/"), own)),
    )
    return F.when(~path.rlike(r"(^|/)\.\.?(/|$)"), path).otherwise(F.concat(F.regexp_replace(kept, "^//", "/"), F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit(""))))


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's first attribute of that name, trimmed, with its character references read; null if there is none."""
    found = F.get(F.filter(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), 0), lambda a: a.rlike(rf"(?is)^{name}\s*=")), F.lit(0))
    value = F.regexp_replace(F.regexp_replace(found, r"(?s)^[^=]*=\s*", ""), r"""(?s)^(["'])(.*)\1$""", "$2")
    for pattern, letter in REFERENCES:
        value = F.regexp_replace(value, pattern, letter)
    return F.trim(value)


def links_in(html: Column) -> Column:
    """The addresses that a page's first canonical link and first refresh tag name, as written."""
    tags = lambda pattern: F.regexp_extract_all(html, F.lit(pattern), 0)
    canonical = F.filter(tags(LINK_TAG), lambda t: F.array_contains(F.split(F.lower(attribute(t, "rel")), r"\s+"), "canonical") & attribute(t, "href").isNotNull())
    refresh = F.filter(tags(META_TAG), lambda t: (F.lower(attribute(t, "http-equiv")) == "refresh") & attribute(t, "content").rlike(REFRESH_URL))
    return F.array(attribute(F.get(canonical, F.lit(0)), "href"), F.regexp_extract(attribute(F.get(refresh, F.lit(0)), "content"), REFRESH_URL, 1))


def resolved(link: Column, url: Column) -> Column:
    """The link as an absolute URL, as it stands in the page at url, without . and .. in its path; null if it is empty, names a
    place in its page or is no address."""
    host, path = host_of(url), path_of(url)
    folder = F.regexp_replace(path, r"[^/]*$", "")
    here = F.concat(F.lit("http://"), host)
    whole = (
        F.when((link == "") | link.startswith("#"), None)
        .when(link.rlike(ABSOLUTE), link)
        .when(link.rlike(SCHEME), None)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(host == "", None)
        .when(link.startswith("/"), F.concat(here, link))
        .when(link.startswith("?"), F.concat(here, path, link))
        .otherwise(F.concat(here, F.when(folder == "", "/").otherwise(folder), link))
    )
    return F.when(host_of(whole) != "", F.concat(F.lit("http://"), host_of(whole), without_dots(path_of(whole)), F.regexp_extract(whole, QUERY, 1)))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]], what: int | None = None) -> Column:
    """The longest rule that fits, as host and path (what=None) or its verdict (what=0); else null."""
    out = F.lit(None).cast("string")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[0] == ALLOW)):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        out = F.when(fits, verdict if what == 0 else rule_host + rule_path).otherwise(out)
    return out


def edges_of(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) between addresses: columns url and html of pages; url and target of redirects."""
    url = F.col("url")
    links = pages.where("html is not null").select("url", F.explode(links_in(F.col("html"))).alias("link")).where("link <> ''")
    targets = links.select("url", resolved(F.col("link"), url).alias("target"))
    if redirects is not None:
        targets = targets.unionByName(redirects.select("url", resolved(F.col("target"), url).alias("target")))
    return targets.select(address_of(url).alias("a"), address_of(F.col("target")).alias("b")).where("a is not null and b is not null and a <> b")


def judged(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The key, host, path, rule, verdict and address of every page. rules: (allow or block, host, beginning of the path)."""
    named = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    edges = written(edges_of(named, redirects).distinct(), "links")
    one = F.col("url")
    own = named.select("page_id", host_of(one).alias("host"), path_of(one).alias("path"), address_of(one).alias("address"))
    own = own.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("own_verdict", rule_of(F.col("host"), F.col("path"), rules, 0))
    found = components(edges)
    # Every address with an edge, whether it is a page or not.
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    absolute = F.concat(F.lit("x://"), F.col("node"))
    verdicts = nodes.withColumn("verdict", rule_of(host_of(absolute), path_of(absolute), rules, 0))
    decided = verdicts.groupBy("component").agg(F.max(F.col("verdict") == BLOCK).alias("blocked"), F.max(F.col("verdict") == ALLOW).alias("allowed"))
    carried = nodes.join(decided.where("blocked and not coalesce(allowed, false)"), "component").select(F.col("node").alias("address"), F.lit(BLOCK).alias("carried"))
    out = own.join(carried, "address", "left")
    return out.select(F.col("page_id").alias(key), "host", "path", "rule", F.coalesce("own_verdict", "carried", F.lit(ALLOW)).alias("verdict"), "address")
