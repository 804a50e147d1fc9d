"""URL filters over redirect-equivalent addresses.

Addresses are brought to a key: without scheme, fragment, default port,
``www.``, tracking parameters and final slashes, the host in lower case.  A
page's canonical link and its refresh redirect join its key to their target's.
The connected components of these edges are aliases: one that a block rule
names blocks all of them.  An explicit allow rule wins for the address that it
names, and such an address blocks no other.

Rules are lists of hosts, each with all its subdomains, and of keys; they come
with the call and don't grow with the pages.

Defined results: a null, empty or blank url has the key "" and no edges, and
passes; null html has no edges; a page that points to itself is alone; repeated
rows give repeated results; relative links are resolved against the page; html of
any length is read whole; an empty table gives an empty result.  Only
``page_id``, ``url`` and ``html`` are read, whatever other columns there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _spark
from .components import components

BLOCKED = ("ads-track.example.com", "casino-win.example.com", "cheap-pills.example.com", "free-bets.example.com")
ALLOWED = ("m.ads-track.example.com",)

_TRACKING = "[?&](utm_[A-Za-z]+|ref|fbclid|gclid)=[^&]*"
_CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
_REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
_HREF = r"""(?is)\bhref\s*=\s*["']?\s*([^"'\s>]+)"""
_TARGET = r"""(?is)\burl\s*=\s*["']?\s*([^"'\s>;]+)"""


def key(url: Column) -> Column:
    """The key of an address."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "#.*$", ""), "^([A-Za-z][A-Za-z0-9+.-]*:)?//", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), r"^www\.|:(80|443)$", "")
    rest = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*(.*)$", 1), _TRACKING, "")
    return F.concat(host, F.regexp_replace(F.regexp_replace(rest, "^([^?&]*)&", "$1?"), "/+$", ""))


def resolve(link: Column, url: Column) -> Column:
    """link as an address, seen from url."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "[?#].*$", ""), "^([A-Za-z][A-Za-z0-9+.-]*:)?//", "")
    host = F.regexp_extract(bare, "^[^/]*", 0)
    folder = F.when(F.instr(bare, "/") > 0, F.regexp_replace(bare, "[^/]*$", "")).otherwise(F.concat(bare, F.lit("/")))
    return (
        F.when(link.rlike("^([A-Za-z][A-Za-z0-9+.-]*:)?//"), link)
        .when(link.startswith("/"), F.concat(host, link))
        .when(link.startswith("?") | link.startswith("#"), F.concat(bare, link))
        .otherwise(F.concat(folder, link))
    )


def matches(of: Column, rules: tuple[str, ...]) -> Column:
    """Whether a rule names the key: its host, a host above it, or the key itself.

    The host and all above it are looked up in a set, so that the number of
    rules doesn't matter.
    """
    hosts, keys = [r for r in rules if "/" not in r], [r for r in rules if "/" in r]
    parts = F.split(F.regexp_extract(of, "^[^/?]*", 0), r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    hit = F.exists(above, lambda h: h.isin(hosts)) if hosts else F.lit(False)
    return hit | of.isin(keys) if keys else hit


def edges(pages: DataFrame) -> DataFrame:
    """(a, b): keys of pages and of what their canonical links and redirects name."""
    tags = pages.where("url is not null and html is not null and trim(url) <> ''").select(
        "url", F.regexp_extract(F.regexp_extract("html", _CANONICAL, 0), _HREF, 1).alias("c"), F.regexp_extract(F.regexp_extract("html", _REFRESH, 0), _TARGET, 1).alias("r")
    )
    each = tags.select("url", F.explode(F.array("c", "r")).alias("link")).where("link <> ''")
    return each.select(key(F.col("url")).alias("a"), key(resolve(F.col("link"), F.col("url"))).alias("b")).where("a <> '' and b <> ''")


def decide(pages: DataFrame, blocked: tuple[str, ...] = BLOCKED, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """(page_id, url, alias_of, decision) of every page; alias_of is the smallest key of its component."""
    found = _spark.checkpoint(components(edges(pages)))
    culprits = found.where(matches(F.col("node"), blocked) & ~matches(F.col("node"), allowed)).select(F.col("root").alias("bad")).distinct()
    keyed = pages.select("page_id", "url", key(F.col("url")).alias("key")).join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("alias_of", F.coalesce("root", "key"))
    decision = F.when(matches(F.col("key"), allowed), "allow").when(matches(F.col("key"), blocked) | F.col("bad").isNotNull(), "block").otherwise("pass")
    return keyed.join(culprits, keyed["alias_of"] == culprits["bad"], "left").select("page_id", "url", "alias_of", decision.alias("decision"))
