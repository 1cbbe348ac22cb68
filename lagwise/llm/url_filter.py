"""URL filter by redirect equivalence.

Rules name a host (and its subdomains) and a path prefix; a url's longest fitting rule decides.  Pages also point at
other urls that stand for them: canonical links, refreshes and, if given, a table of redirects.  Those edges join urls
into classes (distributed connected components), and a url without a rule of its own takes over its class's decision:
an explicitly allowed member allows the class, else an explicitly blocked one blocks it, else it is allowed.
"""

from __future__ import annotations

import html
import re
import string
from collections.abc import Sequence
from html import entities

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import ship_package
from .components import connected_components
from .store import stored

Rule = tuple[str, str, str]  #: host, path prefix, "allow" or "block"

#: What a page is cut into: comments and elements whose content is text, which hold no tags; and the tags that may name
#: another url of the page, or the base of its relative references.  Quoted values may hold ">".
_REST = r"""(?:(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+>)"""
TOKEN = re.compile(rf"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<raw>script|style|textarea|title|xmp|iframe|noembed|noframes)(?![\w-]){_REST}.*?(?:(?=</(?P=raw)(?![\w-]))|\Z)"""
                   rf"""|(?P<tag><(?:link|meta|base)(?![\w-]){_REST})""", re.I | re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
#: The url in a refresh's content, after the seconds; "url=" may be left out.
REFRESH_URL = re.compile(r"""\s*(?:[\d.]+\s*[;,\s]\s*|(?=[;,\s]*url\s*=)[;,\s]*)(?:url\s*=\s*)?(?:"([^"]*)|'([^']*)|(.+))""", re.I | re.S)
#: As HTML reads them in attributes: without ";" a name is one only if neither "=" nor a letter or digit follows.
REFERENCE = re.compile(r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;|[A-Za-z][A-Za-z0-9]*(?![A-Za-z0-9=;]))")
ABSOLUTE = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://")
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): what follows the first ``://`` up to ``/ ? #`` with A-Z lower-cased, and then up to ``? #``; both empty without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _key(url: Column) -> Column:
    """What identifies a resource: host, path and query, without scheme and fragment; null without a host."""
    host, _ = split_url(url)
    rest = F.regexp_extract(url, r"://[^/?#]*([^#]*)", 1)
    return F.when(host != "", F.concat(host, F.when(rest == "", F.lit("/")).otherwise(rest)))


def _rule(host: Column, path: Column, rules: Sequence[Rule], value: int | None) -> Column:
    """Of the longest fitting rule, its text (``value`` None) or its field; null if none fits."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule[0]) | host.endswith("." + rule[0])) & path.startswith(rule[1])
        out = F.when(fits, F.lit(rule[0] + rule[1] if value is None else rule[value])).otherwise(out)
    return out


def decode(text: str) -> str:
    """An attribute's value with its character references decoded."""
    return REFERENCE.sub(lambda m: html.unescape(m[0]) if m[1][0] == "#" else entities.html5.get(m[1], m[0]), text)


def resolve(base: str | None, link: str) -> str | None:
    """A reference as an absolute url without dot segments (RFC 3986); null if it has no host, or is relative and ``base`` is not absolute."""
    link = re.sub(r"[\t\r\n]", "", link.strip())
    if not ABSOLUTE.match(link):
        if SCHEME.match(link) or not (base and ABSOLUTE.match(base)):
            return None
        scheme, host, path, query = re.match(r"([^:]*:)//([^/?#]*)([^?#]*)(\?[^#]*)?", base).groups("")
        if link.startswith("//"):
            link = scheme + link
        elif link.startswith("/"):
            link = f"{scheme}//{host}{link}"
        elif link.startswith("?"):
            link = f"{scheme}//{host}{path}{link}"
        elif not link or link.startswith("#"):
            link = f"{scheme}//{host}{path}{query}{link}"
        else:
            link = f"{scheme}//{host}{path[:path.rfind('/') + 1] or '/'}{link}"
    start, path, rest = re.match(r"([^:]*://[^/?#]*)([^?#]*)(.*)", link, re.S).groups()
    if "/." not in path:
        return link
    kept, parts = [], path[1:].split("/")
    for part in parts:
        if part == "..":
            del kept[-1:]
        elif part != ".":
            kept.append(part)
    return f"{start}/{'/'.join(kept)}{'/' if parts[-1] in ('.', '..') and kept else ''}{rest}"


def link_tags(page: str) -> list[str]:
    """The link, meta and base tags of a page, in one pass; those in comments, scripts or text areas are none."""
    end = page.rfind(">") + 1  # no tag begins in what follows, so no search runs to the end in vain
    return [m["tag"] for m in TOKEN.finditer(page, 0, end) if m["tag"]]


def page_targets(url: str | None, tags: Sequence[str]) -> list[str]:
    """The urls that a page's canonical links and refreshes name, resolved against its first ``<base href>`` or else its own url."""
    base, links = None, []
    for tag in tags:
        name, found = re.match(r"<(\w+)", tag)[1].lower(), {}
        for m in ATTRIBUTE.finditer(tag, len(name) + 1):
            found.setdefault(m[1].lower(), decode(m[2] or m[3] or m[4] or ""))
        if name == "base" and base is None and "href" in found:
            base = resolve(url, found["href"])
        elif name == "link" and "canonical" in found.get("rel", "").lower().split():
            links.append(found.get("href", ""))
        elif name == "meta" and found.get("http-equiv", "").strip().lower() == "refresh" and (m := REFRESH_URL.match(found.get("content", ""))):
            links.append(m[1] or m[2] or m[3] or "")
    return [t for link in links if link.strip() and (t := resolve(base or url, link))]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _targets(url: pd.Series, page: pd.Series) -> pd.Series:
    return pd.Series([page_targets(u, link_tags(p)) for u, p in zip(url, page)], dtype=object)


@F.pandas_udf(T.StringType())
def _resolved(url: pd.Series, link: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else resolve(u, x) for u, x in zip(url, link)], dtype=object)


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, target): every canonical link and refresh found in the pages, as absolute urls."""
    ship_package(pages.sparkSession)
    page = F.col(f"`{html_col}`")
    some = pages.filter(page.rlike("(?i)canonical|refresh")).select(F.col(f"`{url_col}`").alias("url"), page.alias("page"))
    return some.select("url", F.explode(_targets("url", "page")).alias("target"))


def judge_urls(pages: DataFrame, rules: Sequence[Rule], redirects: DataFrame | None = None, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (the longest fitting one, else null) and ``verdict``.

    A null url, or one without ``://``, has an empty host and path, fits no rule, is in no class and is allowed.  Urls that
    differ only in scheme, fragment or host case are one.  ``redirects`` (url, target) adds edges; a relative target is
    resolved against its url.  Input columns with
    the name of a result column are replaced.  An empty table gives an empty result.
    """
    ship_package(pages.sparkSession)
    made = ("host", "path", "rule", "verdict")
    kept = [c for c in pages.columns if c not in made or c in (url_col, html_col)]
    url = F.col(f"`{url_col}`")
    edges = alias_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("url", _resolved("url", "target").alias("target")).filter("target is not null"))
    edges = stored(edges, "url-edges")
    classes = connected_components(edges.select(_key(F.col("url")).alias("a"), _key(F.col("target")).alias("b")))
    classes = classes.withColumnsRenamed({"node": "__node", "component": "__class"})
    ends = edges.select("url").union(edges.select(F.col("target").alias("url"))).distinct()
    ends = ends.select(_key(F.col("url")).alias("__node"), _rule(*split_url(F.col("url")), rules, 2).alias("__own")).filter("__own is not null")
    decided = (ends.join(classes, "__node").groupBy("__class")
               .agg(F.when(F.max(F.col("__own") == "allow"), F.lit("allow")).otherwise(F.lit("block")).alias("__taken")))
    taken = classes.join(decided, "__class").select("__node", "__taken")
    host, path = split_url(url)
    rows = pages.select(*[F.col(f"`{c}`") for c in kept], host.alias("__host"), path.alias("__path"), _key(url).alias("__node"))
    host, path = F.col("__host"), F.col("__path")
    rows = rows.withColumn("__rule", _rule(host, path, rules, None)).withColumn("__own", _rule(host, path, rules, 2)).join(taken, "__node", "left")
    return rows.select(*[F.col(f"`{c}`") for c in kept if c not in made], host.alias("host"), path.alias("path"), F.col("__rule").alias("rule"),
                       F.coalesce("__own", "__taken", F.lit("allow")).alias("verdict"))
