"""URL expressions by regular expressions, so that bad input gives empty strings and never an error."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*)://"
AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
QUERY = r"^[A-Za-z][A-Za-z0-9+.-]*://[^?#]*\?([^#]*)"

# Fixed values.
TRACKING = r"^(utm_[^=]*|fbclid|gclid|msclkid|mc_cid|mc_eid)(=|$)"
PRIVATE_HOST = r"^(localhost|.*\.local|10\.\d+\.\d+\.\d+|127\.\d+\.\d+\.\d+|169\.254\.\d+\.\d+|172\.(1[6-9]|2[0-9]|3[01])\.\d+\.\d+|192\.168\.\d+\.\d+|\[(::1|f[cd][^\]]*|fe[89ab][^\]]*)\])$"
SEARCH_HOSTS = ["duckduckgo.com", "google.com", "bing.com", "search.yahoo.com", "yahoo.com"]
SKIPPED_HOST_PARTS = [
    "facebook.", "instagram.", "tiktok.", "youtube.", "youtu.be", "linkedin.", "pinterest.", "reddit.", "twitter.", "x.com", "amazon.", "ebay.", "walmart.", "target.",
    "jd.com", "taobao.", "tmall.", "1688.", "pinduoduo.", "yangkeduo.", "alibaba.", "aliexpress.", "sohu.", "sina.", "163.com", "qq.com", "weibo.", "zhihu.", "baidu.",
    "bilibili.", "douyin.", "toutiao.", "ifeng.",
]
FILE_ENDING = r"(?i)\.(avif|bmp|css|gif|ico|jpeg|jpg|js|mp3|mp4|pdf|png|svg|webp|zip)(?:$|\?)"
MAPPED_PATH = r"(?i)/(?:account|cart|checkout|login|register|privacy|terms|legal|policies|search|language|locale)(?:/|[._-]|$)"
KINDS = ["homepage", "robots", "sitemap", "product", "collection", "blog", "rss"]
ROOT_PATH = r"(?i)^/?(cn|zh|zh-cn|en|en-us|en-gb|ja|jp|de|fr|h5)?/*$"
SHELL_PATH = r"(?i)^/(news|blog|blogs|article|articles|search|media|press)/*$"
KIND_PATHS = [
    ("robots", r"/robots\.txt$"),
    ("sitemap", r"(?i)(sitemap.*\.xml|\.xml.*sitemap)"),
    ("rss", r"(?i)(/(rss|atom|feeds?)([./]|$)|\.(rss|atom)$)"),
    ("product", r"(?i)/(products?|items?|goods)(/|\.json|[._-]|$)"),
    ("collection", r"(?i)(/(collections?|categor(y|ies)|catalog|shops?)(/|[._-]|$)|/product-(categor(y|ies)|lists?)(/|[._-]|$))"),
    ("blog", r"(?i)/(blogs?|articles?|news|guides?|faqs?|reviews?|testimonials?|resources?|learn)(/|[._-]|$)"),
]


def part(c: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract(c, pattern, 1), F.lit(""))


def full_host(c: Column) -> Column:
    """Lower case, without user and port; empty for what is no URL."""
    return F.regexp_replace(F.regexp_replace(F.lower(part(F.trim(c), AUTHORITY)), r"^.*@", ""), r":\d+$", "")


def hostname(c: Column) -> Column:
    """Lower case, without user, port and a leading www.; empty for what is no URL."""
    return F.regexp_replace(full_host(c), r"^www\.", "")


def path(c: Column) -> Column:
    p = part(F.trim(c), PATH)
    return F.when(p == "", "/").otherwise(p)


def is_public(c: Column) -> Column:
    """http or https, no user in it, and no local or private host."""
    host = hostname(c)
    return F.coalesce(F.lower(part(F.trim(c), SCHEME)).isin("http", "https") & ~part(F.trim(c), AUTHORITY).contains("@") & (host != "") & ~host.rlike(PRIVATE_HOST), F.lit(False))


def canonical(c: Column, *, keep_www: bool = False) -> Column:
    """The comparable form of an http(s) URL, or null: no fragment, user or default port, no tracking parameters, the others
    sorted, no doubled or trailing slashes, and no leading www. (unless kept)."""
    c = F.trim(c)
    scheme = F.lower(part(c, SCHEME))
    host = F.regexp_replace(F.regexp_replace(F.lower(part(c, AUTHORITY)), r"^.*@", ""), r":(80|443)$", "")
    host = host if keep_www else F.regexp_replace(host, r"^www\.", "")
    p = F.regexp_replace(F.regexp_replace(path(c), r"/{2,}", "/"), r"/+$", "")
    kept = F.array_sort(F.filter(F.split(part(c, QUERY), "&"), lambda x: (x != "") & ~F.lower(x).rlike(TRACKING)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(scheme.isin("http", "https") & (host != ""), F.concat(scheme, F.lit("://"), host, F.when(p == "", "/").otherwise(p), query))


def absolute(link: Column, base: Column) -> Column:
    """A link as an absolute URL; null for other schemes and fragments."""
    link = F.trim(link)
    scheme = F.lower(part(base, SCHEME))
    origin = F.concat(scheme, F.lit("://"), part(base, AUTHORITY))
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    return (
        F.when(link.rlike(r"(?i)^https?://"), link)
        .when(link.rlike(r"^//"), F.concat(scheme, F.lit(":"), link))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (link == "") | link.startswith("#"), None)
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("?"), F.concat(origin, path(base), link))
        .otherwise(F.concat(origin, folder, link))
    )


def kind(c: Column) -> Column:
    """robots, sitemap, rss, product, collection, blog or homepage, from the path."""
    p = F.lower(path(c))
    out = F.lit("homepage")
    for name, pattern in reversed(KIND_PATHS):
        out = F.when(p.rlike(pattern), name).otherwise(out)
    return out


def useful(c: Column) -> Column:
    """Public, no search engine, social or market host, no binary file."""
    host = hostname(c)
    return is_public(c) & ~host.isin(*SEARCH_HOSTS) & ~host.rlike("|".join(map(re.escape, SKIPPED_HOST_PARTS))) & ~F.coalesce(c, F.lit("")).rlike(FILE_ENDING)


def useful_mapped(c: Column, origin: Column) -> Column:
    """Of a site's own map: useful, on the host of ``origin``, and no account, cart, login or policy page."""
    return useful(c) & (hostname(c) == hostname(origin)) & ~path(c).rlike(MAPPED_PATH)
