"""URL, link and feed tables."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import urls as U
from claimloom.operators.containment import containing
from claimloom.sources.scratch import cut, hinted

# Fixed values.
BASE_SCORES = {"product": 100, "collection": 90, "blog": 80, "rss": 35, "homepage": 20, "sitemap": 5, "robots": 0}
KIND_CAPS = {"homepage": 6, "robots": 4, "sitemap": 4, "product": 8, "collection": 8, "blog": 6, "rss": 4}
EVIDENCE_KINDS = ["product", "collection", "blog", "rss"]
DEEP_ITEM = r"(?i)/(products?|collections?|faqs?|guides?)/[^/]+"
KIND_TABLES = {
    "robots": ["source_database", "website_structure_database"],
    "rss": ["source_database", "content_database", "weekly_intelligence_reports"],
    "sitemap": ["source_database", "website_structure_database", "product_database", "content_database"],
    "product": ["product_database", "keyword_database", "opportunity_database"],
    "collection": ["website_structure_database", "product_database", "keyword_database"],
    "blog": ["content_database", "keyword_database", "pain_point_database"],
    "homepage": ["competitor_database", "website_structure_database", "content_database"],
}
ANCHOR = r"""(?is)<a\b[^>]*\bhref=["']([^"']+)["']"""
ALTERNATE = r"""(?is)<link\b[^>]*\brel=["'][^"']*alternate[^"']*["'][^>]*\bhref=["']([^"']+)["']"""
LOC = r"(?is)<loc[^>]*>\s*(.*?)\s*</loc>"
SITEMAP_LINE = r"(?im)^\s*sitemap:[ \t]*(\S+)"
DISALLOW_LINE = r"(?im)^[ \t]*disallow:[ \t]*([^\r\n]*)"
ITEM = r"(?is)<item.*?</item>"


def dedupe_urls(df: DataFrame, *, url_col: str = "url", order_col: str = "ord", keys: list[str] | None = None) -> DataFrame:
    """The first row of each canonical URL (within ``keys``); rows that are no URL are dropped."""
    keyed = df.withColumn("canonical", U.canonical(F.col(url_col))).where("canonical is not null")
    return keyed.withColumn("_k", F.row_number().over(Window.partitionBy(*(keys or []), "canonical").orderBy(order_col))).where("_k = 1").drop("_k")


def extract_links(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, link): distinct absolute, useful links of anchors and alternates, canonical."""
    found = F.concat(F.regexp_extract_all(html_col, F.lit(ANCHOR), F.lit(1)), F.regexp_extract_all(html_col, F.lit(ALTERNATE), F.lit(1)))
    # made within the array, so that the filter reads a column and doesn't repeat the making of it
    links = F.array_distinct(F.array_compact(F.transform(found, lambda x: U.canonical(U.absolute(x, F.col(url_col))))))
    return pages.select(id_col, F.explode(links).alias("link")).where(U.useful(F.col("link"))).distinct()


def sitemap_urls(df: DataFrame, *, key: str, body_col: str = "body", most: int = 80) -> DataFrame:
    """(key, pos, url): the first ``most`` locations of each sitemap that are useful URLs."""
    found = F.slice(F.regexp_extract_all(body_col, F.lit(LOC), F.lit(1)), 1, most)
    urls = df.select(key, F.posexplode(found).alias("pos", "loc")).withColumn("url", U.canonical(F.col("loc")))
    return urls.where(F.col("url").isNotNull() & U.useful(F.col("url"))).select(key, "pos", "url")


def robots_sitemaps(df: DataFrame, *, key: str, body_col: str = "body") -> DataFrame:
    return df.select(key, F.explode(F.regexp_extract_all(body_col, F.lit(SITEMAP_LINE), F.lit(1))).alias("sitemap"))


def robots_rules(df: DataFrame, *, key: str, body_col: str = "body") -> DataFrame:
    """(key, prefix): what any agent is kept from, cut at a wildcard; rules that say nothing are left out."""
    rules = df.select(key, F.explode(F.regexp_extract_all(body_col, F.lit(DISALLOW_LINE), F.lit(1))).alias("rule"))
    prefix = F.substring_index(F.trim("rule"), "*", 1)
    return rules.select(key, prefix.alias("prefix")).where("prefix like '/%' and length(prefix) > 1").distinct()


def robots_filter(urls: DataFrame, rules: DataFrame, *, key: str, url_col: str = "url") -> DataFrame:
    """URLs that no rule of their origin keeps out: an anti join on the origin with the prefix as its condition."""
    r = hinted(rules.withColumnRenamed(key, "_key"))
    return urls.join(r, (urls[key] == r["_key"]) & U.path(urls[url_col]).startswith(r["prefix"]), "left_anti")


def feed_items(df: DataFrame, *, key: str, body_col: str = "body", most: int = 20) -> DataFrame:
    """(key, pos, title, link, description): the first ``most`` items of each feed, tags stripped."""
    items = df.select(key, F.posexplode(F.slice(F.regexp_extract_all(body_col, F.lit(ITEM), F.lit(0)), 1, most)).alias("pos", "item"))

    def tag(name: str) -> Column:
        inner = F.regexp_extract("item", rf"(?is)<{name}[^>]*>(.*?)</{name}>", 1)
        return F.trim(F.regexp_replace(F.regexp_replace(inner, r"<[^>]+>", " "), r"\s+", " "))

    return items.select(key, "pos", tag("title").alias("title"), tag("link").alias("link"), tag("description").alias("description"))


def score(url: Column, kind: Column, topic: Column) -> Column:
    """How promising a candidate is: by kind, depth, topic hit; less for roots and shells, more for deep items."""
    p = U.path(url)
    base = F.coalesce(*(F.when(kind == k, F.lit(n)) for k, n in BASE_SCORES.items()))
    depth = F.size(F.filter(F.split(p, "/"), lambda x: x != ""))
    return base + F.least(depth, F.lit(4)) * 4 + F.when(topic, 30).otherwise(0) - F.when(p.rlike(U.ROOT_PATH), 60).otherwise(0) - F.when(p.rlike(U.SHELL_PATH), 45).otherwise(0) + F.when(p.rlike(DEEP_ITEM), 15).otherwise(0)


def select_with_caps(df: DataFrame, *, run: str, total: int, kind_col: str = "kind", order_col: str = "ord", preferred_col: str = "preferred") -> DataFrame:
    """Per run: the first of each evidence kind, then preferred ones, then the rest; capped by kind and in all."""
    first = F.row_number().over(Window.partitionBy(run, kind_col).orderBy(order_col))
    marked = df.withColumn("_first", first)
    evidence = F.coalesce(*(F.when((F.col(kind_col) == k) & (F.col("_first") == 1), F.lit(i)) for i, k in enumerate(EVIDENCE_KINDS)), F.when(F.col(preferred_col), F.lit(10)), F.lit(20))
    ranked = marked.withColumn("_group", evidence)
    caps = F.coalesce(*(F.when(F.col(kind_col) == k, F.lit(n)) for k, n in KIND_CAPS.items()), F.lit(total))
    within = ranked.withColumn("_in_kind", F.row_number().over(Window.partitionBy(run, kind_col).orderBy("_group", order_col))).where(F.col("_in_kind") <= caps)
    return within.withColumn("place", F.row_number().over(Window.partitionBy(run).orderBy("_group", order_col))).where(F.col("place") <= total).drop("_first", "_group", "_in_kind")


def select_evidence_first(df: DataFrame, *, run: str, total: int) -> DataFrame:
    """(run, place, url) from (run, url, host, kind, score, preferred): rounds in which each choice depends on those before.

    Best page of each evidence kind; best evidence page of each host not covered; evidence pages while the budget for
    deep pages lasts (two a host); preferred home pages; one robots and one sitemap; then the best of the rest (three a
    host). Only pages that could still be among the chosen reach the group of a run: a number bounded by ``total``, not by
    the run.
    """

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        part = part.assign(_n=part["url"].str.len()).sort_values(["score", "_n", "url"], ascending=[False, True, True]).drop_duplicates("url")
        rows = list(part[["url", "host", "kind", "preferred"]].itertuples(index=False, name=None))
        hosts = list(dict.fromkeys(r[1] for r in rows))
        alone = bool(part["alone"].iloc[0])
        deep_cap, any_cap = (total, total) if alone else (2, 3)
        budget = max(1, min(6, total - (3 if total >= 7 else 2 if total >= 3 else 0)))
        taken: dict[str, tuple] = {}
        by_host: dict[str, int] = {}

        def take(r: tuple, cap: int) -> None:
            if len(taken) < total and r[0] not in taken and by_host.get(r[1], 0) < cap:
                taken[r[0]] = r
                by_host[r[1]] = by_host.get(r[1], 0) + 1

        evidence = [r for r in rows if r[2] in EVIDENCE_KINDS]
        for kind in EVIDENCE_KINDS:
            if len(taken) < budget and not any(r[2] == kind for r in taken.values()):
                for r in [r for r in evidence if r[2] == kind][:1]:
                    take(r, total)
        for host in hosts:
            if len(taken) < budget and host not in by_host:
                for r in [r for r in evidence if r[1] == host][:1]:
                    take(r, deep_cap)
        for r in evidence:
            if len(taken) < budget:
                take(r, deep_cap)
        for r in sorted((r for r in rows if r[3] and r[2] == "homepage"), key=lambda r: r[0]):
            take(r, total)
        for kind in ("robots", "sitemap"):
            for r in [r for r in rows if r[2] == kind][:1]:
                take(r, total)
        for r in rows:
            take(r, any_cap)
        return pd.DataFrame({"run": [part["run"].iloc[0]] * len(taken), "place": range(1, len(taken) + 1), "url": list(taken)})

    source = df.select(F.col(run).cast("string").alias("run"), "url", "host", "kind", "score", "preferred")
    return _choosable(source, total).groupBy("run").applyInPandas(choose, "run string, place int, url string")


def _choosable(df: DataFrame, total: int) -> DataFrame:
    """Rows that ``select_evidence_first`` could choose, each once, and whether their run has one host alone.

    At most ``total`` pages are taken and so at most that many hosts are touched. In a round by score, a page is passed over
    only if it is taken or its host is touched, and a host gives ``total`` pages at most; so the first total * (total + 1)
    of the pages that are among the first ``total`` of their host decide the round. Home pages are taken by address, and
    hosts by their best page; there the first 2 * total decide.
    """
    best = (F.desc("score"), F.length("url"), "url")

    def first(rows: DataFrame, keys: list[str], order: tuple, k: int) -> DataFrame:  # ranks are cut before the shuffle
        return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= k).drop("_k")

    once = cut(first(df, ["run", "url"], best, 1), "candidates")
    deciding = lambda rows: first(first(rows, ["run", "host"], best, total), ["run"], best, total * (total + 1))
    evidence = once.where(F.col("kind").isin(EVIDENCE_KINDS))
    key = lambda when: F.min(F.when(when, F.struct((-F.col("score")).alias("s"), F.length("url").alias("n"), "url", "kind", "preferred")))
    hosts = once.groupBy("run", "host").agg(key(F.lit(True)).alias("any"), key(F.col("kind").isin(EVIDENCE_KINDS)).alias("own")).where("own is not null")
    hosts = first(hosts, ["run"], ("any",), 2 * total).select("run", "host", F.explode(F.array("any", "own")).alias("x"))
    parts = [
        deciding(once), deciding(evidence), first(once, ["run", "kind"], best, 1), first(once.where("preferred and kind = 'homepage'"), ["run"], ("url",), 2 * total),
        hosts.select("run", "x.url", "host", "x.kind", (-F.col("x.s")).alias("score"), "x.preferred"),
    ]
    kept = reduce(DataFrame.unionByName, parts).distinct()
    alone = once.groupBy("run").agg((F.min("host") == F.max("host")).alias("alone"))
    return kept.join(hinted(alone), "run")


def kind_mix(df: DataFrame, *, run: str, kind_col: str = "kind") -> DataFrame:
    return df.groupBy(run).pivot(kind_col, U.KINDS).count().na.fill(0)


def registry_match(inputs: DataFrame, registry: DataFrame, *, id_col: str) -> DataFrame:
    """(id, name, url, origin): entries of which a term is contained in one of the input's terms, or that match all; one row
    per URL, default before env before fixed. ``inputs`` has (id, terms), ``registry`` (name, url, origin, terms).

    Terms are looked up in the different texts of the inputs by their rarest characters (``containment``); each text ends
    in a line ``*``, which the entries that match all are found by."""
    text = inputs.select(id_col, F.concat(F.array_join(F.transform("terms", lambda x: F.regexp_replace(F.lower(x), r"\s+", "")), "\n"), F.lit("\n*")).alias("hay"))
    text = cut(text.withColumn("d", F.sha2("hay", 256)), "registry-inputs")
    entries = registry.select("name", "url", "origin", F.explode("terms").alias("term")).withColumn("term", F.regexp_replace(F.lower("term"), r"\s+", ""))
    entries = cut(entries.where((F.col("term") == "*") | (F.length("term") >= 2)), "registry")
    found = cut(containing(entries.select(F.col("term").alias("q"), F.col("term").alias("needle")), text.select("d", "hay").distinct()), "registry-hits")
    met = found.join(hinted(entries), F.col("q") == F.col("term")).select("d", "name", "url", "origin").distinct()
    hit = text.select(id_col, "d").join(hinted(met), "d")
    rank = F.coalesce(*(F.when(F.col("origin") == o, i) for i, o in enumerate(("default", "env", "fixed"))))
    return hit.withColumn("_k", F.row_number().over(Window.partitionBy(id_col, "url").orderBy(rank, "name"))).where("_k = 1").select(id_col, "name", "url", "origin")


def target_tables(df: DataFrame, *, kind_col: str = "kind") -> DataFrame:
    """One row for each table that a page of its kind feeds."""
    tables = F.coalesce(*(F.when(F.col(kind_col) == k, F.array(*map(F.lit, v))) for k, v in KIND_TABLES.items()))
    return df.withColumn("target_table", F.explode(tables))


def targets_to_sources(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """(target_id, source_id): the source of the same candidate and value, else the first of the value."""
    exact = sources.groupBy("candidate_id", "value").agg(F.min("source_id").alias("by_both"))
    loose = sources.groupBy("value").agg(F.min("source_id").alias("by_value"))
    return targets.join(exact, ["candidate_id", "value"], "left").join(loose, "value", "left").select("target_id", F.coalesce("by_both", "by_value").alias("source_id"))


def role_for_host(df: DataFrame, rules: DataFrame, *, id_col: str, host_col: str = "host") -> DataFrame:
    """(id, role): the role of the longest rule (suffix, role) that the host is or lies under, else null."""
    labels = F.split(host_col, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    ends = df.select(id_col, F.explode(suffixes).alias("suffix")).join(hinted(rules), "suffix")
    best = ends.groupBy(id_col).agg(F.max_by("role", F.length("suffix")).alias("role"))
    return df.select(id_col).join(best.hint("merge"), id_col, "left")
