"""Queries of the grading operators. A document stands for a page: its kind, URL and topic follow from its number, source and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions import urls as U
from claimloom.functions.text import SPACE
from claimloom.operators import grading as G
from claimloom.queries import query
from claimloom.queries.urls import sql_path

DOC_KINDS = ["homepage", "product", "collection", "blog", "rss", "sitemap", "robots", "search_results"]
HOSTS = ["shop.example.com", "www.sohu.example", "news.example.org", "brand.example.net"]
COMMERCE = ["tionner", "keiter", "aux en", "ing the"]


def graded_input(t):
    d = t("documents")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    topics = d.groupBy("source").agg(F.min_by("text", "doc_id").alias("first")).select("source", F.slice(F.split(F.lower("first"), r"[^\p{L}]+"), 1, 2).alias("terms"))
    host = pick(HOSTS, F.col("doc_id") / 3)
    url = F.concat(F.when(F.col("doc_id") % 4 == 0, "http://").otherwise("https://"), pick(HOSTS, F.floor(F.col("doc_id") / 3)), pick(["/", "/news", "/a/b", "/blog/"], F.floor(F.col("doc_id") / 5)))
    out = d.join(F.broadcast(topics), "source").select("doc_id", "source", "text", F.substring_index("text", "\n", 1).alias("title"), pick(DOC_KINDS, F.col("doc_id")).alias("kind"), url.alias("url"), "terms")
    return out.withColumns({"host": U.hostname(F.col("url")), "is_seed": G.seeded(F.col("url"), F.lit("https://shop.example.com/a"))})


def graded(t):
    return G.grade_sources(graded_input(t), commerce=COMMERCE)


def _list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def sql_pick(values, n):
    return f"list_extract({_list(values)}, CAST({n} % {len(values)} + 1 AS INTEGER))"


SQL_INPUT = f"""(SELECT *, regexp_replace(regexp_extract(url, '^https?://([^/]*)', 1), '^www\\.', '') AS host, starts_with(url, 'https://shop.example.com/a') AS is_seed FROM (
SELECT d.doc_id, d.source, d.text, string_split(d.text, chr(10))[1] AS title, {sql_pick(DOC_KINDS, 'd.doc_id')} AS kind,
 CASE WHEN d.doc_id % 4 = 0 THEN 'http://' ELSE 'https://' END || {sql_pick(HOSTS, '(d.doc_id // 3)')} || {sql_pick(['/', '/news', '/a/b', '/blog/'], '(d.doc_id // 5)')} AS url, t.terms
FROM documents d JOIN (SELECT source, regexp_split_to_array(lower(arg_min(text, doc_id)), '[^\\p{{L}}]+')[1:2] AS terms FROM documents GROUP BY source) t ON t.source = d.source) a)"""


def _any(c, terms):
    return "(" + " OR ".join(f"contains(lower({c}), '{x.lower()}')" for x in terms) + ")"


_TOPIC = "len(list_filter(terms, lambda x: contains(lower({0}), lower(x)))) > 0"
SQL_TYPE = f"""CASE WHEN kind IN ('homepage', 'product', 'collection', 'blog') AND ({' OR '.join(f"contains(host, '{p}')" for p in G.WEAK_HOST_PARTS)} OR ({_any('title', G.WEAK_TITLE_TERMS)} AND NOT {_TOPIC.format('title')})) THEN 'unknown'
{' '.join(f"WHEN kind = '{k}' THEN '{v}'" for k, v in G.TYPE_OF_KIND.items())} ELSE 'unknown' END"""
_ALL = "(title || chr(10) || url || chr(10) || text)"
SQL_REL = f"""CASE WHEN kind IN ('robots', 'sitemap') THEN 'medium' WHEN {_TOPIC.format(_ALL)} AND {_any(_ALL, COMMERCE)} THEN 'high' WHEN {_TOPIC.format(_ALL)} THEN 'medium'
 WHEN is_seed AND ({_any(_ALL, COMMERCE)} OR length({_ALL}) >= 800) THEN 'medium' ELSE 'low' END"""
_LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^{SPACE}+|{SPACE}+$', '', 'g')), lambda x: x <> '')"
_RATIO = f"CASE WHEN len({_LINES}) = 0 THEN 1.0 ELSE coalesce(list_sum(list_transform(list_filter({_LINES}, lambda x: length(x) <= 24 AND NOT regexp_matches(x, '{G.SENTENCE_MARK}') AND NOT regexp_matches(x, '\\d')), lambda x: length(x) + 1)), 0) / CAST(greatest(1, length(text)) AS DOUBLE) END"
SQL_SHELL = f"((length(text) >= 500 AND len({_LINES}) >= 20 AND {_RATIO} >= 0.45) OR (regexp_matches({sql_path('url')}, '{U.SHELL_PATH}') AND (length(text) < 1200 OR {_RATIO} >= 0.25)))"
SQL_CONF = """CASE WHEN shell OR source_type = 'unknown' OR kind = 'robots' THEN 'low' WHEN kind = 'sitemap' THEN CASE WHEN length(text) >= 80 THEN 'medium' ELSE 'low' END
 WHEN kind = 'homepage' AND url LIKE 'https://%' THEN CASE WHEN length(text) >= 400 THEN 'high' ELSE 'medium' END WHEN kind IN ('product', 'collection', 'blog', 'rss') AND length(text) >= 300 THEN 'high'
 WHEN length(text) >= 160 THEN 'medium' ELSE 'low' END"""
SQL_GRADED = f"""(SELECT *, source_type NOT IN ('robots', 'sitemap', 'search_candidate', 'unknown') AND relevance <> 'low' AND confidence <> 'low' AS accepted,
 CASE WHEN shell THEN 'navigation_shell' WHEN source_type IN ('robots', 'sitemap', 'search_candidate') THEN source_type || '_only' WHEN source_type = 'unknown' THEN 'aggregator' WHEN relevance = 'low' THEN 'off_topic'
 WHEN confidence = 'low' THEN 'weak' WHEN relevance = 'medium' OR confidence = 'medium' THEN 'candidate' ELSE 'spot_check' END AS review_reason
FROM (SELECT *, {SQL_CONF} AS confidence FROM (SELECT *, {SQL_TYPE} AS source_type, {SQL_REL} AS relevance, {SQL_SHELL} AS shell FROM {SQL_INPUT} i) j) k)"""


@query("q1_topic_terms", r"SELECT p_type, term FROM (SELECT p_type, unnest(list_distinct(list_filter([trim(p_type), trim(p_brand)] || regexp_split_to_array(p_type || ' ' || p_brand, '\s+|/|,|，'), lambda x: length(x) >= 2))) AS term FROM (SELECT DISTINCT p_type, p_brand FROM part) q) r GROUP BY ALL")
def q1(t):
    return t("part").select("p_type", "p_brand").distinct().select("p_type", F.explode(G.topic_terms("p_type", "p_brand")).alias("term")).distinct()


@query("q2_source_type", f"SELECT doc_id, {SQL_TYPE} AS source_type FROM {SQL_INPUT} i")
def q2(t):
    c = F.col
    return graded_input(t).select("doc_id", G.source_type(c("kind"), c("host"), c("title"), c("terms")).alias("source_type"))


@query("q3_relevance", f"SELECT doc_id, {SQL_REL} AS relevance FROM {SQL_INPUT} i")
def q3(t):
    c = F.col
    return graded_input(t).select("doc_id", G.relevance(c("kind"), F.concat_ws("\n", "title", "url", "text"), c("terms"), c("is_seed"), COMMERCE).alias("relevance"))


@query("q4_confidence", f"SELECT doc_id, confidence FROM {SQL_GRADED} g")
def q4(t):
    return graded(t).select("doc_id", "confidence")


@query("q5_navigation_shell", f"SELECT doc_id, {_RATIO} AS ratio, {SQL_SHELL} AS shell FROM {SQL_INPUT} i")
def q5(t):
    return graded_input(t).select("doc_id", G.shell_ratio(F.col("text"))["ratio"].alias("ratio"), G.navigation_shell(F.col("url"), F.col("text")).alias("shell"))


@query("q6_grade_sources", f"SELECT doc_id, source_type, relevance, confidence, accepted, review_reason FROM {SQL_GRADED} g")
def q6(t):
    return graded(t).select("doc_id", "source_type", "relevance", "confidence", "accepted", "review_reason")


_DOMAIN = ", ".join(f"('{d}', '{v}')" for d, v in [("accepted", "true"), ("accepted", "false"), *(("source_type", x) for x in G.TYPES), *((d, x) for d in ("relevance", "confidence") for x in G.LEVELS)])


@query(
    "q7_quality_summary",
    f"""WITH g AS (SELECT source, source_type, relevance, confidence, CAST(accepted AS VARCHAR) AS accepted FROM {SQL_GRADED} g),
l AS (SELECT source, 'accepted' AS dimension, accepted AS value FROM g UNION ALL SELECT source, 'source_type', source_type FROM g UNION ALL SELECT source, 'relevance', relevance FROM g UNION ALL SELECT source, 'confidence', confidence FROM g),
d(dimension, value) AS (VALUES {_DOMAIN}), s AS (SELECT DISTINCT source FROM g)
SELECT s.source, d.dimension, d.value, count(l.source) AS n FROM s CROSS JOIN d LEFT JOIN l ON l.source = s.source AND l.dimension = d.dimension AND l.value = d.value GROUP BY s.source, d.dimension, d.value""",
)
def q7(t):
    return G.quality_summary(graded(t), run="source")


@query("q8_usable_source", f"SELECT doc_id FROM {SQL_GRADED} g WHERE accepted AND relevance <> 'low' AND confidence <> 'low' AND source_type NOT IN ('robots', 'sitemap', 'search_candidate', 'unknown')")
def q8(t):
    return graded(t).where(G.usable_source()).select("doc_id")
