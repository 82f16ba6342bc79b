"""Queries of the database tables: suppliers are competitors, parts products and opportunities, orders pains, customers contents, pages evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions import urls as U
from claimloom.operators import databases as D
from claimloom.queries import query

WEEK = "2026-06-01"


def databases(t, only=None):
    """Five runs. Some evidence doesn't exist, and every sixth page is bound to no document."""
    c = F.col
    ids = lambda key, each, more: F.transform(F.sequence(F.lit(0).cast("long"), more), lambda j: key % 5 + 5 * (F.floor(key / each) + 9 * j))
    of = lambda df, key, each, more, **own: df.select((key % 5).alias("run"), key.alias("ord"), key.alias("id"), ids(key, each, more).alias("evidence_ids"), *(v.alias(k) for k, v in own.items()))
    one, page = F.lit(0).cast("long"), c("page_id")
    s, p, o, k = (c(x) for x in ("s_suppkey", "p_partkey", "o_orderkey", "c_custkey"))
    pages = t("pages")
    return D.build_databases(
        t("region").select(c("r_regionkey").cast("long").alias("run"), c("r_name").alias("category"), F.lower("r_name").alias("market")),
        of(t("supplier"), s, 2, s % 3, name=c("s_name"), channel=c("s_nationkey"), positioning=c("s_acctbal"), sections=F.array("s_nationkey"), commerce=F.array("s_name")),
        of(t("part"), p, 40, one, competitor=p % 100, category=c("p_type"), signal=c("p_name"), tags=F.array(c("p_brand"), F.concat(F.lit(" "), F.upper("p_type")))),
        of(t("orders"), o, 300, one, theme=F.concat(c("o_orderpriority"), F.lit(" "), c("o_custkey") % 30), need=c("o_orderstatus"), frequency=c("o_custkey")),
        of(t("customer"), k, 30, k % 2, platform=c("c_mktsegment"), topic=F.concat(F.lit("Topic "), k % 400), content_type=c("c_nationkey"), why=c("c_name")),
        of(t("part"), p, 40, one, title=c("p_type"), summary=c("p_name"), total=c("p_size"), review=F.lit("needs_review")),
        pages.select((page % 5).alias("run"), page.alias("evidence"), page.alias("ord"), F.concat(F.lit("s"), F.floor(page / 5) % 40).alias("source"), F.when(page % 6 > 0, page).alias("document"), (page > 20).alias("new")),
        pages.select((page % 5).alias("run"), page.alias("document"), "url"),
        week=WEEK, only=only,
    )


def _refs(table: str, key: str, each: int, more: str) -> str:
    return f"(SELECT {key} % 5 AS run, {key} AS id, j AS place, page_id, 's' || ((page_id // 5) % 40) AS source, CASE WHEN page_id % 6 > 0 THEN url END AS url FROM (SELECT {key}, unnest(range(0, {more} + 1)) AS j FROM {table}) q JOIN pages ON page_id = {key} % 5 + 5 * ({key} // {each} + 9 * j))"


_COMPETITORS, _CONTENTS = _refs("supplier", "s_suppkey", 2, "s_suppkey % 3"), _refs("customer", "c_custkey", 30, "c_custkey % 2")
_FULL_HOST = f"regexp_replace(regexp_replace(lower(coalesce(regexp_extract(trim(url), '{U.AUTHORITY}', 1), '')), '^.*@', ''), ':\\d+$', '')"
_SOURCES = "(SELECT run, id, string_agg(source, ',' ORDER BY place) AS source_ids FROM (SELECT run, id, source, min(place) AS place FROM {0} r GROUP BY ALL) q GROUP BY run, id)"
_SITES = f"(SELECT run, id, arg_min(url, place) AS url FROM {_COMPETITORS} r WHERE url IS NOT NULL GROUP BY run, id HAVING count(DISTINCT coalesce(nullif({_FULL_HOST}, ''), url)) = 1)"
_KEYWORDS = """(SELECT run, lower(trim(keyword)) AS key, keyword, intent, place, id, tag, e FROM (SELECT p_partkey % 5 AS run, p_brand AS keyword, 'purchase' AS intent, 0 AS place, p_partkey AS id, 0 AS tag, p_partkey % 5 + 5 * (p_partkey // 40) AS e FROM part UNION ALL SELECT p_partkey % 5, ' ' || upper(p_type), 'purchase', 0, p_partkey, 1, p_partkey % 5 + 5 * (p_partkey // 40) FROM part
UNION ALL SELECT o_orderkey % 5, o_orderpriority || ' ' || (o_custkey % 30), 'pain_point', 1, o_orderkey, 0, o_orderkey % 5 + 5 * (o_orderkey // 300) FROM orders UNION ALL SELECT c_custkey % 5, 'Topic ' || (c_custkey % 400), 'research', 2, c_custkey, 0, c_custkey % 5 + 5 * (c_custkey // 30 + 9 * j) FROM (SELECT c_custkey, unnest(range(0, c_custkey % 2 + 1)) AS j FROM customer) c) k)"""


@query("m6_website_structure", f"SELECT s.run, 'website-structure-db-' || s.id AS id, s.id AS competitor, url, source_ids FROM {_SITES} s JOIN {_SOURCES.format(_COMPETITORS)} o ON o.run = s.run AND o.id = s.id")
def websites(t):
    return databases(t, ["website_structure_database"])["website_structure_database"].select("run", "id", "competitor", "url", F.array_join("source_ids", ",").alias("source_ids"))


@query("m6_website_topics", f"SELECT DISTINCT s.run, s.id AS competitor, b.id AS content, b.id AS ord, 'Topic ' || (b.id % 400) AS topic FROM {_SITES} s JOIN {_COMPETITORS} a ON a.run = s.run AND a.id = s.id JOIN {_CONTENTS} b ON b.run = a.run AND b.source = a.source")
def topics(t):
    return databases(t, ["website_topics"])["website_topics"]


@query("m8_competitors", f"SELECT s_suppkey % 5 AS run, 'competitor-db-' || s_suppkey AS id, s_name AS name, lower(r_name) AS market, coalesce(source_ids, '') AS source_ids FROM supplier JOIN region ON r_regionkey = s_suppkey % 5 LEFT JOIN {_SOURCES.format(_COMPETITORS)} o ON o.run = s_suppkey % 5 AND o.id = s_suppkey")
def competitors(t):
    return databases(t, ["competitor_database"])["competitor_database"].select("run", "id", "name", "market", F.array_join("source_ids", ",").alias("source_ids"))


@query("m8_products", f"SELECT p_partkey % 5 AS run, 'product-db-' || p_partkey AS id, p_partkey % 100 AS competitor, r_name || ' {D.SIGNAL} ' || row_number() OVER (PARTITION BY p_partkey % 5 ORDER BY p_partkey) AS name, p_type AS category, '{D.NO_PRICE}' AS price_signal FROM part JOIN region ON r_regionkey = p_partkey % 5")
def products(t):
    return databases(t, ["product_database"])["product_database"].drop("tags", "evidence_ids")


@query("m8_keywords", f"SELECT run, 'keyword-db-deepseek-' || row_number() OVER (PARTITION BY run ORDER BY place, id, tag) AS id, key, keyword, intent, '{D.KEYWORD_SOURCE}' AS source FROM (SELECT *, row_number() OVER (PARTITION BY run, key ORDER BY place, id, tag) AS k FROM {_KEYWORDS} k) q WHERE k = 1")
def keywords(t):
    return databases(t, ["keyword_database"])["keyword_database"]


@query("m8_keyword_evidence", f"SELECT DISTINCT run, key, e AS evidence FROM {_KEYWORDS} k")
def keyword_evidence(t):
    return databases(t, ["keyword_evidence"])["keyword_evidence"]


def _listed(table: str, key: str, label: str, n: int) -> str:
    return f"(SELECT list({label} ORDER BY {key}) FROM (SELECT *, row_number() OVER (PARTITION BY {key} % 5 ORDER BY {key}) AS k FROM {table}) q WHERE k <= {n} AND {key} % 5 = r_regionkey)"


@query("m8_weekly_reports", f"""SELECT CAST(r_regionkey AS BIGINT) AS run, r_name || ' {D.WEEKLY_TITLE}' AS title, '{WEEK}' AS week_of, array_to_string(list_concat({_listed('part', 'p_partkey', 'p_name', 3)}, {_listed('customer', 'c_custkey', "'Topic ' || (c_custkey % 400)", 2)}), '|') AS new_signals,
array_to_string(list_concat({_listed('supplier', 's_suppkey', 's_name', 3)}, {_listed('part', 'p_partkey', 'p_type', 3)}), '|') AS watch_list, array_to_string({_listed('(SELECT * FROM pages WHERE page_id > 20) p', 'page_id', 'page_id', 5)}, '|') AS evidence_ids FROM region""")
def weekly(t):
    return databases(t, ["weekly_intelligence_reports"])["weekly_intelligence_reports"].select("run", "title", "week_of", *(F.array_join(c, "|").alias(c) for c in ("new_signals", "watch_list", "evidence_ids")))
