"""Queries of the entity operators: parts are entities, suppliers competitors, orders and lines their batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions import urls as U
from claimloom.operators import entities as M
from claimloom.queries import query
from claimloom.queries.urls import sql_host


@query("m1_plan_batches")
def m1(t):
    return M.plan_batches(t("documents").where("n_chars > 0").select("source", F.col("doc_id").alias("ord"), F.col("doc_id").alias("doc"), F.col("n_chars").alias("chars")), run="source")


@query(
    "m2_merge_entities",
    """SELECT p_name AS name, text, array_to_string(items, ',') AS items, rank, merged FROM (SELECT lower(trim(p_name)) AS key, arg_min(p_name, p_partkey) AS p_name, max(p_size) AS rank, count(*) AS merged FROM part GROUP BY ALL) a
JOIN (SELECT lower(trim(p_name)) AS key, first(p_type || ' ' || p_brand ORDER BY length(p_type || ' ' || p_brand) DESC, p_partkey) AS text FROM part GROUP BY ALL) b USING (key)
JOIN (SELECT key, list(p_brand ORDER BY k) AS items FROM (SELECT lower(trim(p_name)) AS key, p_brand, min(p_partkey) AS k FROM part GROUP BY ALL) q GROUP BY key) c USING (key)""",
)
def m2(t):
    rows = t("part").select(F.lower(F.trim("p_name")).alias("key"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_type", "p_brand").alias("text"), F.array("p_brand").alias("items"), F.col("p_size").alias("rank"), F.col("p_partkey").alias("ord"))
    return M.merge_entities(rows, keys=["key"]).select("name", "text", F.array_join("items", ",").alias("items"), "rank", "merged")


@query(
    "m3_union_references",
    "SELECT arg_max(doc_id, doc_id) AS ord, min(doc_id) AS place, source FROM documents GROUP BY lower(text), source",
)
def m3(t):
    rows = t("documents").select(F.col("doc_id").alias("ord"), F.lower("text").alias("quote"), "source")
    return M.union_references(rows, keys=["quote", "source"]).select("ord", "place", "source")


@query(
    "m4_keyword_table",
    """WITH r AS (SELECT p_type AS keyword, p_partkey AS ord, p_partkey AS e, 'purchase' AS intent, 0 AS place FROM part UNION ALL SELECT lower(o_orderpriority), o_orderkey, o_orderkey, 'pain_point', 1 FROM orders
 UNION ALL SELECT ' ' || lower(p_type), p_partkey, p_partkey + 100000, 'research', 2 FROM part WHERE p_size > 45)
SELECT lower(trim(keyword)) AS key, first(intent ORDER BY place, ord) AS intent, first(keyword ORDER BY place, ord) AS spelling, count(DISTINCT e) AS evidence FROM r GROUP BY ALL""",
)
def m4(t):
    part, orders = t("part"), t("orders")
    tables = [
        (part.select(F.col("p_type").alias("keyword"), F.col("p_partkey").alias("ord"), F.col("p_partkey").alias("evidence_id")), "purchase"),
        (orders.select(F.lower("o_orderpriority").alias("keyword"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("evidence_id")), "pain_point"),
        (part.where("p_size > 45").select(F.concat(F.lit(" "), F.lower("p_type")).alias("keyword"), F.col("p_partkey").alias("ord"), (F.col("p_partkey") + 100000).alias("evidence_id")), "research"),
    ]
    return M.keyword_table(tables).withColumn("evidence", F.size("evidence").cast("long"))


_CL = "coalesce(CAST(floor(greatest(0, least(100, {0})) + 0.5) AS INTEGER), {1})"


@query(
    "m5_opportunity_scores",
    f"""SELECT p_partkey, a, b, c, d, CASE WHEN p_size % 3 > 0 THEN e ELSE 25 END AS e, CAST(floor((a + b + c + d + CASE WHEN p_size % 3 > 0 THEN e ELSE 25 END) / 5.0 + 0.5) AS INTEGER) AS total FROM (
SELECT p_partkey, p_size, {_CL.format('p_retailprice / 10', 50)} AS a, {_CL.format('CASE WHEN p_size > 5 THEN p_size * 3 END', 40)} AS b, {_CL.format('p_retailprice - 1000', 30)} AS c, {_CL.format('CASE WHEN p_partkey % 7 > 0 THEN p_partkey % 130 END', 20)} AS d, {_CL.format('p_size', 10)} AS e FROM part) q""",
)
def m5(t):
    p = t("part").select("p_partkey", (F.col("p_size") % 3 > 0).alias("ok"), (F.col("p_retailprice") / 10).alias("a"), F.when(F.col("p_size") > 5, F.col("p_size") * 3).alias("b"), (F.col("p_retailprice") - 1000).alias("c"), F.when(F.col("p_partkey") % 7 > 0, F.col("p_partkey") % 130).alias("d"), F.col("p_size").alias("e"))
    return M.opportunity_scores(p, scores=["a", "b", "c", "d", "e"], defaults=[50, 40, 30, 20, 10], evidence="e", confirmed="ok").drop("ok")


@query("m6_bind_single_host", f"SELECT page_id % 90 AS entity, min({sql_host('url')}) AS host, count(*) AS docs FROM pages GROUP BY ALL HAVING count(DISTINCT {sql_host('url')}) = 1 AND min({sql_host('url')}) <> ''")
def m6(t):
    p = t("pages")
    return M.bind_single_host(p.select((F.col("page_id") % 90).alias("entity"), F.col("page_id").alias("doc")), p.select(F.col("page_id").alias("doc"), U.hostname(F.col("url")).alias("host")))


@query(
    "m7_link_products",
    """WITH c AS (SELECT s_nationkey AS run, s_suppkey AS competitor, 'brand#' || (s_suppkey % 30) AS name, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier),
p AS (SELECT p_size % 25 AS run, p_partkey AS product, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE lower(p_brand) END AS k FROM part)
SELECT p.run, product, competitor FROM p JOIN c ON c.run = p.run AND c.name = p.k UNION ALL SELECT p.run, product, competitor FROM p JOIN c ON c.run = p.run AND p.k = '' AND c.n = 1""",
)
def m7(t):
    c = t("supplier").select(F.col("s_nationkey").alias("run"), F.col("s_suppkey").alias("competitor"), F.concat(F.lit("Brand#"), F.col("s_suppkey") % 30).alias("name"))
    p = t("part").select((F.col("p_size") % 25).alias("run"), F.col("p_partkey").alias("product"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_brand")).alias("competitor_name"))
    return M.link_products(p, c, run="run")


@query(
    "m8_build_databases",
    """WITH o AS (SELECT p_size AS run, p_brand AS key, 'old' AS v FROM part), n AS (SELECT p_size AS run, p_type AS key, 'new' AS v FROM part WHERE p_size % 4 = 1)
SELECT v, run, key, count(*) AS n FROM (SELECT * FROM n UNION ALL SELECT * FROM o WHERE run NOT IN (SELECT run FROM n)) q GROUP BY v, run, key""",
)
def m8(t):
    p = t("part")
    old = p.select(F.col("p_size").alias("run"), F.col("p_brand").alias("key"), F.lit("old").alias("v"))
    # only some runs get new rows, the others keep the old ones
    new = p.where("p_size % 4 = 1").select(F.col("p_size").alias("run"), F.col("p_type").alias("key"), F.lit("new").alias("v"))
    return M.replace_if_any(old, new, run="run").groupBy("v", "run", "key").agg(F.count("*").alias("n"))


@query(
    "m9_source_table",
    """SELECT s_suppkey, coalesce(n_name, 'manual') AS method, CASE WHEN n_nationkey IS NULL THEN 'medium' WHEN n_regionkey = 0 THEN 'high' ELSE 'low' END AS priority, CASE WHEN s_suppkey % 4 IN (0, 1) THEN 'weekly' ELSE 'on_demand' END AS cadence
FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 5 > 0) n ON n_nationkey = s_nationkey""",
)
def m9(t):
    kind = F.element_at(F.array(*map(F.lit, ("rss", "crawler", "url", "csv"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    # some sources have no candidate
    c = t("nation").where("n_nationkey % 5 > 0").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("method"), F.when(F.col("n_regionkey") == 0, "high").otherwise("low").alias("priority"))
    return M.source_table(t("supplier").withColumn("type", kind), c, on="s_nationkey").select("s_suppkey", "method", "priority", "cadence")


_TABLES = {"part": ("p_size", "p_partkey", "p_name"), "supplier": ("s_nationkey", "s_suppkey", "s_name"), "customer": ("c_nationkey", "c_custkey", "c_name")}


@query(
    "m10_database_counts",
    " UNION ALL ".join(f"SELECT CAST(run AS INTEGER) AS run, count(*) AS n, string_agg(CASE WHEN k <= 3 THEN label END, ', ' ORDER BY k) AS sample, '{n}' AS \"table\" FROM (SELECT {r} AS run, {l} AS label, row_number() OVER (PARTITION BY {r} ORDER BY {o}) AS k FROM {n}) q GROUP BY run" for n, (r, o, l) in _TABLES.items()),
)
def m10(t):
    return M.database_counts({n: t(n).select(F.col(r).cast("int").alias("run"), F.col(o).alias("ord"), F.col(l).alias("label")) for n, (r, o, l) in _TABLES.items()}, run="run")


@query(
    "m11_weekly_seed",
    """SELECT run, list, CAST(place AS INTEGER) AS place, label FROM (SELECT p_size AS run, 'signals' AS list, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS place, p_name AS label, 3 AS most FROM part
UNION ALL SELECT CAST(o_custkey % 50 AS INTEGER), 'watch', row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey), o_orderpriority, 2 FROM orders) q WHERE place <= most""",
)
def m11(t):
    parts = t("part").select(F.col("p_size").cast("int").alias("run"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("label"))
    orders = t("orders").select((F.col("o_custkey") % 50).cast("int").alias("run"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("label"))
    return M.weekly_seed([(parts, "signals", 3), (orders, "watch", 2)], run="run")


@query("m12_documents_union", "SELECT kind, lang, count(*) AS n, sum(length(text)) AS chars FROM (SELECT 'crawled' AS kind, lang, text FROM documents UNION ALL SELECT 'manual', NULL, text FROM conversations WHERE role = 'user') q GROUP BY kind, lang")
def m12(t):
    u = M.documents_union(t("documents").select(F.lit("crawled").alias("kind"), "lang", "text"), t("conversations").where("role = 'user'").select(F.lit("manual").alias("kind"), "text"))
    return u.groupBy("kind", "lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
