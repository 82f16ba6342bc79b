"""Queries of the source and sink operators; payloads are built from the tables' rows and parsed again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.queries import ORACLES, QUERIES, query
from claimloom.sources import tables as S
from claimloom.sources.scratch import scratch_path

SCHEMAS = {"documents": "doc_id bigint, lang string", "labels": "doc_id bigint, quality int", "pages": "page_id bigint, url string", "benchmark": "item_id bigint, text string"}


def s1(spark, sf_dir):
    """Rows by table; documents and the like are read with declared columns only."""
    counts = [df.groupBy(F.lit(n).alias("name")).agg(F.count("*").alias("n")) for n, df in S.read_tables(spark, sf_dir, SCHEMAS).items()]
    return reduce(DataFrame.unionByName, counts)


QUERIES["s1_read_tables"] = s1
ORACLES["s1_read_tables"] = " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in SCHEMAS)


@query("s2_read_seed_csv", "SELECT s_suppkey, 'csv' AS kind, 'https://x/' || s_suppkey AS url, s_name AS title, s_name || chr(10) || 'nation, ' || s_nationkey || chr(10) || 'say \"hi\"' AS text FROM supplier WHERE s_suppkey % 5 > 0")
def s2(t):
    name = F.when(F.col("s_suppkey") % 5 > 0, F.col("s_name")).otherwise("")
    line = F.to_csv(F.struct(name.alias("name"), F.concat(F.lit("https://x/"), F.col("s_suppkey")).alias("url"), F.concat(F.lit("nation, "), F.col("s_nationkey")).alias("category"), F.lit('say "hi"').alias("note")))
    return S.seeds_to_documents(S.parse_seed_lines(t("supplier").select("s_suppkey", line.alias("line"))), key="s_suppkey")


@query("s3_parse_search_payload", "SELECT page_id // 10 AS batch, 'v' || page_id AS video, url AS title, 'https://www.youtube.com/watch?v=v' || page_id AS url, url || chr(10) || 'c' || chr(10) || html AS text FROM pages WHERE page_id % 7 > 0")
def s3(t):
    item = F.struct(F.struct(F.when(F.col("page_id") % 7 > 0, F.concat(F.lit("v"), F.col("page_id"))).alias("videoId")).alias("id"), F.struct(F.col("url").alias("title"), F.col("html").alias("description"), F.lit("c").alias("channelTitle")).alias("snippet"))
    payloads = t("pages").groupBy(F.floor(F.col("page_id") / 10).alias("batch")).agg(F.to_json(F.struct(F.collect_list(item).alias("items"))).alias("payload"))
    return S.parse_search_payload(payloads, key="batch")


@query("s4_parse_listing_payload", "SELECT conv_id, CAST(turn AS VARCHAR) AS post, role AS title, 'https://www.reddit.com/r/' || conv_id AS url, role || chr(10) || substr(text, 1, 2000) AS text FROM conversations")
def s4(t):
    data = F.struct(F.struct(F.col("turn").cast("string").alias("id"), F.col("role").alias("title"), F.col("text").alias("selftext"), F.concat(F.lit("/r/"), F.col("conv_id")).alias("permalink")).alias("data"))
    payloads = t("conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.struct(F.collect_list(data).alias("children")).alias("data"))).alias("payload"))
    return S.parse_listing_payload(payloads, key="conv_id")


@query(
    "s5_content_to_documents",
    "SELECT conv_id, turn, job, substr(trim(text), 1, 160) AS excerpt, length(substr(trim(text), 1, 4000)) AS chars FROM conversations CROSS JOIN (VALUES ('content_database'), ('pain_point_database'), ('keyword_database')) j(job) WHERE trim(text) <> ''",
)
def s5(t):
    return S.content_to_documents(t("conversations"), key=["conv_id", "turn"]).select("conv_id", "turn", "job", "excerpt", F.length("text").cast("long").alias("chars"))


@query("s6_parse_result_urls", "SELECT page_id, CAST(0 AS INTEGER) AS pos, url FROM pages UNION ALL SELECT page_id, 1, url || '2' FROM pages WHERE page_id % 4 = 0")
def s6(t):
    u = F.col("url")
    shapes = [
        F.to_json(F.struct(F.array(F.struct(u.alias("url")), F.struct(F.concat(u, F.lit("2")).alias("url"))).alias("results"))),
        F.to_json(F.struct(F.array(F.struct(u.alias("link")), F.struct(F.lit("mailto:x").alias("link"))).alias("organic"))),
        F.to_json(F.struct(F.struct(F.array(F.struct(u.alias("url"))).alias("results")).alias("web"))),
        F.to_json(F.struct(F.struct(F.struct(F.array(F.struct(u.alias("url"))).alias("value")).alias("webPages")).alias("data"))),
    ]
    return S.parse_result_urls(t("pages").select("page_id", F.element_at(F.array(*shapes), (F.col("page_id") % 4 + 1).cast("int")).alias("payload")), key="page_id")


@query(
    "s7_coerce_extraction",
    """SELECT event_id, list, CAST(0 AS INTEGER) AS pos, event_type AS name, CASE WHEN event_id % 3 = 0 THEN 'approved' ELSE 'needs_review' END AS status, CAST(floor(greatest(0, least(100, k * 2.0 - 50)) + 0.5) AS INTEGER) AS score
FROM (SELECT event_id, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events WHERE event_id % 9 <> 4) e CROSS JOIN (VALUES ('competitors'), ('opportunities')) l(list)""",
)
def s7(t):
    k = F.from_json("props", "k bigint")["k"]
    item = F.struct(F.col("event_type").alias("name"), F.when(F.col("event_id") % 3 == 0, "approved").otherwise("sure").alias("status"), (k * 2.0 - 50).alias("score"))
    body = F.to_json(F.struct(F.array(item, F.struct(F.lit("").alias("name"), F.lit("approved").alias("status"), F.lit(1.0).alias("score"))).alias("competitors"), F.array(item).alias("opportunities"), F.lit("text").alias("pain_points")))
    text = F.when(F.col("event_id") % 9 == 4, "no answer").otherwise(F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nDone.")))
    return S.coerce_extraction(t("events").select("event_id", text.alias("text")), key="event_id")


@query(
    "s8_upsert_by_key",
    """SELECT k, v, price FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY v DESC, n DESC) AS r FROM (SELECT o_custkey AS k, o_orderdate AS v, max(o_totalprice) AS price, 0 AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL
UNION ALL SELECT o_custkey, o_orderdate, max(o_totalprice), 1 FROM orders WHERE o_orderkey % 2 = 1 GROUP BY ALL) a) b WHERE r = 1""",
)
def s8(t):
    part = lambda m: t("orders").where(F.col("o_orderkey") % 2 == m).groupBy(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("v")).agg(F.max("o_totalprice").alias("price"))
    spark = t("orders").sparkSession
    path = scratch_path(spark, "keyed")
    S.write_keyed(part(0), path, keys=["k"])
    S.upsert_table(path, part(1), keys=["k"], version="v")
    return S.read_keyed(spark, path)


@query(
    "s9_append_events",
    "SELECT coalesce(problem, 'valid') AS problem, count(*) AS n FROM (SELECT CASE WHEN event_id % 11 = 0 THEN 'run_missing' WHEN event_type NOT IN ('click', 'error') THEN 'status_unknown' WHEN octet_length(encode(repeat(props, CAST(event_id % 50 AS INTEGER)))) > 300 THEN 'payload_too_large' END AS problem FROM events) q GROUP BY ALL",
)
def s9(t):
    status = F.when(F.col("event_type") == "click", "succeeded").when(F.col("event_type") == "error", "failed").otherwise("other")
    e = t("events").select(F.when(F.col("event_id") % 11 > 0, F.col("user_id")).alias("run"), status.alias("status"), F.repeat("props", (F.col("event_id") % 50).cast("int")).alias("payload"))
    return S.split_events(e, run="run", status="status", payload="payload", most_bytes=300).groupBy(F.coalesce("problem", F.lit("valid")).alias("problem")).agg(F.count("*").alias("n"))


@query("s10_artifact_rows", "SELECT doc_id, 'report.md' AS file, 'text/markdown' AS content_type, octet_length(encode(text)) AS bytes FROM documents UNION ALL SELECT doc_id, 'lang.txt', 'text/plain', octet_length(encode(lang)) FROM documents WHERE lang <> 'en'")
def s10(t):
    return S.artifact_rows(t("documents"), {"report.md": (F.col("text"), "text/markdown"), "lang.txt": (F.when(F.col("lang") != "en", F.col("lang")), "text/plain")}, key="doc_id")


@query(
    "s11_backfill_plan",
    """SELECT status, count(*) AS n FROM (SELECT CASE WHEN e.k IS NULL THEN 'insert' WHEN l.v > e.v THEN 'update' ELSE 'skip' END AS status FROM (SELECT o_custkey AS k, max(o_orderdate) AS v FROM orders GROUP BY k) l LEFT JOIN (SELECT o_custkey AS k, max(o_orderdate) AS v FROM orders WHERE o_orderkey % 4 = 0 GROUP BY k) e ON e.k = l.k) q GROUP BY status""",
)
def s11(t):  # what is there already is a part of the orders
    part = lambda o: o.groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderdate").alias("v"))
    return S.backfill_plan(part(t("orders")), part(t("orders").where("o_orderkey % 4 = 0")), key="k", version="v")


@query(
    "s12_check_constraints",
    """WITH l AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 97 > 0 THEN l_partkey END AS p, l_quantity FROM lineitem), v AS (SELECT l_orderkey, l_linenumber, 'not_null:p' AS violation FROM l WHERE p IS NULL UNION ALL SELECT l_orderkey, l_linenumber, 'check:quantity' FROM l WHERE NOT l_quantity < 50
UNION ALL SELECT l_orderkey, l_linenumber, 'primary_key' FROM l GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT l_orderkey, l_linenumber, 'foreign_key:l_orderkey' FROM l WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 13 > 0))
SELECT violation, count(*) AS n, sum(l_orderkey) AS keys FROM v GROUP BY violation""",
)
def s12(t):  # some parents are missing
    li = t("lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 97 > 0, F.col("l_partkey")).alias("p"), "l_quantity")
    v = S.check_constraints(li, key=["l_orderkey", "l_linenumber"], required=["p"], checks={"quantity": F.col("l_quantity") < 50}, parent=(t("orders").where("o_orderkey % 13 > 0"), "l_orderkey", "o_orderkey"))
    return v.groupBy("violation").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))
