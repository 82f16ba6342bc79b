"""Queries of the snapshot operators: a document is a capture of one of its source's URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions import urls as U
from claimloom.operators import snapshots as V
from claimloom.queries import query
from claimloom.queries.urls import sql_canonical


def captures(t):
    url = F.concat(F.lit("http://"), F.col("source"), F.lit(".example/p"), F.floor(F.col("doc_id") / 20) % 30)
    return V.content_address(t("documents").select("doc_id", F.col("doc_id").alias("captured_at"), "source", url.alias("url"), F.col("text").alias("content"), (F.col("doc_id") % 3).alias("requests"), (F.col("doc_id") % 5).alias("credits"), (F.col("n_chars") % 7 * F.lit(0.25)).alias("cost")))


def chain(t):
    return V.version_chain(V.dedupe_snapshots(captures(t)))


_CAP = """(SELECT *, substr(sha256(url || chr(10) || content_hash), 1, 24) AS snapshot_id, octet_length(encode(content)) AS content_bytes FROM (SELECT doc_id, source, 'http://' || source || '.example/p' || (doc_id // 20 % 30) AS url, text AS content,
 'sha256:' || sha256(text) AS content_hash, doc_id % 3 AS requests, doc_id % 5 AS credits, n_chars % 7 * 0.25 AS cost FROM documents) q)"""
_DEDUP = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url, content_hash ORDER BY doc_id) AS k FROM {_CAP} c) d WHERE k = 1)"
_CHAIN = f"(SELECT *, lag(snapshot_id) OVER (PARTITION BY url ORDER BY doc_id) AS supersedes FROM {_DEDUP} e)"


@query("v1_content_address", f"SELECT doc_id, content_hash, snapshot_id, content_bytes FROM {_CAP} c")
def v1(t):
    return captures(t).select("doc_id", "content_hash", "snapshot_id", "content_bytes")


@query("v2_dedupe_snapshots", f"SELECT doc_id, url FROM {_DEDUP} d")
def v2(t):
    return V.dedupe_snapshots(captures(t)).select("doc_id", "url")


@query("v3_version_chain", f"SELECT doc_id, supersedes, CASE WHEN supersedes IS NULL THEN 'new_document' ELSE 'new_version' END AS outcome FROM {_CHAIN} d")
def v3(t):
    return chain(t).select("doc_id", "supersedes", "outcome")


@query("v4_store_summary", f"SELECT source, count(*) AS documents, count(DISTINCT url) AS urls, count(supersedes) AS versions, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(credits) AS BIGINT) AS credits, sum(cost) AS cost FROM {_CHAIN} d GROUP BY source")
def v4(t):
    return V.store_summary(chain(t), run="source")


@query(
    "v5_verify_store",
    f"""WITH s AS (SELECT CASE WHEN doc_id % 50 = 7 THEN replace(snapshot_id, 'a', 'b') ELSE snapshot_id END AS id, snapshot_id, url, content, content_hash, content_bytes + CASE WHEN doc_id % 40 = 3 THEN 1 ELSE 0 END AS n, content_bytes,
 requests - CASE WHEN doc_id % 90 = 9 THEN 5 ELSE 0 END AS requests, CASE WHEN doc_id % 60 = 11 AND supersedes IS NOT NULL THEN 'lost' ELSE supersedes END AS supersedes FROM {_CHAIN} d)
SELECT id AS snapshot_id, 'id' AS violation FROM s WHERE id <> snapshot_id UNION ALL SELECT id, 'bytes' FROM s WHERE n <> content_bytes UNION ALL SELECT id, 'range' FROM s WHERE requests < 0
UNION ALL SELECT id, 'duplicate' FROM s GROUP BY id HAVING count(*) > 1 UNION ALL SELECT DISTINCT id, 'content_duplicate' FROM (SELECT id, min(id) OVER w AS first, count(*) OVER (PARTITION BY url, content_hash, id) AS n FROM s WINDOW w AS (PARTITION BY url, content_hash)) x WHERE id <> first OR n > 1
UNION ALL SELECT id, 'broken_chain' FROM s WHERE supersedes IS NOT NULL AND supersedes NOT IN (SELECT id FROM s)""",
)
def v5(t):
    c = F.col
    bad = chain(t).withColumns({
        "snapshot_id": F.when(c("doc_id") % 50 == 7, F.replace("snapshot_id", F.lit("a"), F.lit("b"))).otherwise(c("snapshot_id")),
        "content_bytes": c("content_bytes") + F.when(c("doc_id") % 40 == 3, 1).otherwise(0),
        "requests": c("requests") - F.when(c("doc_id") % 90 == 9, 5).otherwise(0),
        "supersedes": F.when((c("doc_id") % 60 == 11) & c("supersedes").isNotNull(), "lost").otherwise(c("supersedes")),
    })
    return V.verify_store(bad)


_EVENTS = f"(SELECT doc_id AS place, snapshot_id, source, content_hash, requests, credits, supersedes, CASE WHEN supersedes IS NULL THEN 'stored_new_document' ELSE 'stored_new_version' END AS action FROM {_CHAIN} d)"


@query(
    "v5_verify_audit",
    f"""SELECT coalesce(s.place, e.place) AS place, CASE WHEN s.place IS NULL OR e.place IS NULL THEN 'count' ELSE 'audit' END AS violation FROM (SELECT * FROM {_EVENTS} x WHERE place % 70 <> 5) s
FULL JOIN (SELECT place, CASE WHEN place % 30 = 2 THEN source || 'x' ELSE source END AS source, content_hash, snapshot_id, CASE WHEN place % 45 = 4 THEN 'stored_new_version' ELSE action END AS action, CASE WHEN place % 55 = 6 THEN -1 ELSE credits END AS credits FROM {_EVENTS} y WHERE place % 80 <> 8) e ON e.place = s.place
WHERE s.place IS NULL OR e.place IS NULL OR s.source <> e.source OR s.action <> e.action OR e.credits < 0""",
)
def v5_audit(t):
    n = F.col("place")
    store = chain(t).withColumnRenamed("doc_id", "place")
    # rows that are lost, changed or negative are planted
    events = store.where("place % 80 <> 8").withColumns({"action": F.when(F.col("supersedes").isNotNull() | (n % 45 == 4), "stored_new_version").otherwise("stored_new_document"), "source": F.when(n % 30 == 2, F.concat("source", F.lit("x"))).otherwise(F.col("source")), "credits": F.when(n % 55 == 6, -1).otherwise(F.col("credits"))})
    events = events.select("place", "snapshot_id", "source", "content_hash", "requests", "credits", "action")
    return V.verify_audit(store.where("place % 70 <> 5"), events, same=["source", "content_hash"], usage=["requests", "credits"])


@query("v5_verify_summary", f"SELECT source, 'summary' AS violation FROM (SELECT DISTINCT source FROM {_CHAIN} d) x WHERE source IN ('src3', 'src5')")
def v5_summary(t):
    fresh = V.store_summary(chain(t), run="source")
    # one source's stored summary is off by one, another's is missing
    stored = fresh.where("source <> 'src5'").withColumn("documents", F.col("documents") + F.when(F.col("source") == "src3", 1).otherwise(0))
    return V.verify_summary(stored, fresh, run="source")


@query("v6_merge_waves", "SELECT o_custkey, wave, count(*) AS n FROM (SELECT o_orderkey, o_custkey, 2 AS wave FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, o_custkey, 1 FROM orders WHERE o_orderkey % 3 <> 0) q GROUP BY o_custkey, wave")
def v6(t):
    o = t("orders").select("o_orderkey", "o_custkey")
    # the second wave replaces a third of the first
    merged = V.merge_waves(o.withColumn("wave", F.lit(1)), o.where("o_orderkey % 3 = 0").withColumn("wave", F.lit(2)), key="o_orderkey")
    return merged.groupBy("o_custkey", "wave").agg(F.count("*").alias("n"))


@query(
    "v7_attach_usage",
    f"""WITH r AS (SELECT {sql_canonical('url')} AS key, e.value AS cost, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) END AS reported FROM events e JOIN pages p ON p.page_id = e.event_id % 300)
SELECT page_id, coalesce(n, 0) AS requests, CAST(coalesce(credits, 0) AS BIGINT) AS credits, coalesce(round(cost, 4), 0) AS cost FROM pages LEFT JOIN (SELECT key, count(*) AS n, sum(coalesce(reported, 2)) AS credits, sum(cost) AS cost FROM r GROUP BY key) u ON u.key = {sql_canonical('url')}""",
)
def v7(t):
    pages = t("pages").select("page_id", U.canonical(F.col("url")).alias("key"))
    k = F.from_json("props", "k bigint")["k"]
    requests = t("events").withColumn("page_id", F.col("event_id") % 300).join(pages, "page_id").select("key", F.col("value").alias("cost"), F.when(F.col("event_type") != "error", k).alias("reported"), F.lit(2).cast("long").alias("reserved"))
    return V.attach_usage(pages, requests, key="key").select("page_id", "requests", "credits", F.round("cost", 4).alias("cost"))
