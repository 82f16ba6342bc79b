"""Queries of the run operators: customers are projects, orders their runs, parts of an order its keys; users of events are runs too."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.operators import runs as R
from claimloom.queries import query
from claimloom.queries.cleaning import sql_text


def order_keys(t):
    return t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("dimension"), F.when(F.col("l_linenumber") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("key"), F.col("l_linenumber").alias("ord"))


_KEYS = "(SELECT l_orderkey AS o_orderkey, l_returnflag AS dimension, CASE WHEN l_linenumber % 2 = 0 THEN upper(p_name) ELSE p_name END AS key, l_linenumber AS ord FROM lineitem JOIN part ON l_partkey = p_partkey)"
_NORM = "lower(regexp_replace(key, '\\s+', '', 'g'))"


@query("r1_stable_keys", f"SELECT DISTINCT o_orderkey, dimension, trim(key) AS key FROM {_KEYS} k")
def r1(t):
    k = order_keys(t).groupBy("o_orderkey").pivot("dimension", ["A", "N", "R"]).agg(F.collect_list(F.concat(F.lit(" "), "key")))
    payload = k.select("o_orderkey", F.to_json(F.struct("A", "N", "R", F.lit(5).alias("other"))).alias("payload"))
    return R.stable_keys(payload, ["A", "N", "R", "other"], run="o_orderkey")


_MONTH = "(SELECT date_trunc('month', l_shipdate) AS m, l_returnflag AS dimension, p_name || CAST(p_size AS VARCHAR) AS key FROM lineitem JOIN part ON l_partkey = p_partkey)"


def month(t, m):
    return t("lineitem").where(F.date_trunc("month", "l_shipdate") == F.to_timestamp(F.lit(m))).join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_returnflag").alias("dimension"), F.concat("p_name", F.col("p_size").cast("string")).alias("key"))


@query(
    "r2_set_diff",
    f"""WITH p AS (SELECT dimension, {_NORM} AS k, min(key) AS key FROM {_MONTH} x WHERE m = TIMESTAMP '2000-01-01' GROUP BY ALL), c AS (SELECT dimension, {_NORM} AS k, min(key) AS key FROM {_MONTH} x WHERE m = TIMESTAMP '2000-02-01' GROUP BY ALL)
SELECT coalesce(c.dimension, p.dimension) AS dimension, coalesce(c.key, p.key) AS key, CASE WHEN p.k IS NULL THEN 'added' ELSE 'removed' END AS change FROM c FULL JOIN p ON p.dimension = c.dimension AND p.k = c.k WHERE p.k IS NULL OR c.k IS NULL""",
)
def r2(t):
    return R.set_diff(month(t, "2000-01-01"), month(t, "2000-02-01"), on=["dimension"])


@query(
    "r3_score_changes",
    """WITH s AS (SELECT date_trunc('year', o_orderdate) AS y, o_orderpriority AS p, o_custkey % 200 AS title, arg_max(round(o_totalprice / 10000), o_orderkey) AS score FROM orders GROUP BY ALL)
SELECT c.p, c.title, b.score AS before, c.score AS after FROM s c LEFT JOIN s b ON b.p = c.p AND b.title = c.title AND b.y = TIMESTAMP '1996-01-01' WHERE c.y = TIMESTAMP '1997-01-01' AND (b.score IS NULL OR b.score <> c.score)""",
)
def r3(t):
    rows = lambda y: t("orders").where(F.year("o_orderdate") == y).select(F.col("o_orderpriority").alias("p"), (F.col("o_custkey") % 200).alias("title"), F.round(F.col("o_totalprice") / 10000).alias("score"), F.col("o_orderkey").alias("ord"))
    return R.score_changes(rows(1996), rows(1997), on=["p"])


def pairs(t):
    return R.consecutive(t("orders"), project="o_custkey", run="o_orderkey", at="o_orderdate")


_PAIRS = "(SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM orders)"
_DIFF = f"""(SELECT coalesce(c.o_orderkey, p.o_orderkey) AS o_orderkey, coalesce(c.dimension, p.dimension) AS dimension, coalesce(c.key, p.key) AS key, CASE WHEN p.k IS NULL THEN 'added' ELSE 'removed' END AS change
FROM (SELECT a.o_orderkey, dimension, {_NORM} AS k, min(key) AS key FROM {_PAIRS} a JOIN {_KEYS} k ON k.o_orderkey = a.o_orderkey WHERE previous IS NOT NULL GROUP BY ALL) c
FULL JOIN (SELECT a.o_orderkey, dimension, {_NORM} AS k, min(key) AS key FROM {_PAIRS} a JOIN {_KEYS} k ON k.o_orderkey = a.previous GROUP BY ALL) p ON p.o_orderkey = c.o_orderkey AND p.dimension = c.dimension AND p.k = c.k WHERE p.k IS NULL OR c.k IS NULL)"""


def diffs(t):
    return R.run_diff_all(pairs(t), order_keys(t), run="o_orderkey")


@query("r4_run_diff_all", f"SELECT * FROM {_DIFF} d")
def r4(t):
    return diffs(t)


@query(
    "r5_previous_run",
    """SELECT i.o_orderkey, i.o_custkey, i.o_orderpriority, i.o_orderdate AS started, (SELECT arg_max(o.o_orderkey, {'a': o.o_orderdate, 'b': o.o_orderkey}) FROM orders o WHERE o.o_custkey = i.o_custkey AND o.o_orderpriority = i.o_orderpriority AND o.o_orderdate < i.o_orderdate) AS previous_run
FROM orders i""",
)
def r5(t):
    o = t("orders")
    inputs = o.select("o_orderkey", "o_custkey", F.upper("o_orderpriority").alias("o_orderpriority"), F.col("o_orderdate").alias("started"))
    return R.previous_run(o, inputs, keys=["o_custkey", "o_orderpriority"], at="o_orderdate", run="o_orderkey", started="started")


@query(
    "r6_weekly_report",
    f"""SELECT o_orderkey, label, string_agg(key, ', ' ORDER BY key) AS lines FROM (SELECT *, dimension || ':' || change AS label, row_number() OVER (PARTITION BY o_orderkey, dimension, change ORDER BY key) AS k FROM {_DIFF} d) q WHERE k <= 6 GROUP BY o_orderkey, label
UNION ALL SELECT o_orderkey, 'baseline', '' FROM {_PAIRS} p WHERE previous IS NULL""",
)
def r6(t):
    return R.weekly_report(diffs(t), pairs(t), run="o_orderkey")


@query(
    "r7_history_context",
    f"""SELECT o_orderkey, dimension, string_agg(key, ', ' ORDER BY k) AS keys FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey, dimension ORDER BY ord, key) AS k FROM {_KEYS} d) q WHERE k <= CASE dimension WHEN 'A' THEN 2 WHEN 'N' THEN 1 WHEN 'R' THEN 3 END GROUP BY o_orderkey, dimension""",
)
def r7(t):
    return R.history_context(order_keys(t), {"A": 2, "N": 1, "R": 3}, run="o_orderkey")


@query("r8_list_runs", "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 9 > 0 THEN o_orderdate END AS finished FROM orders ORDER BY CASE WHEN o_orderkey % 9 > 0 THEN o_orderdate END DESC NULLS LAST, o_orderkey DESC LIMIT 50")
def r8(t):
    return R.list_runs(t("orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 9 > 0, F.col("o_orderdate")).alias("finished")), at="finished", tie="o_orderkey")


_EV = "(SELECT event_id, ts, user_id * 100 + event_id % 100 AS run, event_type, value FROM events)"


def event_runs(t):
    return t("events").withColumn("run", F.col("user_id") * 100 + F.col("event_id") % 100)


@query("r9_run_manifest", f"SELECT run, documents, failures, CASE WHEN documents = 0 THEN 'no_documents' WHEN failures > 0 THEN 'crawl_failures' ELSE 'ready' END AS status FROM (SELECT run, count(*) FILTER (event_type = 'signup') AS documents, count(*) FILTER (event_type = 'error') AS failures FROM {_EV} e GROUP BY run) q")
def r9(t):
    e = event_runs(t).select("run", F.when(F.col("event_type") == "signup", "document").when(F.col("event_type") == "error", "failure").otherwise("other").alias("kind"))
    return R.run_manifest(e, run="run")


_TEXT = "list_extract(['request timed out', 'HTTP 403 page', 'HTTP 404', 'status 429', 'fetch failed', 'odd', 'Timeout'], CAST(event_id % 7 + 1 AS INTEGER))"
_REASON = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower({_TEXT}), {sql_text(p)})" for p in ps) + f" THEN '{n}'" for n, ps in R.FAILURES) + " ELSE 'other' END"


@query(
    "r10_failure_breakdown",
    f"""WITH f AS (SELECT user_id, event_id, {_REASON} AS reason FROM events WHERE event_type = 'error'), d(reason) AS (VALUES {', '.join(f"('{n}')" for n in R.FAILURE_NAMES)})
SELECT u.user_id, d.reason, count(f.event_id) AS n, coalesce(string_agg(CAST(f.event_id AS VARCHAR), ',' ORDER BY f.event_id), '') AS jobs FROM (SELECT DISTINCT user_id FROM f) u CROSS JOIN d LEFT JOIN f ON f.user_id = u.user_id AND f.reason = d.reason GROUP BY u.user_id, d.reason""",
)
def r10(t):
    text = F.element_at(F.array(*map(F.lit, ("request timed out", "HTTP 403 page", "HTTP 404", "status 429", "fetch failed", "odd", "Timeout"))), (F.col("event_id") % 7 + 1).cast("int"))
    out = R.failure_breakdown(t("events").where("event_type = 'error'").select("user_id", "event_id", text.alias("text")), run="user_id", text_col="text", id_col="event_id")
    return out.withColumn("jobs", F.array_join(F.transform("jobs", lambda x: x.cast("string")), ","))


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("r11_run_log", f"SELECT run, CAST(greatest(0, epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts)))) AS BIGINT) AS seconds, count(*) AS events, {', '.join(f'count(*) FILTER (event_type = {sql_text(x)}) AS {chr(34)}{x}{chr(34)}' for x in _TYPES)} FROM {_EV} e GROUP BY run")
def r11(t):
    return R.run_log(event_runs(t), _TYPES, run="run", at="ts", status_col="event_type")


@query(
    "r12_public_summary",
    """WITH r AS (SELECT s_nationkey AS run, count(*) FILTER (s_acctbal > 9000) AS documents, count(*) FILTER (s_acctbal < 2000) AS failures, count(*) FILTER (s_suppkey % 2 = 0) AS reported FROM supplier GROUP BY ALL),
t AS (SELECT DISTINCT p_size % 25 AS run, lower(p_name) AS title FROM part WHERE p_retailprice > 1800), e AS (SELECT p_size % 25 AS run, p_name AS name, max(p_retailprice) AS score FROM part GROUP BY ALL),
k AS (SELECT e.*, row_number() OVER (PARTITION BY e.run ORDER BY score DESC, name) AS k FROM e SEMI JOIN t ON t.run = e.run AND t.title = lower(e.name))
SELECT r.run, least(reported, coalesce(titles, 0)) AS confirmed, CASE WHEN documents = 0 AND failures > 0 THEN 'technical_blocked' WHEN least(reported, coalesce(titles, 0)) > 0 THEN 'usable' ELSE 'insufficient' END AS state, coalesce(top, '') AS top
FROM r LEFT JOIN (SELECT run, count(*) AS titles FROM t GROUP BY run) n ON n.run = r.run LEFT JOIN (SELECT run, string_agg(name, ', ' ORDER BY k) AS top FROM k WHERE k <= 3 GROUP BY run) p ON p.run = r.run""",
)
def r12(t):
    p = t("part").withColumn("run", F.col("p_size") % 25)
    reports = t("supplier").groupBy(F.col("s_nationkey").alias("run")).agg(F.count_if(F.col("s_acctbal") > 9000).alias("documents"), F.count_if(F.col("s_acctbal") < 2000).alias("failures"), F.count_if(F.col("s_suppkey") % 2 == 0).alias("reported"))
    return R.public_summary(reports, p.where("p_retailprice > 1800").select("run", F.col("p_name").alias("title")), p.groupBy("run", F.col("p_name").alias("name")).agg(F.max("p_retailprice").alias("score")), run="run")
