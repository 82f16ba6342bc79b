"""Queries of the benchmark operators: a source's documents make a category, a customer's orders its runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.operators import benchmark as B
from claimloom.queries import query


def category_docs(t):
    d = t("documents").join(t("labels"), "doc_id", "left")
    noise = F.length(F.regexp_replace("text", r"[\p{L}\s.,]", "")) / F.greatest(F.length("text"), F.lit(1)).cast("double")
    return d.select(F.concat_ws("-", "source", "lang").alias("category"), (F.coalesce("quality", F.lit(0)) == 1).alias("accepted"), F.concat(F.lit("h"), F.col("doc_id") % 5).alias("host"), (F.col("n_chars") > 1500).alias("deep"), noise.alias("noise"), (F.coalesce("toxic", F.lit(0)) == 0).alias("verified"))


_DOCS = "(SELECT source || '-' || lang AS category, coalesce(quality, 0) = 1 AS accepted, 'h' || (d.doc_id % 5) AS host, n_chars > 1500 AS deep, length(regexp_replace(text, '[\\p{L}\\s.,]', '', 'g')) / CAST(greatest(length(text), 1) AS DOUBLE) AS noise, coalesce(toxic, 0) = 0 AS verified FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"
_METRICS = f"(SELECT category, count(*) FILTER (accepted) AS docs, count(DISTINCT host) FILTER (accepted) AS hosts, count(*) FILTER (accepted AND deep) AS deep, coalesce(avg(CAST(verified AS INTEGER)) FILTER (accepted), 0.0) AS verifiable, coalesce(quantile_cont(noise, 0.5) FILTER (accepted), 1.0) AS noise_median, coalesce(max(noise) FILTER (accepted), 1.0) AS noise_max FROM {_DOCS} d GROUP BY category)"


@query("b1_category_metrics", f"SELECT * FROM {_METRICS} m")
def b1(t):
    return B.category_metrics(category_docs(t), category="category")


def scored(t):
    m = B.category_metrics(category_docs(t), category="category")
    c = F.col
    n = F.length("category") + c("docs")
    return B.score_category(m.withColumns({"status": F.when(n % 9 == 0, "failed").otherwise("completed"), "actionable": c("docs") % 3, "duration_ms": c("docs") * 40000, "public_requests": c("docs") * 3, "model_requests": c("hosts"), "credits": c("deep") * 9, "cost": F.when(n % 7 > 0, c("docs") / 10), "cost_cap": F.lit(1.0)}))


_SCORED_IN = f"(SELECT *, CASE WHEN (length(category) + docs) % 9 = 0 THEN 'failed' ELSE 'completed' END AS status, docs % 3 AS actionable, docs * 40000 AS duration_ms, docs * 3 AS public_requests, hosts AS model_requests, deep * 9 AS credits, CASE WHEN (length(category) + docs) % 7 > 0 THEN docs / 10.0 END AS cost, 1.0 AS cost_cap FROM {_METRICS} m)"
_COST = "(public_requests > 32 OR model_requests > 3 OR credits > 50 OR cost IS NULL OR cost > cost_cap)"
_FAIL = f"list_filter([CASE WHEN status <> 'completed' THEN 'run_not_completed' END, CASE WHEN docs < 3 OR hosts < 2 OR deep < 1 THEN 'source_coverage' END, CASE WHEN verifiable < 0.7 THEN 'verifiable_ratio' END, CASE WHEN noise_median > 0.25 OR noise_max > 0.5 THEN 'residual_noise' END, CASE WHEN actionable < 1 THEN 'no_actionable_finding' END, CASE WHEN duration_ms > 300000 THEN 'duration' END, CASE WHEN {_COST} THEN 'cost_or_requests' END], lambda x: x IS NOT NULL)"
_POINTS = f"""round(least(1.0, docs / 3.0) * 12 + least(1.0, hosts / 2.0) * 8 + least(1.0, deep / 1.0) * 10 + least(1.0, verifiable / 0.7) * 30 + CASE WHEN noise_median <= 0.25 THEN 8.0 ELSE 8.0 * greatest(0.0, 1 - (noise_median - 0.25) / 0.75) END
 + CASE WHEN noise_max <= 0.5 THEN 7.0 ELSE 7.0 * greatest(0.0, 1 - (noise_max - 0.5) / 0.5) END + CASE WHEN actionable >= 1 THEN 10 ELSE 0 END + CASE WHEN status = 'completed' AND duration_ms <= 300000 THEN 10 ELSE 0 END + CASE WHEN {_COST} THEN 0 ELSE 5 END, 2)"""
_SCORED = f"(SELECT category, score, failures, score >= 70 AND len(failures) = 0 AS passed FROM (SELECT category, {_POINTS} AS score, {_FAIL} AS failures FROM {_SCORED_IN} i) q)"


@query("b2_score_category", f"SELECT category, score, array_to_string(failures, ',') AS failures, passed FROM {_SCORED} s")
def b2(t):
    return scored(t).select("category", "score", F.array_join("failures", ",").alias("failures"), "passed")


@query(
    "b3_early_stop",
    """WITH a AS (SELECT o_custkey, o_orderkey, o_totalprice > 200000 AS passed FROM orders), b AS (SELECT *, sum(CAST(passed AS INTEGER)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p, count(*) OVER (PARTITION BY o_custkey) - row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM a),
c AS (SELECT *, min(CASE WHEN p + r < 3 THEN o_orderkey END) OVER (PARTITION BY o_custkey) AS stop FROM b), d AS (SELECT *, stop IS NULL OR o_orderkey <= stop AS counted FROM c)
SELECT o_custkey, o_orderkey, passed, counted, CASE WHEN sum(CAST(passed AND counted AS INTEGER)) OVER (PARTITION BY o_custkey) >= 3 THEN 'passed' WHEN stop IS NOT NULL THEN 'stopped' ELSE 'failed' END AS verdict FROM d""",
)
def b3(t):
    return B.early_stop(t("orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") > 200000).alias("passed")), benchmark="o_custkey", seq="o_orderkey")


@query(
    "b4_model_cost",
    "SELECT l_orderkey, CAST(round(1000000 * CAST(sum(l_quantity * 1000 * pi / 1000000 + l_partkey * po / 1000000 + l_linenumber * ps) AS DOUBLE)) AS BIGINT) AS millionths FROM lineitem JOIN (SELECT CAST(n_nationkey AS BIGINT) AS model, CAST(6.5 + n_nationkey AS DOUBLE) AS pi, CAST(27 + n_regionkey AS DOUBLE) AS po, CAST(0.06 AS DOUBLE) AS ps FROM nation) p ON p.model = l_suppkey % 25 GROUP BY l_orderkey",
)
def b4(t):
    usage = t("lineitem").select("l_orderkey", (F.col("l_suppkey") % 25).alias("model"), (F.col("l_quantity") * 1000).cast("long").alias("input_tokens"), F.col("l_partkey").alias("output_tokens"), F.col("l_linenumber").alias("searches"))
    prices = t("nation").select(F.col("n_nationkey").cast("long").alias("model"), (F.col("n_nationkey") + 6.5).alias("input_price"), (F.col("n_regionkey") + 27).alias("output_price"), F.lit(0.06).alias("search_price"))
    return B.model_cost(usage, prices, run="l_orderkey").select("l_orderkey", (F.col("cost") * 1_000_000).cast("long").alias("millionths"))


@query(
    "b5_budget_violations",
    """WITH u AS (SELECT o_custkey, sum(o_totalprice) AS spend, count(*) AS requests, count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY o_custkey)
SELECT o_custkey, 'spend_cap_exceeded' AS violation FROM u WHERE spend > 3000000 UNION ALL SELECT o_custkey, 'requests_cap_exceeded' FROM u WHERE requests > 12 UNION ALL SELECT o_custkey, 'kinds_cap_exceeded' FROM u WHERE kinds > 4""",
)
def b5(t):
    u = t("orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spend"), F.count("*").alias("requests"), F.countDistinct("o_orderpriority").alias("kinds"))
    return B.budget_violations(u, {"spend": 3_000_000, "requests": 12, "kinds": 4}, run="o_custkey")


def _audit_sql():
    from claimloom.queries.evidence import _BOUND

    return f"SELECT finding, CASE WHEN ok = n THEN 'full' WHEN ok > 0 THEN 'partial' ELSE 'unsupported' END AS support FROM (SELECT item_id // 4 AS finding, count(*) AS n, count(*) FILTER (reason IS NULL) AS ok FROM {_BOUND} b GROUP BY ALL) q"


@query("b6_replay_audit", _audit_sql())
def b6(t):
    from claimloom.queries.evidence import bound

    return B.support_status(bound(t).select(F.floor(F.col("item_id") / 4).alias("finding"), F.col("reason").isNull().alias("bound")), finding="finding")


@query(
    "b7_replay_score",
    f"""SELECT category, score, docs >= 3 AND hosts >= 2 AND deep >= 1 AND verifiable >= 0.7 AND noise_median <= 0.25 AND noise_max <= 0.5 AND crossings = 0 AND duration_ms <= 300000 AND score >= 70 AS passed FROM (SELECT *,
round(least(docs / 3.0, 1) * 10 + least(hosts / 2.0, 1) * 10 + least(deep / 2.0, 1) * 10 + verifiable * 30 + (1 - noise_median) * 15 + CASE WHEN docs >= 2 AND hosts >= 2 THEN 10 ELSE 0 END + CASE WHEN duration_ms <= 180000 THEN 10 WHEN duration_ms <= 240000 THEN 7 WHEN duration_ms <= 300000 THEN 3 ELSE 0 END + 5, 4) AS score
FROM (SELECT *, docs * 40000 AS duration_ms, deep % 2 AS crossings FROM {_METRICS} m) a) b""",
)
def b7(t):
    m = B.category_metrics(category_docs(t), category="category")
    return B.replay_score(m.withColumns({"duration_ms": F.col("docs") * 40000, "crossings": F.col("deep") % 2, "competitors": F.col("docs"), "opportunities": F.col("hosts")})).select("category", "score", "passed")


@query(
    "b8_entity_crossing",
    """WITH k AS (SELECT DISTINCT l_suppkey % 50 AS competitor, l_partkey % 97 AS part FROM lineitem WHERE l_orderkey % 3 = 0), w AS (SELECT l_orderkey % 500 AS run, l_suppkey % 50 AS competitor, list(DISTINCT l_partkey % 97) AS sources FROM lineitem GROUP BY ALL)
SELECT run, count(*) FILTER (len(list_filter(sources, lambda x: NOT list_contains(coalesce(known, []), x))) > 0) AS crossings FROM w LEFT JOIN (SELECT competitor, list(part) AS known FROM k GROUP BY competitor) q ON q.competitor = w.competitor GROUP BY run""",
)
def b8(t):
    li = t("lineitem")
    sites = li.groupBy((F.col("l_orderkey") % 500).alias("run"), (F.col("l_suppkey") % 50).alias("competitor")).agg(F.collect_set(F.col("l_partkey").cast("long") % 97).alias("sources"))
    # a competitor knows a part of its own parts
    known = li.where("l_orderkey % 3 = 0").groupBy((F.col("l_suppkey") % 50).alias("competitor")).agg(F.collect_set(F.col("l_partkey").cast("long") % 97).alias("known"))
    return B.entity_crossing(sites, sites.select("run", "competitor").join(known, "competitor"), run="run")
