"""Queries of the plan operators: order priorities are plans, nations coverage rows, regions modules, suppliers candidates and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions import urls as U
from claimloom.functions.text import SPACE
from claimloom.plans import coverage as P
from claimloom.plans import targets as N
from claimloom.plans import waves as W
from claimloom.queries import query
from claimloom.queries.cleaning import sql_text
from claimloom.queries.urls import SQL_CAND, sql_canonical, sql_kind, sql_public, with_url
from claimloom.sources.scratch import cut, hinted


def coverage_rows(t):
    return t("nation").select(F.col("n_nationkey").alias("row_id"), F.col("n_regionkey").alias("module"), (F.col("n_nationkey") % 7).alias("axis"), (F.col("n_nationkey") % 4 + 1).alias("min_sources"), (F.col("n_nationkey") % 3 + 1).alias("min_roles"))


def axis_items(t):
    return t("part").where("p_size < 4").select((F.col("p_size") * 2).alias("axis"), F.col("p_type").alias("item")).distinct()


def matrix(t):
    return P.coverage_matrix(t("orders").select(F.col("o_orderpriority").alias("plan")).distinct(), coverage_rows(t), axis_items(t))


_MATRIX = """(SELECT plan, row_id, module, min_sources, min_roles, coalesce(axis_items, []) AS axis_items, least(3, len(coalesce(axis_items, []))) AS min_samples FROM (SELECT DISTINCT o_orderpriority AS plan FROM orders) p CROSS JOIN
(SELECT n_nationkey AS row_id, n_regionkey AS module, n_nationkey % 7 AS axis, n_nationkey % 4 + 1 AS min_sources, n_nationkey % 3 + 1 AS min_roles FROM nation) r LEFT JOIN (SELECT p_size * 2 AS axis, list_sort(list(DISTINCT p_type)) AS axis_items FROM part WHERE p_size < 4 GROUP BY p_size) i ON i.axis = r.axis)"""


@query("p1_coverage_matrix", f"SELECT plan, row_id, module, array_to_string(axis_items, ',') AS axis_items, min_sources, min_roles, min_samples FROM {_MATRIX} m")
def p1(t):
    return matrix(t).select("plan", "row_id", "module", F.array_join("axis_items", ",").alias("axis_items"), "min_sources", "min_roles", "min_samples")


def current(t):
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("o_orderpriority").alias("plan"), F.col("c_nationkey").alias("row_id")).agg((F.count("*") % 5).alias("sources"), F.countDistinct("c_mktsegment").alias("roles"), F.count_if(F.col("o_totalprice") > 300000).alias("samples"))


_CURRENT = "(SELECT o_orderpriority AS plan, c_nationkey AS row_id, count(*) % 5 AS sources, count(DISTINCT c_mktsegment) AS roles, count(*) FILTER (o_totalprice > 300000) AS samples FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"
_GAP = "CASE WHEN {0} < min_{0} THEN '{0}:' || {0} || '/' || min_{0} END"
_TASKS = f"""(SELECT plan, row_id, module, gaps, CASE WHEN len(gaps) = 0 THEN 'none' WHEN module IN (0, 2) THEN 'critical' WHEN len(gaps) > 1 THEN 'high' ELSE 'medium' END AS priority FROM (SELECT *, list_filter([{', '.join(_GAP.format(x) for x in ('sources', 'roles', 'samples'))}], lambda x: x IS NOT NULL) AS gaps
FROM (SELECT m.*, coalesce(c.sources, 0) AS sources, coalesce(c.roles, 0) AS roles, coalesce(c.samples, 0) AS samples FROM {_MATRIX} m LEFT JOIN {_CURRENT} c ON c.plan = m.plan AND c.row_id = m.row_id) a) b)"""


def tasks(t):
    return P.acquisition_tasks(matrix(t), current(t), keys=["plan", "row_id"], critical=[0, 2])


@query("p2_acquisition_tasks", f"SELECT plan, row_id, module, array_to_string(gaps, ',') AS gaps, priority FROM {_TASKS} x")
def p2(t):
    return tasks(t).withColumn("gaps", F.array_join("gaps", ","))


@query("p3_module_task_groups", f"SELECT r.r_regionkey AS module, count(t.row_id) AS tasks, count(DISTINCT t.row_id) AS rows, coalesce(array_to_string(list_sort(list_distinct(flatten(list(t.gaps)))), ','), '') AS roles FROM region r LEFT JOIN (SELECT * FROM {_TASKS} x WHERE module <> 3) t ON t.module = r.r_regionkey GROUP BY r.r_regionkey")
def p3(t):
    modules = t("region").select(F.col("r_regionkey").alias("module"))
    return P.module_task_groups(tasks(t).where("module <> 3"), modules, roles="gaps").withColumn("roles", F.coalesce(F.array_join("roles", ","), F.lit("")))


_ADAPTER = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.ROUTES.items()) + " ELSE 'none' END"


@query(
    "p4_route_targets",
    f"""SELECT page_id, adapter, CASE WHEN NOT public OR adapter = 'none' OR page_id % 9 = 0 THEN 'blocked' WHEN adapter IN ('url_discovery', 'search_api') THEN 'discover_only' ELSE 'collect' END AS disposition
FROM (SELECT page_id, {_ADAPTER} AS adapter, {sql_public('cand')} AS public FROM (SELECT *, CASE WHEN page_id % 13 = 0 THEN 'other' ELSE {sql_kind('cand')} END AS kind FROM {SQL_CAND} q) a) b""",
)
def p4(t):
    p = with_url(t("pages")).select("page_id", F.col("cand").alias("url"), F.when(F.col("page_id") % 13 == 0, "other").otherwise(U.kind(F.col("cand"))).alias("kind"), F.when(F.col("page_id") % 9 > 0, F.col("page_id")).alias("task_id"))
    return P.route_targets(p).select("page_id", "adapter", "disposition")


@query("p5_candidate_inputs", "SELECT priority, count(*) AS n FROM (SELECT CASE WHEN r <= 2 THEN 'high' WHEN r <= 5 THEN 'medium' ELSE 'low' END AS priority FROM (SELECT row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) a) b GROUP BY priority")
def p5(t):
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return t("events").select(P.candidate_priority(r).alias("priority")).groupBy("priority").agg(F.count("*").alias("n"))


def supplier_candidates(t):
    s = F.col("s_suppkey")
    url = F.concat(F.when(s % 17 == 0, "ftp").otherwise("https"), F.lit("://www.h"), s % 12, F.lit(".example/p"), F.floor(s / 3) % 20, F.lit("/?utm_source=x"))
    return t("supplier").select((F.col("s_nationkey") % 5).alias("plan"), s.alias("ord"), s.alias("candidate"), url.alias("url"), F.col("s_nationkey").alias("role"), (s % 10 == 3).alias("login"), (s % 14 == 5).alias("captcha"), (s % 3).alias("rank"), (s % 4 + 1).alias("requests"), (s % 5 == 0).alias("brand"))


_SUPP = "(SELECT s_nationkey % 5 AS plan, s_suppkey AS ord, s_suppkey AS candidate, CASE WHEN s_suppkey % 17 = 0 THEN 'ftp' ELSE 'https' END || '://www.h' || (s_suppkey % 12) || '.example/p' || (s_suppkey // 3 % 20) || '/?utm_source=x' AS url, s_nationkey AS role, s_suppkey % 10 = 3 AS login, s_suppkey % 14 = 5 AS captcha FROM supplier)"


def assessed(t):
    roles = t("nation").where("n_nationkey % 6 <> 4").select(F.col("n_nationkey").alias("role"), F.array("n_regionkey").alias("modules"))
    return P.assess_candidates(supplier_candidates(t), roles, plan="plan")


_ASSESSED = f"""(SELECT *, len(reasons) = 0 AS ok FROM (SELECT *, list_filter([CASE WHEN canonical IS NULL OR NOT public THEN 'url_not_public' END, CASE WHEN duplicate_of IS NOT NULL THEN 'duplicate' END, CASE WHEN role % 6 = 4 THEN 'role_unknown' END, CASE WHEN login THEN 'login_required' END, CASE WHEN captcha THEN 'captcha_required' END], lambda x: x IS NOT NULL) AS reasons
FROM (SELECT *, CASE WHEN canonical IS NOT NULL AND min(ord) OVER (PARTITION BY plan, canonical) <> ord THEN min(ord) OVER (PARTITION BY plan, canonical) END AS duplicate_of FROM (SELECT *, {sql_canonical('url')} AS canonical, {sql_public('url')} AS public FROM {_SUPP} s) a) b) c)"""


@query("p6_assess_candidates", f"SELECT candidate, canonical, duplicate_of, array_to_string(reasons, ',') AS reasons, CASE WHEN ok THEN 'eligible' ELSE 'blocked' END AS status FROM {_ASSESSED} x")
def p6(t):
    return assessed(t).select("candidate", "canonical", "duplicate_of", F.array_join("reasons", ",").alias("reasons"), "status")


@query("p7_allocate_budget")
def p7(t):
    eligible = assessed(t).where("status = 'eligible'").withColumn("host", U.hostname(F.col("url")))
    return P.allocate_budget(eligible, plan="plan", max_eligible=10, max_requests=24, per_role=3, per_host=2, brand_share=0.3)


@query(
    "p8_candidate_coverage",
    f"""SELECT m.plan, m.row_id, coalesce(eligible, 0) AS eligible, coalesce(roles_found, 0) AS roles_found, coalesce(eligible, 0) >= min_sources AND coalesce(roles_found, 0) >= min_roles AS met
FROM (SELECT plan % 5 AS plan, n_nationkey AS row_id, n_nationkey % 4 + 1 AS min_sources, n_nationkey % 3 + 1 AS min_roles FROM nation CROSS JOIN (VALUES (0), (1), (2), (3), (4)) v(plan)) m LEFT JOIN (SELECT plan, candidate % 25 AS row_id, count(*) AS eligible, count(DISTINCT role) AS roles_found FROM {_ASSESSED} x WHERE ok GROUP BY ALL) c ON c.plan = m.plan AND c.row_id = m.row_id""",
)
def p8(t):
    c = assessed(t).where("status = 'eligible'").withColumn("row_id", F.col("candidate") % 25)
    rows = t("supplier").select((F.col("s_nationkey") % 5).alias("plan")).distinct().crossJoin(coverage_rows(t))
    return P.candidate_coverage(rows, c, keys=["plan", "row_id"])


def samples(t):
    """Suppliers with the part types and brands they supply."""
    li = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    g = li.groupBy(F.col("l_suppkey").alias("sample")).agg(F.collect_set("p_type").alias("taxonomy"), F.collect_set(F.concat(F.lit("t"), F.col("p_size") % 6)).alias("price_tier"), F.collect_set("p_brand").alias("channel"))
    rel = F.element_at(F.array(*map(F.lit, ("competitor", "channel", "analogy"))), (F.col("sample") % 3 + 1).cast("int"))
    return g.withColumns({"relationship": rel, "sample_type": F.when(F.col("sample") % 7 == 2, "analogy").otherwise(F.when(F.col("sample") % 3 == 2, "analogy").otherwise("actor")), "status": F.when(F.col("sample") % 9 == 0, "draft").otherwise("validated"), "basis": F.when(F.col("sample") % 11 > 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")), "populations": F.when(F.col("sample") % 4 > 0, F.array(F.lit("p"))).otherwise(F.array().cast("array<string>"))})


_SAMPLES = """(SELECT l_suppkey AS sample, list_extract(['competitor', 'channel', 'analogy'], CAST(l_suppkey % 3 + 1 AS INTEGER)) AS relationship, CASE WHEN l_suppkey % 7 = 2 OR l_suppkey % 3 = 2 THEN 'analogy' ELSE 'actor' END AS sample_type, CASE WHEN l_suppkey % 9 = 0 THEN 'draft' ELSE 'validated' END AS status,
 list(DISTINCT p_type) AS taxonomy, list(DISTINCT 't' || (p_size % 6)) AS price_tier, list(DISTINCT p_brand) AS channel FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey)"""


@query(
    "p9_validate_samples",
    f"""WITH s AS (SELECT * FROM {_SAMPLES} x), e AS (SELECT sample, 'not_validated:draft' AS error FROM s WHERE status = 'draft' UNION ALL SELECT sample, 'basis_missing' FROM s WHERE sample % 11 = 0 UNION ALL SELECT sample, 'analogy_mismatch' FROM s WHERE (relationship = 'analogy') <> (sample_type = 'analogy')
UNION ALL SELECT sample, 'population_missing' FROM s WHERE relationship = 'competitor' AND sample % 4 = 0 UNION ALL SELECT sample, 'unknown_axis_item:LARGE' FROM s WHERE list_contains(taxonomy, 'LARGE')
UNION ALL SELECT sample, 'source_required' FROM s WHERE sample % 5 = 0 UNION ALL SELECT sample, 'source_missing' FROM s WHERE sample % 5 > 0 AND sample % 8 = 7 UNION ALL SELECT sample, 'source_not_eligible' FROM s WHERE sample % 5 > 0 AND sample % 8 <> 7 AND sample % 6 = 1
UNION ALL SELECT sample, 'role_not_allowed' FROM s WHERE sample % 5 = 0 OR sample % 8 = 7 OR NOT ((relationship = 'competitor' AND sample % 2 = 0) OR (relationship = 'channel' AND sample % 2 = 1) OR relationship = 'analogy'))
SELECT s.sample, coalesce(string_agg(error, ',' ORDER BY error), '') AS errors FROM s LEFT JOIN e ON e.sample = s.sample GROUP BY s.sample""",
)
def p9(t):
    s = samples(t)
    k = F.col("s_suppkey")
    bindings = t("supplier").where("s_suppkey % 5 > 0").select(k.alias("sample"), k.alias("source"))
    sources = t("supplier").where("s_suppkey % 8 <> 7").select(k.alias("source"), (k % 6 != 1).alias("eligible"), F.when(k % 2 == 0, "official").otherwise("retail").alias("role"))
    axes = t("part").where("p_type <> 'LARGE'").select(F.col("p_type").alias("item")).distinct()
    fits = sources.select("role").distinct().withColumn("relationship", F.explode(F.array(F.lit("competitor"), F.lit("channel"), F.lit("analogy")))).where("(relationship = 'competitor' and role = 'official') or (relationship = 'channel' and role = 'retail') or relationship = 'analogy'")
    return P.validate_samples(s, bindings, sources, axes, fits, sample="sample").withColumn("errors", F.array_join("errors", ","))


_AXES = ["taxonomy", "price_tier", "channel"]


@query("p10_coverage_keys", " UNION ALL ".join(f"SELECT sample, '{a}:' || unnest({a}) AS key FROM {_SAMPLES} x" for a in _AXES))
def p10(t):
    return P.coverage_keys(samples(t), _AXES, sample="sample")


def plan_keys(t):
    return P.coverage_keys(samples(t), _AXES, sample="sample").withColumn("plan", F.floor(F.col("sample") / 50))


@query("p11_greedy_cover")
def p11(t):
    return P.greedy_cover(plan_keys(t), plan="plan", sample="sample")


@query(
    "p12_relationship_backfill",
    f"""WITH s AS (SELECT sample, relationship FROM {_SAMPLES} x), h AS (SELECT relationship, count(*) AS have FROM s WHERE sample % 10 < 2 GROUP BY relationship), r AS (SELECT *, row_number() OVER (PARTITION BY relationship ORDER BY sample) AS k FROM s WHERE sample % 10 >= 2)
SELECT r.sample, r.relationship FROM r JOIN (SELECT relationship, max(sample) % 7 + 8 AS least FROM s GROUP BY relationship) m ON m.relationship = r.relationship LEFT JOIN h ON h.relationship = r.relationship WHERE k <= least - coalesce(have, 0)""",
)
def p12(t):
    s = samples(t).select("sample", "relationship")
    return P.relationship_backfill(s.where("sample % 10 < 2"), s.where("sample % 10 >= 2"), s.groupBy("relationship").agg((F.max("sample") % 7 + 8).alias("least")), sample="sample").select("sample", "relationship")


@query("p13_axis_coverage", f"WITH a AS (SELECT DISTINCT p_size % 5 AS axis, p_brand AS item FROM part), k AS (SELECT DISTINCT sample % 5 AS axis, unnest(channel) AS item FROM {_SAMPLES} x) SELECT a.axis, count(k.item) AS covered, coalesce(string_agg(CASE WHEN k.item IS NULL THEN a.item END, ',' ORDER BY a.item), '') AS uncovered FROM a LEFT JOIN k ON k.axis = a.axis AND k.item = a.item GROUP BY a.axis")
def p13(t):
    axes = t("part").select((F.col("p_size") % 5).cast("long").alias("axis"), F.col("p_brand").alias("item")).distinct()
    keys = samples(t).select((F.col("sample") % 5).cast("long").alias("axis"), F.explode("channel").alias("item"))
    return P.axis_coverage(axes, keys).withColumn("uncovered", F.array_join("uncovered", ","))


def gate_inputs(t):
    k = F.col("s_suppkey")
    own = t("supplier").where("s_suppkey % 5 <> 4").select(k.alias("sample"), F.element_at(F.array(*map(F.lit, P.RELATIONSHIPS)), (k % 4 + 1).cast("int")).alias("relationship"))
    li = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), i.alias("item")) for a, i in (("taxonomy", F.col("p_type")), ("price_tier", F.concat(F.lit("t"), F.col("p_size") % 6)), ("channel", F.col("p_brand")), ("population", F.col("l_returnflag")))))).alias("x")
    assigned = li.select(F.col("l_suppkey").alias("sample"), pairs).select("sample", "x.*").distinct()
    item = lambda axis, c: t("part").select(F.lit(axis).alias("axis"), c.alias("item")).distinct()
    axes = item("taxonomy", F.col("p_type")).unionByName(item("price_tier", F.concat(F.lit("t"), F.col("p_size") % 7))).unionByName(item("channel", F.col("p_brand"))).unionByName(item("value_chain", F.concat(F.lit("v"), F.col("p_size") % 3)))
    least = t("region").limit(1).select(F.explode(F.create_map(*(F.lit(x) for kv in LEAST.items() for x in kv))).alias("requirement", "least"))
    return own, assigned, axes, least


LEAST = {"price_tier": 6, "channel": 3, "business_model": 1, "population": 3, "direct_competitor": 2, "supply_chain_actor": 1, "channel_actor": 5000, "business_model_analogy": 1}
_OWN = f"own AS (SELECT s_suppkey AS sample, list_extract({P.RELATIONSHIPS}, CAST(s_suppkey % 4 + 1 AS INTEGER)) AS relationship FROM supplier WHERE s_suppkey % 5 <> 4)"
_GATE = f"""{_OWN}, a AS (SELECT DISTINCT l_suppkey AS sample, unnest(['taxonomy', 'price_tier', 'channel', 'population']) AS axis, unnest([p_type, 't' || (p_size % 6), p_brand, l_returnflag]) AS item FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_suppkey IN (SELECT sample FROM own)),
axes AS (SELECT DISTINCT unnest(['taxonomy', 'price_tier', 'channel', 'value_chain']) AS axis, unnest([p_type, 't' || (p_size % 7), p_brand, 'v' || (p_size % 3)]) AS item FROM part),
n AS (SELECT axes.axis, axes.item, count(a.sample) AS n FROM axes LEFT JOIN a ON a.axis = axes.axis AND a.item = axes.item GROUP BY ALL),
least AS (SELECT unnest({list(LEAST)}) AS requirement, unnest({list(LEAST.values())}) AS least),
gate AS (SELECT *, CASE WHEN found >= least THEN 'pass' ELSE 'blocked_insufficient_coverage' END AS status FROM (SELECT place, r.requirement, CASE WHEN place = 0 THEN (SELECT count(*) FROM n WHERE axis = 'taxonomy' AND n >= 20) WHEN place < 4 THEN (SELECT count(*) FROM n WHERE axis = r.requirement AND n > 0) WHEN place = 4 THEN (SELECT count(DISTINCT item) FROM a WHERE axis = 'population') ELSE (SELECT count(*) FROM own WHERE relationship = r.requirement) END AS found,
 CASE WHEN place = 0 THEN (SELECT count(*) FROM n WHERE axis = 'taxonomy') ELSE coalesce(least, 0) END AS least FROM (SELECT unnest({[*range(10)]}) AS place, unnest({['taxonomy', *P.GATED_AXES, 'population', *P.RELATIONSHIPS]}) AS requirement) r LEFT JOIN least l ON l.requirement = r.requirement) q)"""


@query("p14_coverage_gate", f"WITH {_GATE} SELECT requirement, found, least, status FROM gate")
def p14(t):
    own, assigned, axes, least = gate_inputs(t)
    return P.coverage_gate(own, assigned, axes, least, least_each=20).drop("place")


@query(
    "p14_gate_gaps",
    f"""WITH {_GATE} SELECT 0 AS phase, CASE WHEN bool_and(status = 'pass') THEN {sql_text(P.GATE_PASSED)} ELSE {sql_text(P.GATE_BLOCKED)} END AS gap FROM gate UNION ALL SELECT 1, 'uncovered_axis_item:' || item FROM n WHERE n = 0 AND EXISTS (SELECT 1 FROM gate WHERE status <> 'pass')
UNION ALL SELECT 2, 'relationship_minimum:' || requirement || ':' || found || '/' || least FROM gate WHERE place > 4 AND status <> 'pass'""",
)
def p14_gaps(t):
    own, assigned, axes, least = gate_inputs(t)
    return P.gate_gaps(cut(P.coverage_gate(own, assigned, axes, least, least_each=20), "gate"), own, assigned, axes).select("phase", "gap")


TERMS, CONFLICTS = ["tion", "k e i t", "Ment"], ["ung", "eau", "es/9"]
WAVE_ROLES = ["regulator", "standards_body", "brand_official", "media"]
RECORD = "\nGB/T 4706.25-2008 发布单位 实施日期"


def audit(t):
    # every eleventh page is made an official record, every thirteenth a PDF payload, every fifth is not accepted, and every third has no route
    n = F.col("page_id")
    text = F.concat(F.when(n % 13 == 0, " %PDF-1.4 ").otherwise(""), "html", F.when(n % 11 == 0, RECORD).otherwise(""))
    p = t("pages").select("page_id", "url", text.alias("text"), F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"), (n % 5 > 0).alias("accepted"))
    role = F.element_at(F.array(*map(F.lit, WAVE_ROLES)), (n % 4 + 1).cast("int"))
    routes = t("pages").where("page_id % 3 > 0").select(n.alias("ord"), F.col("url").alias("reference"), n.alias("route_id"), (n % 20).alias("task_id"), role.alias("role"))
    return W.verify_wave(p, routes, terms=TERMS, conflicts=CONFLICTS)


def wave_tasks(t):
    n = F.col("task_id")
    return t("pages").select((F.col("page_id") % 22).alias("task_id")).distinct().withColumns({"min_sources": n % 4, "min_roles": n % 3, "min_samples": (n % 5 == 4).cast("int"), "priority": F.when(n % 4 == 0, "critical").otherwise("normal")})


def _squeezed(c):
    return f"regexp_replace(lower({c}), '{SPACE}', '', 'g')"


_AUDIT = f"""(SELECT page_id, url, route_id, task_id, role, hits, conflicting, bin, over, CASE WHEN route_id IS NULL THEN 'route_missing' WHEN bin OR NOT (accepted OR over) THEN 'source_quality_rejected'
 WHEN hits < 2 OR len(conflicting) > 0 THEN 'category_relevance_mismatch' ELSE 'raw_candidate_relevant_not_evidence' END AS status
FROM (SELECT *, coalesce(role IN ('standards_body', 'regulator') AND hits >= 2 AND regexp_matches(body, '(?i)\\bGB(?:/T)?{SPACE}*\\d{{3,6}}(?:\\.\\d+)?-\\d{{4}}\\b') AND len(list_filter(['发布单位', '发布日期', '实施日期'], lambda x: contains(body, x))) >= 2, false) AS over
FROM (SELECT p.*, r.route_id, r.task_id, r.role, title || chr(10) || text AS body, starts_with(ltrim(text), '%PDF-') AS bin,
 CAST(list_sum(list_transform(['tion', 'keit', 'ment'], lambda x: len(string_split({_squeezed("title || chr(10) || text")}, x)) - 1)) AS BIGINT) AS hits,
 list_filter(['ung', 'eau', 'es/9'], lambda x: contains({_squeezed("title || chr(10) || url")}, x)) AS conflicting
FROM (SELECT page_id, url, page_id % 5 > 0 AS accepted, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, CASE WHEN page_id % 13 = 0 THEN ' %PDF-1.4 ' ELSE '' END || html || CASE WHEN page_id % 11 = 0 THEN chr(10) || 'GB/T 4706.25-2008 发布单位 实施日期' ELSE '' END AS text FROM pages) p
LEFT JOIN (SELECT c, max(page_id) AS route_id, max(page_id) % 20 AS task_id, list_extract(['regulator', 'standards_body', 'brand_official', 'media'], CAST(max(page_id) % 4 + 1 AS INTEGER)) AS role FROM (SELECT page_id, {sql_canonical('url')} AS c FROM pages WHERE page_id % 3 > 0) x WHERE c IS NOT NULL GROUP BY c) r ON r.c = {sql_canonical('p.url')}) a) b)"""
_WAVE_TASKS = "(SELECT task_id, task_id % 4 AS min_sources, task_id % 3 AS min_roles, task_id % 5 = 4 AS samples, CASE WHEN task_id % 4 = 0 THEN 'critical' ELSE 'normal' END AS priority FROM (SELECT DISTINCT page_id % 22 AS task_id FROM pages) q)"
_WAVE = f"""(SELECT *, CASE WHEN len(gaps) = 0 THEN 'raw_candidate_target_met_not_evidence' ELSE 'raw_candidate_gap' END AS status FROM (SELECT t.task_id, priority, coalesce(docs, 0) AS docs, coalesce(hosts, 0) AS hosts, coalesce(roles, 0) AS roles,
 list_filter([CASE WHEN coalesce(hosts, 0) < min_sources THEN 'independent_source_coverage_missing' END, CASE WHEN coalesce(roles, 0) < min_roles THEN 'source_role_coverage_missing' END, CASE WHEN samples THEN 'representative_sample_coverage_missing' END], lambda x: x IS NOT NULL) AS gaps
FROM {_WAVE_TASKS} t LEFT JOIN (SELECT task_id, count(*) AS docs, count(DISTINCT regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)), '^www\\.', '')) AS hosts, count(DISTINCT role) AS roles FROM {_AUDIT} a WHERE status = 'raw_candidate_relevant_not_evidence' GROUP BY task_id) g ON g.task_id = t.task_id) w)"""


@query("p15_verify_wave", f"SELECT page_id, route_id, task_id, role, hits, array_to_string(conflicting, ',') AS conflicting, bin AS \"binary\", over AS override, status FROM {_AUDIT} a")
def p15(t):
    return audit(t).select("page_id", "route_id", "task_id", "role", "hits", F.array_join("conflicting", ",").alias("conflicting"), "binary", "override", "status")


@query("p16_wave_coverage", f"SELECT task_id, docs, hosts, roles, array_to_string(gaps, ',') AS gaps, status FROM {_WAVE} w")
def p16(t):
    return W.wave_coverage(audit(t), wave_tasks(t)).withColumn("gaps", F.array_join("gaps", ","))


@query(
    "p16_wave_decision",
    f"""SELECT *, CASE WHEN critical_gaps = 0 THEN 'begin_m3_claim_extraction' ELSE 'continue_m2_4_targeted_waves' END AS next_action, CASE WHEN critical_gaps = 0 THEN 'critical_raw_candidate_coverage_met' ELSE 'critical_raw_candidate_coverage_gaps_remain' END AS reason
FROM (SELECT count(*) AS documents, count(*) FILTER (status = 'raw_candidate_relevant_not_evidence') AS relevant, count(*) FILTER (status = 'category_relevance_mismatch') AS mismatches, count(*) FILTER (status = 'source_quality_rejected') AS rejected, count(*) FILTER (status = 'route_missing') AS unrouted, count(*) FILTER (bin) AS binaries, count(*) FILTER (over) AS overrides FROM {_AUDIT} a) d,
(SELECT count(*) FILTER (len(gaps) = 0) AS met, count(*) FILTER (len(gaps) > 0) AS gaps, count(*) FILTER (len(gaps) = 0 AND priority = 'critical') AS critical_met, count(*) FILTER (len(gaps) > 0 AND priority = 'critical') AS critical_gaps FROM {_WAVE} w) c""",
)
def p16_decision(t):
    own = cut(audit(t).select("url", "role", "task_id", "binary", "override", "status"), "audit")
    todo = wave_tasks(t)
    return W.wave_decision(own, W.wave_coverage(own, todo), todo)


@query("p17_next_roles", "SELECT role FROM (SELECT n_name AS role, min(o_orderkey) AS first_ord FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name) q WHERE role NOT IN (SELECT n_name FROM nation WHERE n_nationkey % 3 = 0) ORDER BY first_ord, role LIMIT 8")
def p17(t):
    own = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("o_orderkey").alias("ord"), F.array("n_name").alias("roles"))
    return P.next_roles(own, t("nation").where("n_nationkey % 3 = 0").select(F.col("n_name").alias("role")))


@query("p18_final_coverage", f"""WITH m AS (SELECT * FROM {_MATRIX} m), h AS (SELECT i.plan, row_id, count(DISTINCT sample) AS samples FROM (SELECT plan, row_id, unnest(axis_items) AS item FROM m) i JOIN (SELECT DISTINCT o_orderpriority AS plan, l_suppkey AS sample, p_type AS item FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey) s ON s.plan = i.plan AND s.item = i.item GROUP BY i.plan, row_id)
SELECT m.plan, m.row_id, module, coalesce(samples, 0) AS samples, m.row_id % 2 + CASE WHEN coalesce(samples, 0) < min_samples THEN 1 ELSE 0 END AS gaps FROM m LEFT JOIN h ON h.plan = m.plan AND h.row_id = m.row_id""")
def p18(t):
    s = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("part"), F.col("p_partkey") == F.col("l_partkey")).select(F.col("o_orderpriority").alias("plan"), F.col("l_suppkey").alias("sample"), F.col("p_type").alias("item")).distinct()
    return P.final_coverage(matrix(t).withColumn("other_gaps", F.col("row_id") % 2), s, plan="plan")


@query("p19_usage_totals", "SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,6))) AS DOUBLE) AS l_extendedprice, CAST(sum(CAST(l_quantity AS DECIMAL(18,6))) AS DOUBLE) AS l_quantity FROM lineitem GROUP BY l_returnflag")
def p19(t):
    u = P.usage_totals(t("lineitem"), ["l_extendedprice", "l_quantity"], plan="l_returnflag")
    return u.select("l_returnflag", *(F.col(c).cast("double").alias(c) for c in ("l_extendedprice", "l_quantity")))


@query("p23_report_coverage", f"SELECT plan, count(*) AS total, count(*) FILTER (len(gaps) = 0) AS passed, count(*) FILTER (len(gaps) > 0) AS gap, count(*) FILTER (module IN (0, 2)) AS critical, count(*) FILTER (module IN (0, 2) AND len(gaps) = 0) AS critical_passed FROM {_TASKS} x GROUP BY plan")
def p23(t):
    rows = tasks(t).select("plan", F.when(F.size("gaps") == 0, "pass").otherwise("gap").alias("status"), F.when(F.col("module").isin(0, 2), "critical").otherwise("other").alias("priority"))
    return P.report_coverage(rows, plan="plan")


@query("p24_fill_targets")
def p24(t):
    c = assessed(t).where("status = 'eligible'").select(F.col("plan").cast("string").alias("run"), F.lit("candidate").alias("what"), F.col("ord").cast("long"), F.col("candidate").cast("long").alias("id"), U.hostname(F.col("url")).alias("host"), F.col("role").cast("string"), F.lit(0).alias("min_sources"), F.lit(0).alias("min_roles"))
    n = F.col("n_nationkey")
    todo = t("nation").where("n_regionkey < 2").select((n % 5).cast("string").alias("run"), F.lit("task").alias("what"), n.cast("long").alias("ord"), n.cast("long").alias("id"), F.lit("").alias("host"), F.lit("").alias("role"), (n % 3 + 1).cast("int").alias("min_sources"), (n % 2 + 1).cast("int").alias("min_roles"))
    return P.fill_targets(c.unionByName(todo))


@query("p24_targeted_wave")
def p24_wave(t):
    """The audit of p15 is the wave before; nations are tasks, pages are candidates."""
    n, k = F.col("page_id"), F.col("n_nationkey")
    roles = [*N.MARKET_ROLES, "regulator", "standards_body", "trusted_retail_channel"]
    role = lambda c: F.element_at(F.array(*map(F.lit, roles)), (c % len(roles) + 1).cast("int"))
    tasks = t("nation").select((k % 3).cast("long").alias("run"), k.cast("long").alias("task"), k.alias("ord"), F.when(F.col("n_regionkey") < 3, "critical").otherwise("high").alias("priority"), F.array(role(k), role(k + 3)).alias("roles"), (k % 5 + 1).alias("min_sources"), (k % 3).alias("min_roles"))
    candidates = t("pages").select((n % 3).alias("run"), n.alias("candidate"), n.alias("ord"), "url", role(n % 17).alias("role"))
    before = audit(t).select((F.col("task_id") % 3).alias("run"), F.col("task_id").alias("task"), "url", "role", "status")
    return N.targeted_wave(tasks, candidates, before)


_FRESH = f"(SELECT page_id, run, c FROM (SELECT page_id, page_id % 3 AS run, {sql_canonical('url')} AS c, row_number() OVER (PARTITION BY page_id % 3, coalesce({sql_canonical('url')}, url) ORDER BY page_id) AS k FROM pages) x WHERE k = 1)"


@query("p25_fresh_candidates", f"SELECT page_id, run FROM {_FRESH} f WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.page_id % 5 = 0 AND p.page_id % 2 = f.run AND coalesce({sql_canonical('p.url')}, '') = coalesce(f.c, ''))")
def p25_fresh(t):
    c = t("pages").select("page_id", (F.col("page_id") % 3).alias("run"), F.col("page_id").alias("ord"), "url")
    # a fifth of the pages is what two of the runs have from before
    return P.fresh_candidates(c, t("pages").where("page_id % 5 = 0").select((F.col("page_id") % 2).alias("run"), "url")).select("page_id", "run")


@query("p25_balance_tasks")
def p25(t):
    c = assessed(t).where("status = 'eligible'").select(F.col("plan").cast("string").alias("run"), F.col("ord").cast("long"), F.col("candidate").cast("long"), (F.col("role") % 5).alias("module"), "url")
    # URLs of every twelfth candidate are what the run before has
    c = P.fresh_candidates(c, c.where("candidate % 12 = 0").select("run", "url")).drop("url")
    load = t("orders").groupBy((F.col("o_custkey") % 25).alias("task")).agg((F.count("*") % 4).cast("long").alias("load"))
    todo = t("nation").select(F.col("n_nationkey").cast("long").alias("task"), F.col("n_regionkey").alias("module"), F.when(F.col("n_nationkey") % 3 == 0, "critical").otherwise("high").alias("priority")).join(load, "task")
    return P.balance_tasks(c.join(hinted(todo), "module").select("run", "ord", "candidate", "task", "priority", "load"))
