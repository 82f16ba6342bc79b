"""Queries of module results: a document is a claim and the evidence for it, nations are axis items, suppliers samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions.text import SPACE
from claimloom.operators import evidence as E
from claimloom.plans import modules as M
from claimloom.queries import query
from claimloom.queries.cleaning import sql_text
from claimloom.queries.evidence import sql_must, sql_norm, sql_terms
from claimloom.sources.scratch import cut, hinted

NAMES = list(M.SAMPLE_RELATIONSHIPS)
ROLES = ["market_fact", "product_fact", "consumer_need"]
KINDS = ["direct_competitor", "channel_actor", "content_actor", "supply_chain_actor", "business_model_analogy"]


def pick(values, n):
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def inputs(t):
    """Documents quote their words 4 to 12. Gaps are planted by id, so that each check has rows that it blocks."""
    n = F.col("doc_id")
    source_role = F.when(F.col("source") == "src0", "financial_report").when(F.col("source") != "src18", F.col("source"))
    claim_role = pick(ROLES, F.floor(n / 6))
    said = F.concat_ws(" ", F.slice(F.split(F.coalesce("text", F.lit("")), " "), 4, 9))
    d = t("documents").select("doc_id", "source", "lang", "text", said.alias("said"))
    sample = F.when(n % 2 == 0, n % 110)
    c = d.select(n.alias("claim"), F.when(n % 101 == 0, " ").otherwise(F.concat(F.lit("c"), n)).alias("claim_id"), pick(NAMES, n).alias("module"),
        F.when(n % 103 == 0, "").otherwise(F.concat("said", F.when(n % 31 == 0, " profit conversion industry-wide").otherwise(F.when(n % 53 == 0, " market share 77% of all customers").otherwise("")))).alias("statement"), claim_role.alias("claim_role"),
        F.when(n % 23 == 0, F.array().cast("array<bigint>")).when(n % 9 == 0, F.array(n, n + 1)).otherwise(F.array(n)).alias("evidence_ids"), sample.alias("sample"))
    own = hinted(t("supplier").select(F.col("s_suppkey").alias("sample"), F.col("s_nationkey").alias("_item")))
    c = c.join(own, "sample", "left").withColumn("items", F.array_compact(F.array((F.col("claim") % 26).cast("long"), F.col("_item").cast("long")))).withColumn("samples", F.array_compact(F.array("sample"))).drop("_item", "sample")
    e = d.select(n.alias("evidence_id"), F.when(n % 199 == 0, "zzqx words that no text holds zzqx").otherwise(F.col("said")).alias("quote"), F.when(n % 37 == 0, "src0").otherwise(F.col("source")).alias("source"),
        F.when(n % 43 == 0, n + 1).when(n % 47 == 0, F.lit(-1)).otherwise(n).alias("doc"), F.when(n % 29 == 0, "market_fact").otherwise(claim_role).alias("claim_role"), F.when(n % 31 == 0, "src1").alias("source_role"), (n % 17 > 0).alias("accepted"))
    docs = d.select(n.alias("doc"), "source", F.concat(F.lit("https://"), "source", F.lit(".example.com/"), n).alias("url"), "text", F.when(n % 41 > 0, source_role).alias("role"), F.col("lang").alias("doc_type"), (n % 7 > 0).alias("confirmable"))
    sources = d.where("source <> 'src19'").select("source", source_role.alias("role")).distinct()
    policy = sources.select(F.explode(F.array(*map(F.lit, ROLES))).alias("claim_role"), F.col("role").alias("source_role")).where("source_role is not null and source_role <> 'src7' and not (source_role = 'src5' and claim_role = 'product_fact')")
    module = F.posexplode(F.array(*map(F.lit, NAMES))).alias("m", "module")
    r = t("nation").groupBy(F.col("n_regionkey").alias("axis")).agg(F.array_sort(F.collect_list(F.col("n_nationkey").cast("long"))).alias("axis_items")).select("*", module).where("(m + axis) % 5 <> 0")
    r = r.select("module", (F.col("m") * 10 + F.col("axis")).alias("row_id"), "axis", "axis_items", (F.col("axis") % 2 + 1).alias("min_sources"), F.lit(1).alias("min_roles"), (F.col("m") % 2).alias("min_samples"))
    k = F.col("s_suppkey")
    samples = t("supplier").select(k.alias("sample"), pick(KINDS, k).alias("relationship"))
    assigned = t("supplier").join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey")).select(k.alias("sample"), F.col("n_regionkey").alias("axis"), F.col("n_nationkey").cast("long").alias("item"))
    may = t("region").limit(1).select(module).select("m", "module", F.posexplode(F.array(*map(F.lit, ROLES))).alias("k", "claim_role")).where("(m + k) % 3 <> 0").select("module", "claim_role")
    return c, e, docs, sources, {"rows": r, "samples": samples, "assignments": assigned, "module_roles": may, "policy": policy}


def judged(t):
    c, e, docs, sources, more = inputs(t)
    return c, cut(M.module_claims(c, e, docs, sources, **more), "judged"), more


def _pick(values, n):
    return f"list_extract([{', '.join(map(sql_text, values))}], CAST(({n}) % {len(values)} + 1 AS INTEGER))"


def _kept(checks):
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {code} END" for c, code in checks) + "], lambda x: x IS NOT NULL)"


_ROLE = "CASE WHEN source = 'src0' THEN 'financial_report' WHEN source <> 'src18' THEN source END"
_GATE = "CASE WHEN NOT {r} IN (SELECT r FROM src WHERE r IS NOT NULL AND r <> 'src7') THEN 'source_role_policy_missing' WHEN {r} = 'src5' AND {c} = 'product_fact' THEN 'source_role_not_authorized:' || {r} || ':' || {c} END"
_FITS = " OR ".join(f"(module = '{m}' AND rel IN ({', '.join(map(sql_text, r))}))" for m, r in M.SAMPLE_RELATIONSHIPS.items() if r)
SQL_JUDGED = f"""names AS (SELECT unnest({[*range(6)]}) AS m, unnest({NAMES}) AS module),
d AS MATERIALIZED (SELECT *, {sql_norm("coalesce(text, '')")} AS hay, {_ROLE} AS srole, array_to_string(string_split(coalesce(text, ''), ' ')[4:12], ' ') AS said, {_pick(ROLES, 'doc_id // 6')} AS claim_role FROM documents),
src AS MATERIALIZED (SELECT DISTINCT source, srole AS r FROM d WHERE source <> 'src19'),
rws AS (SELECT module, m * 10 + n_regionkey AS row_id, n_regionkey AS axis, list_sort(list(n_nationkey)) AS axis_items, n_regionkey % 2 + 1 AS min_sources, 1 AS min_roles, m % 2 AS min_samples FROM nation, names WHERE (m + n_regionkey) % 5 <> 0 GROUP BY module, m, n_regionkey),
c AS MATERIALIZED (SELECT doc_id AS claim, CASE WHEN doc_id % 101 = 0 THEN ' ' ELSE 'c' || doc_id END AS claim_id, {_pick(NAMES, 'doc_id')} AS module,
 CASE WHEN doc_id % 103 = 0 THEN '' ELSE said || CASE WHEN doc_id % 31 = 0 THEN ' profit conversion industry-wide' WHEN doc_id % 53 = 0 THEN ' market share 77% of all customers' ELSE '' END END AS statement, claim_role,
 CASE WHEN doc_id % 23 = 0 THEN [] WHEN doc_id % 9 = 0 THEN [doc_id, doc_id + 1] ELSE [doc_id] END AS evidence_ids, list_filter([doc_id % 26, s_nationkey], lambda x: x IS NOT NULL) AS items, CASE WHEN doc_id % 2 = 0 THEN doc_id % 110 END AS sample
 FROM d LEFT JOIN supplier ON doc_id % 2 = 0 AND s_suppkey = doc_id % 110),
e AS (SELECT doc_id AS eid, CASE WHEN doc_id % 199 = 0 THEN 'zzqx words that no text holds zzqx' ELSE said END AS quote, CASE WHEN doc_id % 37 = 0 THEN 'src0' ELSE source END AS source, CASE WHEN doc_id % 43 = 0 THEN doc_id + 1 WHEN doc_id % 47 = 0 THEN -1 ELSE doc_id END AS doc,
 CASE WHEN doc_id % 29 = 0 THEN 'market_fact' ELSE claim_role END AS own_role, CASE WHEN doc_id % 31 = 0 THEN 'src1' END AS erole, doc_id % 17 > 0 AS accepted FROM d),
e2 AS MATERIALIZED (SELECT e.*, x.source AS doc_source, 'https://' || x.source || '.example.com/' || x.doc_id AS url, CASE WHEN x.doc_id % 41 > 0 THEN x.srole END AS doc_role, x.lang AS doc_type, x.doc_id % 7 > 0 AS confirmable, x.doc_id IS NOT NULL AS has_doc, s.source IS NOT NULL AS has_source, s.r AS their_role,
 coalesce(length({sql_norm('e.quote')}) >= 4 AND contains(x.hay, {sql_norm('e.quote')}), false) AS held FROM e LEFT JOIN d x ON x.doc_id = e.doc LEFT JOIN src s ON s.source = e.source),
e3 AS MATERIALIZED (SELECT *, regexp_replace(quote, '^{SPACE}+|{SPACE}+$', '', 'g') AS q, {sql_norm('quote')} AS qn, held OR (length({sql_norm('quote')}) >= 4 AND EXISTS (SELECT 1 FROM d y WHERE contains(y.hay, {sql_norm('e2.quote')}))) AS any_doc,
 list_distinct(list_filter([erole, doc_role, their_role], lambda x: x IS NOT NULL)) AS known, coalesce(erole, doc_role, their_role) AS grole FROM e2),
a AS (SELECT c.claim, c.pos, c.statement, c.claim_role, e3.*, e3.eid IS NOT NULL AS found FROM (SELECT claim, statement, claim_role, unnest(evidence_ids) AS id, generate_subscripts(evidence_ids, 1) AS pos FROM c) c LEFT JOIN e3 ON e3.eid = c.id),
a2 AS (SELECT *, CASE WHEN len(known) = 0 THEN 'source_role_missing' WHEN len(known) > 1 THEN 'source_role_conflict' ELSE {_GATE.format(r='grole', c='own_role')} END AS role_failure,
 CASE WHEN NOT any_doc THEN 'quote_not_found_in_raw_documents' WHEN NOT held OR doc_source <> source THEN 'evidence_reference_mismatch' WHEN NOT confirmable THEN 'source_not_confirmable:' || coalesce(doc_type, 'unknown') WHEN doc_role IS NULL THEN 'source_role_missing' ELSE {_GATE.format(r='doc_role', c='claim_role')} END AS failure FROM a),
a3 AS MATERIALIZED (SELECT *, has_doc AND has_source AS both_, accepted AND role_failure IS NULL AS gated, CASE WHEN q = '' THEN ['missing_evidence_quote'] ELSE {_kept([
    ("failure IS NOT NULL", "failure"), ("(" + " OR ".join(f"regexp_matches(statement, {sql_text(p)})" for p in E.HIGH_RISK) + f") AND len(list_filter({sql_must('statement')}, lambda x: NOT contains(qn, x))) > 0", "'high_risk_claim_not_directly_quoted'"),
    (f"len({sql_terms('statement')}) > 0 AND len(list_filter({sql_terms('statement')}, lambda x: contains(qn || CASE WHEN failure IS NULL THEN ' ' || lower(url) || ' ' || source ELSE '' END, x))) < least(3, greatest(1, ceil(len({sql_terms('statement')}) * 0.35)))", "'important_claim_text_not_covered_by_quotes'"),
    (f"claim_role = 'consumer_need' AND regexp_matches(statement, '{E.DEMAND}') AND NOT regexp_matches(q, '{E.DIRECT_DEMAND}')", "'demand_inference_without_direct_user_evidence'")])} END AS reasons FROM a2),
good AS (SELECT claim, list_sort(list(DISTINCT source)) AS sources, list_sort(list(DISTINCT their_role)) AS source_roles FROM a3 WHERE found AND both_ AND gated AND len(reasons) = 0 AND their_role IS NOT NULL GROUP BY claim),
s AS (SELECT claim, module, items, sample, s_suppkey IS NOT NULL AS known, {_pick(KINDS, 's_suppkey')} AS rel, n_nationkey, EXISTS (SELECT 1 FROM rws WHERE rws.module = c.module AND rws.axis = n_regionkey) AS on_axis FROM c LEFT JOIN supplier ON s_suppkey = sample LEFT JOIN nation ON n_nationkey = s_nationkey WHERE sample IS NOT NULL),
f AS (SELECT claim, 0 AS phase, 0 AS pos, {_kept([
    ("trim(claim_id) = ''", "'claim_id_required'"), ("trim(statement) = ''", "'claim_statement_required'"), (f"(list_position({NAMES}, module) - 1 + list_position({ROLES}, claim_role) - 1) % 3 = 0", "'claim_role_not_allowed_for_module:' || claim_role"), ("len(evidence_ids) = 0", "'claim_evidence_required'")])} AS codes FROM c
 UNION ALL SELECT claim, 1, pos, ['unknown_axis_item:' || item] FROM (SELECT claim, module, unnest(items) AS item, generate_subscripts(items, 1) AS pos FROM c) i WHERE NOT EXISTS (SELECT 1 FROM rws WHERE rws.module = i.module AND list_contains(axis_items, item))
 UNION ALL SELECT claim, 2, 0, {_kept([("NOT known", "'unknown_representative_sample:' || sample"), (f"known AND NOT ({_FITS})", "'sample_relationship_not_allowed:' || sample"), ("known AND NOT (on_axis AND list_contains(items, n_nationkey))", "'sample_does_not_cover_claim_axis:' || sample")])} FROM s
 UNION ALL SELECT DISTINCT claim, 3, 0, ['claim_evidence_missing'] FROM a WHERE NOT found
 UNION ALL SELECT claim, 4, pos, {_kept([("own_role <> claim_role", "'evidence_claim_role_mismatch:' || eid"), ("NOT has_doc", "'raw_document_missing:' || eid"), ("NOT has_source", "'source_missing:' || eid"), ("has_doc AND doc_source <> source", "'evidence_raw_source_mismatch:' || eid"), ("both_ AND NOT gated", "coalesce(role_failure, 'evidence_role_gate_failed:' || eid)")])}
  || CASE WHEN both_ THEN list_transform(reasons, lambda r: 'evidence_validation_failed:' || eid || ':' || r) ELSE [] END FROM a3 WHERE found
 UNION ALL SELECT c.claim, 5, 0, {_kept([(f"module = 'content_and_traffic' AND regexp_matches(statement, '{M.CONVERSION}')", "'content_metrics_cannot_support_conversion_claim'"), (f"module = 'ecommerce_competitor_research' AND regexp_matches(statement, '{M.INDUSTRY_WIDE}')", "'brand_claim_cannot_be_industry_wide'"), (f"module = 'business_model_and_supply_chain' AND regexp_matches(statement, '{M.PROFIT}') AND NOT list_contains(coalesce(source_roles, []), 'financial_report')", "'profitability_requires_financial_report'")])} FROM c LEFT JOIN good ON good.claim = c.claim),
u AS (SELECT claim, code, min(phase * 10000 + pos * 100 + step) AS place FROM (SELECT claim, phase, pos, unnest(codes) AS code, generate_subscripts(codes, 1) AS step FROM f) x GROUP BY ALL),
judged AS MATERIALIZED (SELECT c.*, coalesce(sources, []) AS sources, coalesce(source_roles, []) AS source_roles, coalesce(failures, []) AS failures, CASE WHEN failures IS NULL THEN 'confirmed' ELSE 'blocked' END AS status FROM c LEFT JOIN good ON good.claim = c.claim LEFT JOIN (SELECT claim, list(code ORDER BY place) AS failures FROM u GROUP BY claim) l ON l.claim = c.claim)"""
SQL_COVERED = f"""{SQL_JUDGED},
ok AS (SELECT * FROM judged WHERE status = 'confirmed'),
named AS (SELECT r.*, o.claim, o.items, o.sample, o.sources AS their_sources, o.source_roles FROM rws r JOIN ok o ON o.module = r.module AND list_has_any(o.items, r.axis_items)),
gained AS (SELECT n.row_id, len(list_distinct(flatten(list(their_sources)))) AS sources, len(list_distinct(flatten(list(n.source_roles)))) AS roles, count(DISTINCT n.sample) AS samples, flatten(list(items)) AS said, coalesce(list(s_nationkey) FILTER (s_nationkey IS NOT NULL), []) AS sampled
 FROM named n LEFT JOIN (SELECT s_suppkey, s_nationkey, n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey) s ON s.s_suppkey = n.sample AND s.n_regionkey = n.axis GROUP BY n.row_id),
held AS (SELECT r.*, coalesce(sources, 0) AS sources, coalesce(roles, 0) AS roles, coalesce(samples, 0) AS samples, list_filter(axis_items, lambda x: list_contains(coalesce(said, []), x) AND (min_samples = 0 OR list_contains(coalesce(sampled, []), x))) AS covered FROM rws r LEFT JOIN gained g ON g.row_id = r.row_id),
covered AS (SELECT module, row_id, len(covered) AS covered, sources, roles, samples, {_kept([("sources < min_sources", "'independent_sources:' || sources || '/' || min_sources"), ("roles < min_roles", "'source_roles:' || roles || '/' || min_roles"), ("samples < min_samples", "'representative_samples:' || samples || '/' || min_samples"), ("len(covered) < len(axis_items)", "'uncovered_axis_items:' || array_to_string(list_filter(axis_items, lambda x: NOT list_contains(covered, x)), ',')")])} AS gaps FROM held)"""


@query("p20_module_claims", f"WITH {SQL_JUDGED} SELECT claim, module, status, array_to_string(failures, ',') AS failures, array_to_string(sources, ',') AS sources, array_to_string(source_roles, ',') AS source_roles FROM judged")
def p20(t):
    _, j, _ = judged(t)
    return j.select("claim", "module", "status", *(F.array_join(c, ",").alias(c) for c in ("failures", "sources", "source_roles")))


def covered(t):
    c, j, more = judged(t)
    ok = j.where("status = 'confirmed'").join(c.select("claim", "items", "samples").hint("merge"), "claim")
    return j, M.module_coverage(cut(ok, "confirmed"), more["rows"], more["assignments"])


@query("p21_module_coverage", f"WITH {SQL_COVERED} SELECT module, row_id, covered, sources, roles, samples, array_to_string(gaps, ',') AS gaps, CASE WHEN len(gaps) = 0 THEN 'pass' ELSE 'blocked' END AS status FROM covered")
def p21(t):
    return covered(t)[1].withColumn("gaps", F.array_join("gaps", ","))


@query("p22_module_status", f"WITH {SQL_COVERED} SELECT n.module, CASE WHEN NOT EXISTS (SELECT 1 FROM ok WHERE ok.module = n.module) THEN 'blocked_missing_evidence' WHEN NOT EXISTS (SELECT 1 FROM covered v WHERE v.module = n.module AND len(gaps) > 0) THEN 'complete' ELSE 'blocked_insufficient_coverage' END AS status FROM names n")
def p22(t):
    j, rows = covered(t)
    rows = cut(rows, "coverage")  # read twice
    return M.module_status(rows.select("module").distinct(), j, rows)
