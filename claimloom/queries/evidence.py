"""Queries of the evidence operators: benchmark items are quotes and claims, documents the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions.text import SPACE, normalize_text
from claimloom.operators import evidence as E
from claimloom.queries import query
from claimloom.queries.cleaning import sql_text


def sql_norm(c):
    return f"trim(regexp_replace(lower({c}), '{SPACE}+', ' ', 'g'))"


SQL_MATCH = f"""(SELECT item_id, doc_id FROM (SELECT item_id, {sql_norm('text')} AS quote FROM benchmark) b JOIN (SELECT doc_id, {sql_norm('text')} AS hay FROM documents) d ON length(quote) >= 4 AND contains(hay, quote))"""


def matches(t):
    return E.match_quotes(t("benchmark"), t("documents"), quote_id="item_id", doc_id="doc_id")


@query("e1_normalize_text", f"SELECT doc_id, md5({sql_norm('text')}) AS digest FROM documents")
def e1(t):
    return t("documents").select("doc_id", F.md5(normalize_text(F.col("text"))).alias("digest"))


@query("e2_match_quotes", f"SELECT item_id, doc_id FROM {SQL_MATCH} m")
def e2(t):
    return matches(t)


def referenced(t):
    """Matches with the quote's reference (a source for every third item) and the document's standing."""
    quotes = t("benchmark").select("item_id", F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("src"), F.col("item_id") % 20)).alias("ref_source"))
    docs = t("documents").join(t("labels"), "doc_id", "left").select("doc_id", "source", F.coalesce(F.col("quality") == 1, F.lit(True)).alias("confirmable"), F.col("lang").alias("doc_type"), F.when((F.col("toxic") == 1), "source_role_conflict").alias("role_failure"))
    m = matches(t).join(quotes, "item_id").join(docs, "doc_id")
    return m.withColumn("agrees", E.constrained(m, [("ref_source", "source")]))


_REF = f"""(SELECT m.item_id, m.doc_id AS doc, d.source, CASE WHEN m.item_id % 3 = 0 THEN 'src' || (m.item_id % 20) END AS ref_source, coalesce(l.quality = 1, true) AS confirmable, d.lang AS doc_type, CASE WHEN l.toxic = 1 THEN 'source_role_conflict' END AS role_failure
FROM {SQL_MATCH} m JOIN documents d ON d.doc_id = m.doc_id LEFT JOIN labels l ON l.doc_id = m.doc_id)"""


@query("e3_constrain_references", f"SELECT item_id, doc AS doc_id, ref_source IS NULL OR ref_source = source AS agrees FROM {_REF} r")
def e3(t):
    return referenced(t).select("item_id", "doc_id", "agrees")


_BOUND = f"""(SELECT b.item_id, CASE WHEN n_ok = 1 THEN one.doc END AS doc, CASE WHEN coalesce(n, 0) = 0 THEN 'quote_not_found_in_raw_documents' WHEN n_ok = 0 THEN 'evidence_reference_mismatch' WHEN n_ok > 1 THEN 'ambiguous_quote_match'
 WHEN NOT one.confirmable THEN 'source_not_confirmable:' || one.doc_type WHEN one.role_failure IS NOT NULL THEN one.role_failure END AS reason
FROM benchmark b LEFT JOIN (SELECT item_id, count(*) AS n, count(*) FILTER (agrees) AS n_ok, arg_min({{'doc': doc, 'confirmable': confirmable, 'doc_type': doc_type, 'role_failure': role_failure}}, doc) FILTER (agrees) AS one
 FROM (SELECT *, ref_source IS NULL OR ref_source = source AS agrees FROM {_REF} r) a GROUP BY item_id) g ON g.item_id = b.item_id)"""


def bound(t):
    return E.bind_unique(t("benchmark"), referenced(t).withColumn("doc", F.col("doc_id")), quote_id="item_id")


@query("e4_bind_unique", f"SELECT item_id, doc, reason FROM {_BOUND} x")
def e4(t):
    return bound(t)


def sql_terms(c):
    generic = ", ".join(sql_text(g) for g in E.GENERIC_TERMS)
    found = f"list_filter(regexp_extract_all({sql_norm(c)}, '[a-z][a-z0-9-]{{3,}}|\\p{{Han}}{{2,}}'), lambda x: x NOT IN ({generic}))"
    return f"list_transform(list_filter(list_zip({found}, range(1, len({found}) + 1)), lambda z: list_position({found}, z[1]) = z[2]), lambda z: z[1])[1:20]"


@query("e5_claim_terms", f"SELECT item_id, array_to_string({sql_terms('text')}, ' ') AS terms FROM benchmark")
def e5(t):
    return t("benchmark").select("item_id", F.array_join(E.claim_terms(F.col("text")), " ").alias("terms"))


_QUOTES = "(SELECT doc_id % 40 AS item_id, string_agg(text, chr(10) ORDER BY doc_id) AS joined FROM documents GROUP BY ALL)"


@query(
    "e6_claim_covered",
    f"""SELECT item_id, len(terms) = 0 OR len(list_filter(terms, lambda x: contains(hay, x))) >= least(3, greatest(1, ceil(len(terms) * 0.35))) AS covered
FROM (SELECT b.item_id, {sql_terms('b.text')} AS terms, {sql_norm('q.joined')} AS hay FROM benchmark b JOIN {_QUOTES} q ON q.item_id = b.item_id) x""",
)
def e6(t):
    return E.claims_covered(t("benchmark"), t("documents").select((F.col("doc_id") % 40).alias("item_id"), F.col("text").alias("quote")), claim_id="item_id")


@query("e7_high_risk_claim", "SELECT doc_id, " + " OR ".join(f"regexp_matches(text, {sql_text(p)})" for p in E.HIGH_RISK) + " AS high_risk FROM documents")
def e7(t):
    return t("documents").select("doc_id", E.high_risk(F.col("text")).alias("high_risk"))


_MUST = "(regexp_extract_all({0}, '" + E.NUMBER + "') || list_filter([{1}], lambda x: x <> ''))"


def sql_must(c):
    n = sql_norm(c)
    return _MUST.format(n, ", ".join(f"regexp_extract({n}, {sql_text('(' + p + ')')}, 1)" for p in E.MARKERS))


@query(
    "e8_high_risk_supported",
    f"""SELECT doc_id, coalesce(bool_or(len(list_filter(must, lambda x: NOT contains(quote, x))) = 0 AND quote IS NOT NULL), false) AS supported
FROM (SELECT c.doc_id, {sql_must("c.text")} AS must, {sql_norm('q.text')} AS quote FROM documents c LEFT JOIN documents q ON q.source = c.source AND q.doc_id = c.doc_id + 20) x GROUP BY doc_id""",
)
def e8(t):
    d = t("documents")
    quotes = d.select("source", (F.col("doc_id") - 20).alias("doc_id"), F.col("text").alias("quote"))
    quotes = quotes.join(d.select("doc_id", "source"), ["doc_id", "source"], "left_semi")
    return E.high_risk_supported(d.select("doc_id", "text"), quotes, claim_id="doc_id")


@query(
    "e9_demand_gate",
    """SELECT c.conv_id, infers, coalesce(direct, false) AS direct, NOT infers OR coalesce(direct, false) AS passes FROM (SELECT conv_id, bool_or(regexp_matches(text, '(?i)(tion|keit)')) AS infers FROM conversations WHERE role = 'assistant' GROUP BY conv_id) c
LEFT JOIN (SELECT conv_id, bool_or(regexp_matches(text, '(?i)(ment|heit|ing)')) AS direct FROM conversations WHERE role = 'user' GROUP BY conv_id) q ON q.conv_id = c.conv_id""",
)
def e9(t):
    c = t("conversations")
    return E.demand_gate(c.where("role = 'assistant'"), c.where("role = 'user'"), claim_id="conv_id", claim_col="text", quote_col="text", demand="(?i)(tion|keit)", direct="(?i)(ment|heit|ing)")


def claims(t):
    """Claims of five items each; the items are their quotes, every seventh claim has none."""
    b = t("benchmark")
    c = b.groupBy(F.floor(F.col("item_id") / 5).alias("claim_id")).agg(F.min_by("text", "item_id").alias("claim"), F.max_by("text", "item_id").alias("required"))
    quotes = bound(t).join(b, "item_id").select(F.floor(F.col("item_id") / 5).alias("claim_id"), "item_id", F.col("text").alias("quote"), "doc", "reason").where("claim_id % 7 <> 3")
    return c.withColumn("need_demand", F.col("claim_id") % 2 == 0), quotes


_CLAIMS = "(SELECT item_id // 5 AS claim_id, arg_min(text, item_id) AS claim, arg_max(text, item_id) AS required, (item_id // 5) % 2 = 0 AS need_demand FROM benchmark GROUP BY ALL)"
_VALID = f"""(SELECT claim_id, CASE WHEN quotes IS NULL THEN 'rejected' WHEN confirmed = quotes AND len(failures) = 0 THEN 'approved' ELSE 'needs_review' END AS status, coalesce(confirmed, 0) AS confirmed, failures
FROM (SELECT c.claim_id, quotes, confirmed, CASE WHEN quotes IS NULL THEN ['missing_evidence_quote'] ELSE list_sort(list_distinct(reasons
 || CASE WHEN ({' OR '.join(f"regexp_matches(claim, {sql_text(p)})" for p in E.HIGH_RISK)}) AND len(list_filter(each, lambda q: len(list_filter({sql_must('claim')}, lambda x: NOT contains(q, x))) = 0)) = 0 THEN ['high_risk_claim_not_directly_quoted'] ELSE [] END
 || CASE WHEN NOT (len({sql_terms('required')}) = 0 OR len(list_filter({sql_terms('required')}, lambda x: contains({sql_norm('joined')}, x))) >= least(3, greatest(1, ceil(len({sql_terms('required')}) * 0.35)))) THEN ['important_claim_text_not_covered_by_quotes'] ELSE [] END
 || CASE WHEN need_demand AND regexp_matches(claim, '{E.DEMAND}') AND NOT regexp_matches(joined, '{E.DIRECT_DEMAND}') THEN ['demand_inference_without_direct_user_evidence'] ELSE [] END)) END AS failures
FROM {_CLAIMS} c LEFT JOIN (SELECT x.item_id // 5 AS claim_id, count(*) AS quotes, count(*) FILTER (reason IS NULL) AS confirmed, coalesce(list(DISTINCT reason) FILTER (reason IS NOT NULL), []) AS reasons, string_agg(text, chr(10)) AS joined, list({sql_norm('text')}) AS each
 FROM {_BOUND} x JOIN benchmark b ON b.item_id = x.item_id WHERE (x.item_id // 5) % 7 <> 3 GROUP BY ALL) q ON q.claim_id = c.claim_id) z)"""


@query("e10_validate_claims", f"SELECT claim_id, status, confirmed, array_to_string(failures, ',') AS failures FROM {_VALID} v")
def e10(t):
    c, quotes = claims(t)
    return E.validate_claims(quotes, c, claim_id="claim_id").withColumn("failures", F.array_join("failures", ","))


_STATUS = "CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'approved' ELSE 'needs_review' END"


@query("e11_merge_status", f"SELECT status, count(*) AS n FROM (SELECT CASE WHEN v = 'rejected' THEN 'rejected' WHEN v = 'needs_review' THEN 'needs_review' WHEN m = 'approved' THEN 'approved' ELSE 'needs_review' END AS status FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN 'approved' ELSE 'needs_review' END AS m, {_STATUS} AS v FROM labels) a) b GROUP BY status")
def e11(t):
    v = F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "approved").otherwise("needs_review")
    return t("labels").select(E.merge_status(F.when(F.col("doc_id") % 2 == 0, "approved").otherwise("needs_review"), v).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


def role_policy(d):
    roles = d.select(F.col("source").alias("source_role")).distinct().withColumn("claim_role", F.explode(F.array(F.lit("market"), F.lit("product"), F.lit("user"))))
    return roles.where((F.length("source_role") + F.length("claim_role") != 10) & (F.col("source_role") != "src7"))


def gated(t):
    d = t("documents")
    doc = d.select("doc_id", F.when(F.col("doc_id") % 6 != 5, F.col("source")).alias("doc_role"), F.when(F.col("doc_id") % 13 == 0, "src1").alias("evidence_role"), F.when(F.col("doc_id") % 10 != 9, F.element_at(F.array(F.lit("market"), F.lit("product"), F.lit("user")), (F.col("doc_id") % 3 + 1).cast("int"))).alias("claim_role"))
    return E.role_gate(doc, role_policy(d), roles=["evidence_role", "doc_role"], claim_role="claim_role")


_ROLES = """(SELECT doc_id, CASE WHEN doc_id % 6 <> 5 THEN source END AS doc_role, CASE WHEN doc_id % 13 = 0 THEN 'src1' END AS evidence_role, CASE WHEN doc_id % 10 <> 9 THEN list_extract(['market', 'product', 'user'], CAST(doc_id % 3 + 1 AS INTEGER)) END AS claim_role FROM documents)"""
_POLICY = "(SELECT source_role, claim_role FROM (SELECT DISTINCT source AS source_role FROM documents) s CROSS JOIN (VALUES ('market'), ('product'), ('user')) c(claim_role) WHERE length(source_role) + length(claim_role) <> 10 AND source_role <> 'src7')"


@query(
    "e12_role_gate",
    f"""SELECT doc_id, role, CASE WHEN role IS NULL AND claim_role IS NULL THEN NULL WHEN role IS NULL THEN 'source_role_missing' WHEN evidence_role <> doc_role THEN 'source_role_conflict' WHEN claim_role IS NULL THEN 'claim_role_missing'
 WHEN NOT EXISTS (SELECT 1 FROM {_POLICY} p WHERE p.source_role = role) THEN 'source_role_policy_missing' WHEN NOT EXISTS (SELECT 1 FROM {_POLICY} p WHERE p.source_role = role AND p.claim_role = r.claim_role) THEN 'source_role_not_authorized:' || role || ':' || claim_role END AS role_failure
FROM (SELECT *, coalesce(evidence_role, doc_role) AS role FROM {_ROLES} q) r""",
)
def e12(t):
    return gated(t).select("doc_id", "role", "role_failure")


@query(
    "e13_bind_source_role",
    """SELECT doc_id, coalesce(s.role, d.role) AS role, coalesce(s.role <> d.role, false) AS conflict FROM (SELECT doc_id, source, CASE WHEN doc_id % 4 = 0 THEN lang END AS role FROM documents) d
LEFT JOIN (SELECT source, max(lang) AS role FROM documents WHERE source <> 'src3' GROUP BY source) s ON s.source = d.source""",
)
def e13(t):
    d = t("documents")
    return E.bind_source_role(d.select("doc_id", "source", F.when(F.col("doc_id") % 4 == 0, F.col("lang")).alias("role")), d.where("source <> 'src3'").groupBy("source").agg(F.max("lang").alias("role")), source_col="source").select("doc_id", "role", "conflict")


@query(
    "e14_lean_evidence",
    """SELECT doc_id, source, CAST(place AS INTEGER) AS place, coalesce(nullif(trim(CASE WHEN doc_id % 2 = 0 THEN substr(text, 1, 160) ELSE '' END), ''), nullif(trim(substr(text, 1, 500)), ''), '') AS quote
FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents) x WHERE place <= 12""",
)
def e14(t):
    d = t("documents").select("doc_id", "source", "text", F.when(F.col("doc_id") % 2 == 0, F.substring("text", 1, 160)).otherwise("").alias("excerpt"), F.lit("").alias("title"))
    return E.lean_evidence(d, run="source", order_col="doc_id").select("doc_id", "source", "place", "quote")


@query("e15_evidence_completeness", f"SELECT claim_id % 2 AS run, count(*) AS findings, count(*) FILTER (status = 'approved') AS complete, count(*) FILTER (status = 'approved') / CAST(count(*) AS DOUBLE) AS ratio FROM {_VALID} v GROUP BY ALL")
def e15(t):
    c, quotes = claims(t)
    return E.evidence_completeness(E.validate_claims(quotes, c, claim_id="claim_id").withColumn("run", F.col("claim_id") % 2), run="run")


@query(
    "e16_review_queue",
    f"""WITH ev AS (SELECT doc_id AS evidence_id, quality = 1 AND toxic = 0 AS complete, CASE WHEN doc_id % 3 = 0 THEN 'market' ELSE 'user' END AS claim_role FROM labels),
en AS (SELECT doc_id AS entity_id, list_extract(['competitor', 'product_signal', 'pain_point', 'content_signal', 'opportunity'], CAST(doc_id % 5 + 1 AS INTEGER)) AS kind, {_STATUS} AS own_status, e FROM (SELECT *, unnest([doc_id, doc_id + 1]) AS e FROM labels) q),
g AS (SELECT entity_id, kind, own_status, bool_and(coalesce(complete, false)) AS done, CASE WHEN count(DISTINCT claim_role) = 1 THEN max(claim_role) END AS claim_role FROM en LEFT JOIN ev ON ev.evidence_id = en.e GROUP BY ALL)
SELECT entity_id, kind, CASE WHEN kind = 'opportunity' AND own_status = 'rejected' THEN 'rejected' WHEN done AND (kind <> 'opportunity' OR own_status = 'approved') THEN 'approved' ELSE 'needs_review' END AS status, claim_role FROM g""",
)
def e16(t):
    labels = t("labels")
    own = F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "approved").otherwise("needs_review")
    kind = F.element_at(F.array(*map(F.lit, ("competitor", "product_signal", "pain_point", "content_signal", "opportunity"))), (F.col("doc_id") % 5 + 1).cast("int"))
    entities = labels.select(F.col("doc_id").alias("entity_id"), kind.alias("kind"), own.alias("own_status"), F.array("doc_id", F.col("doc_id") + 1).alias("evidence_ids"))
    evidence = labels.select(F.col("doc_id").alias("evidence_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("complete"), F.when(F.col("doc_id") % 3 == 0, "market").otherwise("user").alias("claim_role"))
    return E.review_queue(entities, evidence)


@query(
    "e17_accepted_evidence",
    f"""SELECT r.doc_id AS evidence_id, coalesce(r.evidence_role, r.doc_role, s.source_role) AS role FROM {_ROLES} r JOIN documents d ON d.doc_id = r.doc_id JOIN labels l ON l.doc_id = r.doc_id
LEFT JOIN (SELECT source, max(source) AS source_role FROM documents WHERE source NOT IN ('src4', 'src6') GROUP BY source) s ON s.source = d.source
WHERE l.quality = 1 AND l.toxic = 0 AND d.n_chars > 100 AND r.claim_role IS NOT NULL AND len(list_distinct(list_filter([r.evidence_role, r.doc_role, s.source_role], lambda x: x IS NOT NULL))) = 1
 AND EXISTS (SELECT 1 FROM {_POLICY} p WHERE p.source_role = coalesce(r.evidence_role, r.doc_role, s.source_role) AND p.claim_role = r.claim_role)
UNION ALL SELECT r.doc_id, NULL FROM {_ROLES} r JOIN documents d ON d.doc_id = r.doc_id JOIN labels l ON l.doc_id = r.doc_id
WHERE l.quality = 1 AND l.toxic = 0 AND d.n_chars > 100 AND r.claim_role IS NULL AND r.evidence_role IS NULL AND r.doc_role IS NULL AND d.source IN ('src4', 'src6')""",
)
def e17(t):
    d = t("documents")
    evidence = gated(t).select(F.col("doc_id").alias("evidence_id"), "doc_id", "claim_role", "evidence_role").join(t("labels"), "doc_id").join(d.select("doc_id", "source"), "doc_id")
    evidence = evidence.select("evidence_id", "doc_id", "source", F.lit(True).alias("matched"), (F.col("toxic") == 0).alias("source_ok"), (F.col("quality") == 1).alias("complete"), "claim_role", "evidence_role")
    docs = gated(t).select("doc_id", "doc_role").join(d.select("doc_id", (F.col("n_chars") > 100).alias("accepted"), F.concat(F.lit("u"), "doc_id").alias("url")), "doc_id")
    sources = d.where("source not in ('src4', 'src6')").groupBy("source").agg(F.max("source").alias("source_role"))
    return E.accepted_evidence(evidence, docs, sources, role_policy(d)).select("evidence_id", "role")
