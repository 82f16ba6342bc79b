"""Queries of the review operators: labelled documents are items and evidence, users are runs, parts are hypotheses."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions.text import SPACE
from claimloom.operators import atomic as A
from claimloom.operators import evidence as E
from claimloom.operators import review as R
from claimloom.queries import query
from claimloom.queries.cleaning import sql_text
from claimloom.queries.evidence import sql_must, sql_norm

_RISKY = " OR ".join(f"regexp_matches(claim, {sql_text(p)})" for p in E.HIGH_RISK)


def pick(column, *values):
    """One of ``values`` by ``column`` modulo their number."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(column) % len(values) + 1).cast("int"))


def sql_pick(column, *values):
    return f"list_extract([{', '.join(map(sql_text, values))}], CAST({column} % {len(values)} + 1 AS INTEGER))"


def sql_trim(c):
    return f"regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')"


# items are labelled documents; their evidence is the own document, the next one, and for some one far away
def items(t):
    status = F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "approved").otherwise("needs_review")
    ids = F.when(F.col("doc_id") % 7 == 0, F.array("doc_id", F.col("doc_id") + 1, "doc_id")).when(F.col("doc_id") % 7 == 1, F.array().cast("array<bigint>")).otherwise(F.array("doc_id"))
    return t("labels").select(F.col("doc_id").alias("item_id"), status.alias("status"), F.when(F.col("doc_id") % 4 == 0, pick("doc_id", "market", "user", "product")).alias("claim_role"), ids.alias("evidence_ids"))


def evidence(t):
    role = F.when(F.col("doc_id") % 8 != 4, pick("doc_id", "market", "user", "product"))
    return t("documents").select(F.col("doc_id").alias("evidence_id"), "doc_id", "source", (F.col("n_chars") > 80).alias("accepted"), role.alias("claim_role"), F.col("text").alias("quote"))


def claims(t):
    """The text of each item is a claim; of every third, that of the document after it, too."""
    d, labels = t("documents"), t("labels").select(F.col("doc_id").alias("item_id"))
    own = labels.withColumn("doc_id", F.col("item_id"))
    more = labels.where("item_id % 3 = 0").withColumn("doc_id", F.col("item_id") + 1)
    return own.union(more).join(d.select("doc_id", "text").hint("merge"), "doc_id").select("item_id", F.col("text").alias("claim"))


_ITEMS = f"""items AS (SELECT doc_id AS item_id, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'approved' ELSE 'needs_review' END AS status, CASE WHEN doc_id % 4 = 0 THEN {sql_pick('doc_id', 'market', 'user', 'product')} END AS claim_role,
 CASE WHEN doc_id % 7 = 0 THEN [doc_id, doc_id + 1, doc_id] WHEN doc_id % 7 = 1 THEN CAST([] AS BIGINT[]) ELSE [doc_id] END AS evidence_ids FROM labels)"""
_REST = f"""evidence AS (SELECT doc_id AS evidence_id, source, n_chars > 80 AS accepted, CASE WHEN doc_id % 8 <> 4 THEN {sql_pick('doc_id', 'market', 'user', 'product')} END AS claim_role, text AS quote FROM documents),
claims AS (SELECT item_id, text AS claim FROM (SELECT doc_id AS item_id, doc_id FROM labels UNION ALL SELECT doc_id, doc_id + 1 FROM labels WHERE doc_id % 3 = 0) l JOIN documents d ON d.doc_id = l.doc_id),
asked AS (SELECT DISTINCT item_id, claim_role, unnest(evidence_ids) AS evidence_id FROM items),
gate AS (SELECT item_id, bool_and(coalesce(e.accepted, false)) AS accepted, bool_and(a.claim_role IS NULL OR coalesce(e.claim_role = a.claim_role, false)) AS roles FROM asked a LEFT JOIN evidence e ON e.evidence_id = a.evidence_id GROUP BY item_id),
risky AS (SELECT item_id, claim, {sql_must('claim')} AS must FROM claims WHERE {_RISKY}),
own AS (SELECT item_id, {sql_norm('quote')} AS quote FROM asked a JOIN evidence e ON e.evidence_id = a.evidence_id WHERE e.accepted),
quoted AS (SELECT item_id, bool_and(held) AS quoted FROM (SELECT r.item_id, r.claim, bool_or(coalesce(quote IS NOT NULL AND len(list_filter(must, lambda x: NOT contains(quote, x))) = 0, false)) AS held FROM risky r LEFT JOIN own ON own.item_id = r.item_id GROUP BY ALL) h GROUP BY item_id),
done AS (SELECT i.item_id, i.status, coalesce(i.status = 'approved' AND g.accepted AND g.roles AND coalesce(q.quoted, true), false) AS confirmable FROM items i LEFT JOIN gate g ON g.item_id = i.item_id LEFT JOIN quoted q ON q.item_id = i.item_id)"""


@query("e18_confirmable", f"WITH {_ITEMS}, {_REST} SELECT item_id, confirmable FROM done")
def e18(t):
    return R.confirmable(items(t), evidence(t), claims(t))


@query(
    "e19_credibility_metrics",
    f"""WITH {_ITEMS}, {_REST}, run_of AS (SELECT doc_id, source AS run FROM documents),
a AS (SELECT source AS run, count(*) AS crawled_documents, count(*) FILTER (l.quality = 0) AS low_quality_sources FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY source),
b AS (SELECT source AS run, count(*) FILTER (accepted) AS effective_evidence FROM evidence GROUP BY source),
c AS (SELECT run, count(*) FILTER (confirmable) AS confirmed_findings, count(*) FILTER (status <> 'rejected' AND NOT confirmable) AS needs_review_findings FROM done JOIN run_of ON doc_id = item_id GROUP BY run),
d AS (SELECT 'src' || (user_id % 25) AS run, count(*) FILTER (event_type = 'error') AS crawl_failures, bool_or(event_type = 'signup' AND value > 200) AS llm_fallback FROM events GROUP BY ALL)
SELECT run, coalesce(crawled_documents, 0) AS crawled_documents, coalesce(low_quality_sources, 0) AS low_quality_sources, coalesce(effective_evidence, 0) AS effective_evidence, coalesce(confirmed_findings, 0) AS confirmed_findings,
 coalesce(needs_review_findings, 0) AS needs_review_findings, coalesce(crawl_failures, 0) AS crawl_failures, coalesce(llm_fallback, false) AS llm_fallback
FROM a FULL JOIN b USING (run) FULL JOIN c USING (run) FULL JOIN d USING (run)""",
)
def e19(t):
    d, labels = t("documents"), t("labels")
    run_of = d.select(F.col("doc_id").alias("item_id"), F.col("source").alias("run"))
    docs = d.select("doc_id", F.col("source").alias("run")).join(labels.hint("merge"), "doc_id", "left").select("run", F.coalesce(F.col("quality") == 0, F.lit(False)).alias("low_quality"))
    reviewed = items(t).join(R.confirmable(items(t), evidence(t), claims(t)).hint("merge"), "item_id").join(run_of.hint("merge"), "item_id")
    crawls = t("events").select(F.concat(F.lit("src"), F.col("user_id") % 25).alias("run"), (F.col("event_type") == "error").alias("failed"), ((F.col("event_type") == "signup") & (F.col("value") > 200)).alias("fallback"))
    return R.credibility_metrics(docs, evidence(t).select(F.col("source").alias("run"), "accepted"), reviewed, crawls, run="run")


@query(
    "e20_quote_context",
    f"""WITH e AS (SELECT doc_id AS evidence_id, CASE WHEN doc_id % 5 = 4 THEN -1 ELSE doc_id END AS doc_id, source, CASE WHEN doc_id % 2 = 0 THEN substr(d.text, 131, 80) WHEN doc_id % 3 = 0 THEN substr(d.text, 31, 60) || ' zz' ELSE b.text END AS quote FROM documents d LEFT JOIN benchmark b ON b.item_id = doc_id % 40),
n AS (SELECT evidence_id, quote, coalesce(d.doc_id, f.first) AS doc FROM e LEFT JOIN (SELECT doc_id FROM documents) d ON d.doc_id = e.doc_id LEFT JOIN (SELECT source, min(doc_id) AS first FROM documents GROUP BY source) f ON f.source = e.source),
w AS (SELECT evidence_id, doc, d.text, d.lang AS excerpt, coalesce(quote, '') AS quote, list_filter(regexp_split_to_array({sql_trim("coalesce(quote, '')")}, '{SPACE}+'), lambda x: x <> '') AS words FROM n LEFT JOIN documents d ON d.doc_id = n.doc),
p AS (SELECT *, strpos(text, quote) AS exact, strpos(lower(text), lower(words[1])) AS near FROM w)
SELECT evidence_id, doc AS doc_id, coalesce(nullif(CASE WHEN len(words) = 0 OR text IS NULL THEN '' WHEN exact > 0 THEN {sql_trim('substr(text, greatest(1, exact - 100), exact + length(quote) + 100 - greatest(1, exact - 100))')}
 WHEN len(words) > 1 AND near > 0 THEN {sql_trim('substr(text, greatest(1, near - 100), near + 360 - greatest(1, near - 100))')} ELSE '' END, ''), excerpt, '') AS context FROM p""",
)
def e20(t):
    d = t("documents")
    b = t("benchmark").select("item_id", F.col("text").alias("item"))
    quote = F.when(F.col("doc_id") % 2 == 0, F.substring("text", 131, 80)).when(F.col("doc_id") % 3 == 0, F.concat(F.substring("text", 31, 60), F.lit(" zz"))).otherwise(F.col("item"))
    own = d.join(b.hint("merge"), F.col("doc_id") % 40 == F.col("item_id"), "left")
    own = own.select(F.col("doc_id").alias("evidence_id"), F.when(F.col("doc_id") % 5 == 4, -1).otherwise(F.col("doc_id")).alias("doc_id"), "source", quote.alias("quote"))
    return R.quote_context(own, d.select("doc_id", "source", "text", F.col("lang").alias("excerpt")))


@query(
    "e21_evidence_lookup",
    """WITH asked AS (SELECT entity_id, k.pos, k.id AS evidence_id FROM (SELECT doc_id AS entity_id, unnest(list_transform(range(0, 8), lambda i: {'pos': i, 'id': doc_id + i * i * (CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 500000000 END)})) AS k FROM documents) x),
found AS (SELECT a.entity_id, a.evidence_id, d.source, d.lang, d.doc_id, md5(d.text) AS quote, row_number() OVER (PARTITION BY a.entity_id ORDER BY pos) AS place FROM asked a JOIN documents d ON d.doc_id = a.evidence_id)
SELECT entity_id, CAST(place AS INTEGER) AS place, evidence_id, quote, CASE WHEN doc_id % 3 > 0 THEN 'https://' || source || '/' || doc_id ELSE s.value END AS url, coalesce(s.source_title, CASE WHEN doc_id % 3 > 0 THEN 'd' || doc_id END) AS source, CASE WHEN doc_id % 3 > 0 THEN lang END AS reliability
FROM found f LEFT JOIN (SELECT DISTINCT source AS source_id, 'https://' || source AS value, upper(source) AS source_title FROM documents WHERE source <> 'src3') s ON s.source_id = f.source WHERE place <= 6""",
)
def e21(t):
    d = t("documents")
    ids = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long")), lambda i: F.col("doc_id") + i * i * F.when(F.col("doc_id") % 2 == 0, 1).otherwise(500000000))
    docs = d.where("doc_id % 3 > 0").select("doc_id", F.concat(F.lit("https://"), "source", F.lit("/"), "doc_id").alias("url"), F.concat(F.lit("d"), "doc_id").alias("title"), F.col("lang").alias("source_type"))
    sources = d.where("source <> 'src3'").select(F.col("source").alias("source_id"), F.concat(F.lit("https://"), "source").alias("value"), F.upper("source").alias("source_title")).distinct()
    own = d.select(F.col("doc_id").alias("evidence_id"), "doc_id", F.col("source").alias("source_id"), F.md5("text").alias("quote"))
    return R.evidence_lookup(d.select(F.col("doc_id").alias("entity_id"), ids.alias("evidence_ids")), own, docs, sources)


# every document is a page of its source's host; candidates state its first sentence, or parts that break a rule
_ROLES = ("market", "user", "product")
_URL = "'https://' || source || '.example/' || doc_id"
_FIRST = "regexp_extract(text, '^[^.!?]*[.!?]?', 0)"
_ATOMIC = f"""docs AS (SELECT doc_id AS place, {_URL} AS url, doc_id, text, source FROM documents),
candidates AS (SELECT doc_id AS place, CASE WHEN doc_id % 11 = 0 THEN 'again' WHEN doc_id % 17 = 0 THEN ' ' ELSE 'c' || doc_id END AS candidate_id,
 CASE doc_id % 13 WHEN 1 THEN 'ab' WHEN 2 THEN '蓝海' || {_FIRST} WHEN 3 THEN {_FIRST} || '! ok?' WHEN 4 THEN '此外' || {_FIRST} ELSE {_FIRST} END AS statement, {sql_pick('doc_id', *_ROLES)} AS claim_role,
 CASE WHEN doc_id % 19 = 0 THEN 'ftp://x' ELSE {_URL} END AS url, CASE doc_id % 10 WHEN 6 THEN '' WHEN 7 THEN {_FIRST} || 'x y z' ELSE {_FIRST} END AS quote FROM documents),
relevant AS (SELECT {_URL} AS url, CASE WHEN doc_id % 23 = 0 THEN 'other' ELSE lang END AS source_role, 'task-' || lang AS task_id FROM documents WHERE n_chars > 60),
routes AS (SELECT {_URL} AS url, 'task-' || lang AS task_id, 'route-' || doc_id AS route_id, lang AS source_role FROM documents WHERE doc_id % 29 > 0),
stored AS (SELECT {_URL} AS url, 'raw-' || doc_id AS document_id, 'task-' || lang AS task_id, CASE WHEN doc_id % 31 = 0 THEN 'route-0' ELSE 'route-' || doc_id END AS route_id, lang AS source_role FROM documents WHERE doc_id % 37 > 0),
tasks AS (SELECT DISTINCT 'task-' || lang AS task_id, 'row-' || lang AS coverage_row, CASE WHEN lang = 'es' THEN ['market', 'user'] ELSE ['market', 'user', 'product'] END AS target_roles FROM documents WHERE lang <> 'de'),
policy AS (SELECT DISTINCT lang AS source_role, r AS claim_role FROM documents CROSS JOIN (VALUES ('market'), ('user'), ('product')) v(r) WHERE NOT (lang = 'fr' AND r = 'user'))"""


def sql_bare(c):
    return f"regexp_replace(regexp_replace({c}, '{SPACE}+', '', 'g'), '[。；;]$', '')"


_ST = sql_trim("c.statement")
_TESTS = [
    (f"length({_ST}) < 4", "atomic_statement_too_short"), (f"length({_ST}) > 180", "atomic_statement_too_long"), (f"regexp_matches({_ST}, '{A.DECISION}')", "commercialization_decision_forbidden"),
    (f"regexp_matches({_ST}, '{A.COMPOUND}')", "compound_statement_requires_split"), (f"len(regexp_extract_all({_ST}, '{A.SENTENCE_END}')) > 1", "multiple_sentences_require_split"),
    (f"{sql_trim('c.candidate_id')} = ''", "candidate_id_required"), ("again > 1", "candidate_id_duplicate"), ("c.url = 'ftp://x'", "candidate_source_url_invalid"), ("v.url IS NULL", "m2_strong_relevance_gate_failed"),
    ("d.url IS NULL", "extracted_raw_document_missing"), ("r.url IS NULL", "acquisition_route_missing"), ("s.url IS NULL", "immutable_raw_document_missing"), ("k.task_id IS NULL", "acquisition_task_missing"),
    ("r.source_role <> v.source_role", "m2_source_role_mismatch"), ("s.task_id <> r.task_id OR s.route_id <> r.route_id OR s.source_role <> r.source_role", "immutable_route_binding_mismatch"),
    ("NOT list_contains(k.target_roles, c.claim_role)", "claim_role_not_targeted_by_task"), ("r.url IS NOT NULL AND p.source_role IS NULL", "source_role_not_authorized_for_claim_role"),
    (f"{sql_trim('c.quote')} = ''", "quote_required"), ("d.url IS NULL OR strpos(d.text, c.quote) = 0", "quote_not_exactly_matched"),
    (f"c.quote <> '' AND NOT contains({sql_bare('c.quote')}, {sql_bare('c.statement')})", "statement_not_directly_supported_by_quote"),
]
_CLAIMED = f"""judged AS (SELECT c.*, {_ST} AS said, list_filter([{', '.join(f"CASE WHEN {x} THEN '{code}' END" for x, code in _TESTS)}], lambda x: x IS NOT NULL) AS failures, k.coverage_row, k.task_id, s.document_id, r.source_role, d.doc_id, sha256(d.text) AS content_hash, strpos(d.text, c.quote) - 1 AS quote_start
 FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY place) AS again FROM candidates) c LEFT JOIN relevant v ON v.url = c.url LEFT JOIN docs d ON d.url = c.url LEFT JOIN routes r ON r.url = c.url LEFT JOIN stored s ON s.url = c.url
 LEFT JOIN tasks k ON k.task_id = r.task_id LEFT JOIN policy p ON p.source_role = r.source_role AND p.claim_role = c.claim_role)"""


def atomic_tables(t):
    d = t("documents")
    url = F.concat(F.lit("https://"), "source", F.lit(".example/"), "doc_id")
    n, first, task = F.col("doc_id"), F.regexp_extract("text", "^[^.!?]*[.!?]?", 0), F.concat(F.lit("task-"), "lang")
    statement = F.when(n % 13 == 1, "ab").when(n % 13 == 2, F.concat(F.lit("蓝海"), first)).when(n % 13 == 3, F.concat(first, F.lit("! ok?"))).when(n % 13 == 4, F.concat(F.lit("此外"), first)).otherwise(first)
    quote = F.when(n % 10 == 6, "").when(n % 10 == 7, F.concat(first, F.lit("x y z"))).otherwise(first)
    ids = F.when(n % 11 == 0, "again").when(n % 17 == 0, " ").otherwise(F.concat(F.lit("c"), n))
    candidates = d.select(n.alias("place"), ids.alias("candidate_id"), statement.alias("statement"), pick("doc_id", *_ROLES).alias("claim_role"), F.when(n % 19 == 0, "ftp://x").otherwise(url).alias("url"), quote.alias("quote"))
    docs = d.select(n.alias("place"), url.alias("url"), "doc_id", "text")
    relevant = d.where("n_chars > 60").select(n.alias("place"), url.alias("url"), F.when(n % 23 == 0, "other").otherwise(F.col("lang")).alias("source_role"), task.alias("task_id"))
    routes = d.where("doc_id % 29 > 0").select(n.alias("place"), url.alias("url"), task.alias("task_id"), F.concat(F.lit("route-"), n).alias("route_id"), F.col("lang").alias("source_role"))
    route_id = F.when(n % 31 == 0, "route-0").otherwise(F.concat(F.lit("route-"), n))
    stored = d.where("doc_id % 37 > 0").select(n.alias("place"), url.alias("url"), F.concat(F.lit("raw-"), n).alias("document_id"), task.alias("task_id"), route_id.alias("route_id"), F.col("lang").alias("source_role"))
    langs = d.select("lang").distinct()
    targets = F.when(F.col("lang") == "es", F.array(F.lit("market"), F.lit("user"))).otherwise(F.array(*map(F.lit, _ROLES)))
    tasks = langs.where("lang <> 'de'").select(task.alias("task_id"), F.concat(F.lit("row-"), "lang").alias("coverage_row"), targets.alias("target_roles"))
    policy = langs.select(F.col("lang").alias("source_role"), F.explode(F.array(*map(F.lit, _ROLES))).alias("claim_role")).where("not (source_role = 'fr' and claim_role = 'user')")
    return candidates, docs, relevant, routes, stored, tasks, policy


@query(
    "e22_atomic_claims",
    f"""WITH {_ATOMIC}, {_CLAIMED} SELECT place, array_to_string(failures, ',') AS failures, CASE WHEN len(failures) = 0 THEN coverage_row END AS coverage_row, CASE WHEN len(failures) = 0 THEN document_id END AS document_id,
 CASE WHEN len(failures) = 0 THEN content_hash END AS content_hash, CASE WHEN len(failures) = 0 THEN quote_start END AS quote_start, CASE WHEN len(failures) = 0 THEN quote_start + length(quote) END AS quote_end FROM judged""",
)
def e22(t):
    candidates, docs, relevant, routes, stored, tasks, policy = atomic_tables(t)
    out = A.atomic_claims(candidates, docs, relevant.drop("task_id"), routes, stored, tasks, policy)
    return out.select("place", F.array_join("failures", ",").alias("failures"), "coverage_row", "document_id", "content_hash", "quote_start", "quote_end")


@query(
    "e23_audit_claims",
    f"""WITH {_ATOMIC}, {_CLAIMED},
claims AS (SELECT place AS claim_id, said AS statement, claim_role, CASE WHEN place % 5 = 1 THEN 'other' ELSE source_role END AS source_role, task_id, document_id, CASE WHEN place % 5 = 2 THEN sha256('x') ELSE content_hash END AS content_hash, url, quote,
 CASE WHEN place % 5 = 3 THEN quote_start + 1 ELSE quote_start END AS quote_start, quote_start + length(quote) AS quote_end FROM judged WHERE len(failures) = 0)
SELECT claim_id, CASE WHEN NOT coalesce(s.url = c.url AND s.source_role = c.source_role AND s.task_id = c.task_id, false) THEN 'immutable_binding_mismatch' WHEN d.url IS NULL THEN 'extracted_version_not_unique'
 WHEN c.quote_end - c.quote_start <> length(c.quote) OR substr(d.text, c.quote_start + 1, c.quote_end - c.quote_start) <> c.quote THEN 'quote_offsets_mismatch' WHEN NOT contains({sql_bare('c.quote')}, {sql_bare('c.statement')}) THEN 'statement_not_directly_supported'
 WHEN p.source_role IS NULL THEN 'source_role_not_authorized' WHEN v.url IS NULL THEN 'm2_relevance_binding_missing' END AS failure
FROM claims c LEFT JOIN stored s ON s.document_id = c.document_id LEFT JOIN docs d ON d.url = c.url AND sha256(d.text) = c.content_hash LEFT JOIN policy p ON p.source_role = c.source_role AND p.claim_role = c.claim_role LEFT JOIN relevant v ON v.url = c.url AND v.source_role = c.source_role AND v.task_id = c.task_id""",
)
def e23(t):
    candidates, docs, relevant, routes, stored, tasks, policy = atomic_tables(t)
    c = A.atomic_claims(candidates, docs, relevant.drop("task_id"), routes, stored, tasks, policy).where(F.size("failures") == 0)
    n = F.col("place")
    c = c.withColumns({"source_role": F.when(n % 5 == 1, "other").otherwise(F.col("source_role")), "content_hash": F.when(n % 5 == 2, F.sha2(F.lit("x"), 256)).otherwise(F.col("content_hash")), "quote_start": F.when(n % 5 == 3, F.col("quote_start") + 1).otherwise(F.col("quote_start"))})
    return A.audit_claims(c.withColumnRenamed("place", "claim_id"), docs, stored, relevant, policy)


@query(
    "e24_spot_check",
    f"""WITH roles AS (SELECT DISTINCT {sql_pick('doc_id', *_ROLES)} || '-' || lang AS claim_role FROM documents), first AS (SELECT {sql_pick('doc_id', *_ROLES)} || '-' || d.lang AS claim_role, min(doc_id) AS claim_id FROM documents d JOIN labels l USING (doc_id) WHERE quality = 1 AND lang <> 'fr' GROUP BY ALL)
SELECT claim_role, claim_id, CASE WHEN claim_id IS NULL THEN 'representative_claim_role_missing:' || claim_role END AS failure FROM roles LEFT JOIN first USING (claim_role)""",
)
def e24(t):
    role = F.concat(pick("doc_id", *_ROLES), F.lit("-"), "lang").alias("claim_role")
    good = t("documents").join(t("labels").where("quality = 1").hint("merge"), "doc_id").where("lang <> 'fr'")
    return A.spot_check(good.select(F.col("doc_id").alias("place"), F.col("doc_id").alias("claim_id"), role), t("documents").select(role).distinct())


_GATE = [
    ("trim(hypothesis_id) = ''", "hypothesis_id_required"), (f"NOT starts_with(title, '{A.UNVERIFIED}')", "hypothesis_title_must_be_explicitly_unverified"), (f"NOT regexp_matches(statement, '{A.UNCERTAINTY}')", "hypothesis_uncertainty_language_required"),
    (f"regexp_matches(title || chr(10) || statement || chr(10) || problem, '{A.CERTAINTY}')", "commercialization_or_certainty_conclusion_forbidden"), ("length(trim(target_user)) < 6", "target_user_not_specific"), ("length(trim(problem)) < 8", "target_problem_not_specific"),
    ("len(claim_ids) = 0", "supporting_atomic_claim_required"),
]
_FILLED = "len({0}) = 0 OR len(list_filter({0}, lambda x: trim(x) = '')) > 0"
_PLAN = [
    (_FILLED.format("assumptions"), "hypothesis_assumptions_required"), ("len(unknowns) < 2 OR " + _FILLED.format("unknowns"), "at_least_two_unknowns_required"), ("trim(method) = '' OR trim(participants) = ''", "validation_method_and_participant_profile_required"),
    ("sample_size IS NULL OR sample_size < 3", "validation_minimum_sample_size_below_3"), (_FILLED.format("steps"), "validation_steps_required"), (_FILLED.format("success"), "validation_success_criteria_required"), (_FILLED.format("failure"), "validation_failure_criteria_required"),
    ("len(list_filter(success || failure, lambda x: NOT regexp_matches(x, '[0-9]'))) > 0", "validation_criteria_must_be_measurable"), (_FILLED.format("stops"), "validation_stop_conditions_required"),
    ("permission <> 'L5' OR execution <> 'not_started'", "validation_must_remain_not_started_behind_L5"), ("again > 1", "hypothesis_id_duplicate"),
]


def _list(tests):
    return "list_filter([" + ", ".join(f"CASE WHEN {x} THEN '{code}' END" for x, code in tests) + "], lambda x: x IS NOT NULL)"


@query(
    "e25_hypothesis_gate",
    f"""WITH c AS (SELECT p_partkey AS place, CASE WHEN p_partkey % 50 = 0 THEN '' WHEN p_partkey % 9 = 0 THEN p_type ELSE 'h' || p_partkey END AS hypothesis_id, CASE WHEN p_partkey % 8 = 0 THEN p_name ELSE '待验证：' || p_name END AS title,
 CASE p_partkey % 6 WHEN 0 THEN p_type WHEN 1 THEN '如果' || p_type || '那么' WHEN 2 THEN '必然可能' ELSE '可能' || p_type END AS statement, CASE WHEN p_size = 1 THEN 'short' ELSE p_name END AS problem, CASE WHEN p_size = 2 THEN ' x   ' ELSE p_brand END AS target_user,
 list_transform(range(0, p_partkey % 4), lambda i: 'o' || (p_partkey * 3 + i * 37)) AS claim_ids, CASE WHEN p_size % 7 = 0 THEN CAST([] AS VARCHAR[]) ELSE [p_type] END AS assumptions, CASE WHEN p_size % 5 = 0 THEN [p_type] WHEN p_size % 5 = 1 THEN [p_type, ' '] ELSE [p_type, p_name] END AS unknowns,
 CASE WHEN p_size = 3 THEN ' ' ELSE 'interview' END AS method, 'owners' AS participants, p_size % 11 AS sample_size, ['a', 'b'] AS steps, ['at least ' || p_size] AS success, CASE WHEN p_size % 6 = 0 THEN ['few'] ELSE ['under 2'] END AS failure, ['stop'] AS stops,
 CASE WHEN p_size = 4 THEN 'L4' ELSE 'L5' END AS permission, 'not_started' AS execution FROM part),
claims AS (SELECT DISTINCT 'o' || l_partkey AS claim_id FROM lineitem WHERE l_quantity > 48),
missing AS (SELECT place, list('supporting_atomic_claim_missing:' || claim_id ORDER BY pos) AS missing FROM (SELECT place, unnest(claim_ids) AS claim_id, unnest(range(0, len(claim_ids))) AS pos FROM c) a WHERE claim_id NOT IN (SELECT claim_id FROM claims) GROUP BY place)
SELECT x.place, hypothesis_id, array_to_string({_list(_GATE)} || coalesce(missing, CAST([] AS VARCHAR[])) || {_list(_PLAN)}, ',') AS failures FROM (SELECT *, row_number() OVER (PARTITION BY hypothesis_id ORDER BY place) AS again FROM c) x LEFT JOIN missing m ON m.place = x.place""",
)
def e25(t):
    n, size = F.col("p_partkey"), F.col("p_size")
    words = lambda *x: F.array(*(F.col(c) if c.startswith("p_") else F.lit(c) for c in x))
    c = t("part").select(
        n.alias("place"), F.when(n % 50 == 0, "").when(n % 9 == 0, F.col("p_type")).otherwise(F.concat(F.lit("h"), n)).alias("hypothesis_id"),
        F.when(n % 8 == 0, F.col("p_name")).otherwise(F.concat(F.lit(A.UNVERIFIED), "p_name")).alias("title"),
        F.when(n % 6 == 0, F.col("p_type")).when(n % 6 == 1, F.concat(F.lit("如果"), "p_type", F.lit("那么"))).when(n % 6 == 2, "必然可能").otherwise(F.concat(F.lit("可能"), "p_type")).alias("statement"),
        F.when(size == 1, "short").otherwise(F.col("p_name")).alias("problem"), F.when(size == 2, " x   ").otherwise(F.col("p_brand")).alias("target_user"),
        F.transform(F.slice(F.array(*map(F.lit, range(3))), F.lit(1), (n % 4).cast("int")), lambda i: F.concat(F.lit("o"), n * 3 + i * 37)).alias("claim_ids"),
        F.when(size % 7 == 0, F.array().cast("array<string>")).otherwise(words("p_type")).alias("assumptions"), F.when(size % 5 == 0, words("p_type")).when(size % 5 == 1, words("p_type", " ")).otherwise(words("p_type", "p_name")).alias("unknowns"),
        F.when(size == 3, " ").otherwise("interview").alias("method"), F.lit("owners").alias("participants"), (size % 11).alias("sample_size"), words("a", "b").alias("steps"), F.array(F.concat(F.lit("at least "), size)).alias("success"),
        F.when(size % 6 == 0, words("few")).otherwise(words("under 2")).alias("failure"), words("stop").alias("stops"), F.when(size == 4, "L4").otherwise("L5").alias("permission"), F.lit("not_started").alias("execution"),
    )
    claims_ = t("lineitem").where("l_quantity > 48").select(F.concat(F.lit("o"), "l_partkey").alias("claim_id"))
    return A.hypothesis_gate(c, claims_).withColumn("failures", F.array_join("failures", ","))


_RUNS = """runs AS (SELECT user_id AS run, count(*) FILTER (event_type <> 'signup') > 8 AS external, count(*) FILTER (event_type = 'view' AND value > 30) AS accepted, count(*) FILTER (event_type = 'purchase' AND value > 60) AS confirmed,
 count(*) FILTER (event_type = 'click' AND value > 110) AS hypotheses, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY user_id)"""


@query(
    "e26_decision_guidance",
    f"""WITH {_RUNS} SELECT run, readiness, CASE WHEN readiness = 'validation_ready' THEN 'requires_real_world_validation' ELSE 'not_evaluated' END AS commercialization FROM (SELECT run, CASE WHEN NOT external THEN 'contract_only' WHEN failures > 0 AND accepted = 0 THEN 'technical_blocked'
 WHEN accepted = 0 OR confirmed = 0 THEN 'evidence_gap' WHEN hypotheses > 0 THEN 'validation_ready' ELSE 'ready_for_human_review' END AS readiness FROM runs) x""",
)
def e26(t):
    is_ = lambda kind, more: F.count_if((F.col("event_type") == kind) & (F.col("value") > more))
    runs = t("events").groupBy(F.col("user_id").alias("run")).agg(
        (F.count_if(F.col("event_type") != "signup") > 8).alias("external"), is_("view", 30).alias("accepted"), is_("purchase", 60).alias("confirmed"), is_("click", 110).alias("hypotheses"), F.count_if(F.col("event_type") == "error").alias("failures")
    )
    return R.decision_guidance(runs)


@query(
    "e27_reviewed_split",
    f"""WITH {_ITEMS.replace('items AS', 'before AS')}, items AS (SELECT item_id, coalesce(o.status, b.status) AS status, claim_role, evidence_ids FROM before b LEFT JOIN (SELECT doc_id, {sql_pick('doc_id // 6', 'approved', 'rejected', 'needs_review')} AS status FROM labels WHERE doc_id % 6 = 0) o ON o.doc_id = b.item_id), {_REST}
SELECT item_id, status, CASE WHEN confirmable THEN 'confirmed' WHEN status = 'rejected' THEN 'rejected' ELSE 'candidate' END AS section FROM done""",
)
def e27(t):
    overrides = t("labels").where("doc_id % 6 = 0").withColumn("k", F.floor(F.col("doc_id") / 6)).select(F.col("doc_id").alias("item_id"), pick("k", "approved", "rejected", "needs_review").alias("status"))
    return R.reviewed_split(items(t), overrides, evidence(t), claims(t))


@query(
    "e28_blockers",
    """WITH jobs AS (SELECT user_id AS run, event_id FROM events WHERE event_type IN ('error', 'view') AND value > 30),
ranked AS (SELECT run, event_id, row_number() OVER (PARTITION BY run ORDER BY event_id) AS place FROM jobs)
SELECT run, 'no_documents' AS kind, CAST(NULL AS BIGINT) AS id, CAST(1 AS BIGINT) AS n FROM (SELECT DISTINCT user_id AS run FROM events) r WHERE run NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 90)
UNION ALL SELECT user_id, 'crawl_failed', event_id, 1 FROM events WHERE event_type = 'error' AND value > 100
UNION ALL SELECT run, 'extraction_failed', event_id, 1 FROM ranked WHERE place <= 12
UNION ALL SELECT run, 'more_extractions', NULL, count(*) - 12 FROM jobs GROUP BY run HAVING count(*) > 12
UNION ALL SELECT user_id, 'fallback', NULL, 1 FROM events GROUP BY user_id HAVING bool_or(event_type = 'signup' AND value > 150)""",
)
def e28(t):
    e = t("events").withColumn("run", F.col("user_id"))
    runs = e.groupBy("run").agg(F.bool_or((F.col("event_type") == "signup") & (F.col("value") > 150)).alias("fallback"))
    crawls = e.where("event_type = 'error'").select("run", F.col("event_id").alias("crawl_id"), F.when(F.col("value") > 100, "failed").otherwise("completed").alias("status"))
    jobs = e.select("run", F.col("event_id").alias("job_id"), F.when(F.col("event_type").isin("error", "view"), "needs_review").otherwise("done").alias("status"), (F.col("value") > 30).alias("failed"))
    return R.blockers(runs, e.where("event_type = 'purchase' and value > 90").select("run"), crawls, jobs)
