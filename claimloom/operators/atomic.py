"""Atomic claims: single statements that one quote of one stored document supports, and hypotheses built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.text import SPACE
from claimloom.functions.urls import canonical
from claimloom.operators.review import trimmed

# Fixed values.
DECISION = "(?:停止商业化|终止商业化|值得进入|不值得进入|蓝海|商业机会|建议推出)"
COMPOUND = "(?:此外|另一方面|与此同时|不仅.+而且|不但.+而且)"
SENTENCE_END = "[。！？!?]"
CERTAINTY = "(?:已确认(?:的)?(?:市场)?机会|市场已经证明|必然|一定会|应该推出|建议推出|停止商业化|终止商业化|值得进入|不值得进入|巨大机会|蓝海市场)"
UNCERTAINTY = "(?:可能|待验证|如果.+那么)"
UNVERIFIED = "待验证："
SPOT_ROLES = ["market_size_growth", "regulation_standard", "brand_positioning_product"]


def failures(*tests: tuple[Column, str | Column]) -> Column:
    """The codes whose condition holds, in their order, each once."""
    return F.array_distinct(F.array_compact(F.array(*(F.when(condition, F.lit(code) if isinstance(code, str) else code) for condition, code in tests))))


def bare(c: Column) -> Column:
    """Without white space and without one closing mark at the end."""
    return F.regexp_replace(F.regexp_replace(c, SPACE + "+", ""), "[。；;]$", "")


def supports(quote: Column, statement: Column) -> Column:
    return bare(quote).contains(bare(statement))


def last_by_url(df: DataFrame, order: str, name: str) -> DataFrame:
    """(url, name): of the rows of one canonical URL the last by ``order``, as a struct; rows without such a URL go."""
    own = df.withColumn("_url", canonical(F.col("url"))).where("_url is not null")
    return own.groupBy("_url").agg(F.max_by(F.struct(*(c for c in df.columns if c != order)), order).alias(name))


def atomic_claims(candidates: DataFrame, docs: DataFrame, relevant: DataFrame, routes: DataFrame, stored: DataFrame, tasks: DataFrame, policy: DataFrame) -> DataFrame:
    """A row for each candidate with its ``failures``; without any it is a claim, and has all it is bound to.

    ``candidates``: (place, candidate_id, statement, claim_role, url, quote); of equal ids the first by place counts.
    ``docs``: (place, url, doc_id, text); ``relevant``: (place, url, source_role); ``routes``: (place, url, task_id,
    route_id, source_role); ``stored``: (place, url, document_id, task_id, route_id, source_role): of equal canonical URLs
    the last by place. ``tasks``: (task_id, coverage_row, target_roles); ``policy``: (source_role, claim_role), both small
    by nature and joined without a broadcast of unknown size. Offsets are code points from 0.
    """
    c = candidates.withColumn("_url", canonical(F.col("url")))
    again = F.row_number().over(Window.partitionBy("candidate_id").orderBy("place")) > 1
    c = c.withColumn("_again", again)
    # texts stay out of the joins that only bind, and meet the candidates last
    for df, name in ((relevant, "relevant"), (routes, "route"), (stored, "stored")):
        c = c.join(last_by_url(df, "place", name).hint("merge"), "_url", "left")
    c = c.join(tasks.select(F.col("task_id").alias("_task"), F.col("coverage_row").alias("_row"), F.col("target_roles").alias("_targets")).hint("merge"), F.col("route.task_id") == F.col("_task"), "left")
    allowed = policy.select(F.col("source_role").alias("_from"), F.col("claim_role").alias("_to")).distinct().withColumn("_allowed", F.lit(True))
    c = c.join(allowed.hint("merge"), (F.col("route.source_role") == F.col("_from")) & (F.col("claim_role") == F.col("_to")), "left")
    c = c.join(last_by_url(docs.select("place", "url", "doc_id", "text"), "place", "doc").hint("merge"), "_url", "left")
    statement, quote = trimmed(F.col("statement")), F.coalesce("quote", F.lit(""))
    at = F.when(F.col("doc").isNotNull(), F.instr(F.coalesce("doc.text", F.lit("")), quote) - 1).otherwise(-1)
    route, stored_, known = F.col("route"), F.col("stored"), F.col("relevant")
    mismatch = (stored_["task_id"] != route["task_id"]) | (stored_["route_id"] != route["route_id"]) | (stored_["source_role"] != route["source_role"])
    failed = failures(
        (F.length(statement) < 4, "atomic_statement_too_short"),
        (F.length(statement) > 180, "atomic_statement_too_long"),
        (statement.rlike(DECISION), "commercialization_decision_forbidden"),
        (statement.rlike(COMPOUND), "compound_statement_requires_split"),
        (F.regexp_count(statement, F.lit(SENTENCE_END)) > 1, "multiple_sentences_require_split"),
        (trimmed(F.coalesce("candidate_id", F.lit(""))) == "", "candidate_id_required"),
        (F.col("_again"), "candidate_id_duplicate"),
        (F.col("_url").isNull(), "candidate_source_url_invalid"),
        (known.isNull(), "m2_strong_relevance_gate_failed"),
        (F.col("doc").isNull(), "extracted_raw_document_missing"),
        (route.isNull(), "acquisition_route_missing"),
        (stored_.isNull(), "immutable_raw_document_missing"),
        (F.col("_task").isNull(), "acquisition_task_missing"),
        (route["source_role"] != known["source_role"], "m2_source_role_mismatch"),
        (route.isNotNull() & stored_.isNotNull() & mismatch, "immutable_route_binding_mismatch"),
        (F.col("_task").isNotNull() & ~F.array_contains("_targets", F.col("claim_role")), "claim_role_not_targeted_by_task"),
        (route.isNotNull() & F.col("_allowed").isNull(), "source_role_not_authorized_for_claim_role"),
        (trimmed(quote) == "", "quote_required"),
        (at < 0, "quote_not_exactly_matched"),
        ((quote != "") & ~supports(quote, F.col("statement")), "statement_not_directly_supported_by_quote"),
    )
    c = c.withColumns({"failures": failed, "quote_start": at})
    good = F.size("failures") == 0
    bound = {
        "source_role": route["source_role"], "task_id": F.col("_task"), "coverage_row": F.col("_row"), "document_id": stored_["document_id"], "doc_id": F.col("doc.doc_id"),
        "content_hash": F.sha2("doc.text", 256), "quote_start": F.col("quote_start"), "quote_end": F.col("quote_start") + F.length(quote), "source_url": F.col("_url"),
    }
    return c.select("place", "candidate_id", statement.alias("statement"), "claim_role", "url", "quote", "failures", *(F.when(good, v).alias(k) for k, v in bound.items()))


def audit_claims(claims: DataFrame, docs: DataFrame, stored: DataFrame, relevant: DataFrame, policy: DataFrame) -> DataFrame:
    """(claim_id, failure): the first check that a claim fails, or null; claim ids are unique.

    ``claims``: (claim_id, statement, claim_role, source_role, task_id, document_id, content_hash, source_url, quote,
    quote_start, quote_end); ``docs``: (url, text); ``stored``: (document_id, url, source_role, task_id), ids being unique;
    ``relevant``: (url, source_role, task_id). The text must be the only one with that URL and hash.
    """
    c = claims.withColumn("_url", canonical(F.col("source_url")))
    own = stored.select("document_id", canonical(F.col("url")).alias("_s_url"), F.col("source_role").alias("_s_role"), F.col("task_id").alias("_s_task"))
    c = c.join(own.hint("merge"), "document_id", "left")
    texts = docs.select(canonical(F.col("url")).alias("_url"), F.sha2("text", 256).alias("content_hash"), "text")
    texts = texts.join(c.select("_url", "content_hash").distinct().hint("merge"), ["_url", "content_hash"], "left_semi")
    versions = texts.groupBy("_url", "content_hash").agg(F.count("*").alias("_n"), F.any_value("text").alias("_text"))
    c = c.join(versions.hint("merge"), ["_url", "content_hash"], "left")
    allowed = policy.select("source_role", "claim_role").distinct().withColumn("_allowed", F.lit(True))
    c = c.join(allowed.hint("merge"), ["source_role", "claim_role"], "left")
    seen = relevant.select(canonical(F.col("url")).alias("_url"), "source_role", "task_id").distinct().withColumn("_seen", F.lit(True))
    c = c.join(seen.hint("merge"), ["_url", "source_role", "task_id"], "left")
    bound = (F.col("_s_url") == F.col("_url")) & (F.col("_s_role") == F.col("source_role")) & (F.col("_s_task") == F.col("task_id"))
    size = F.col("quote_end") - F.col("quote_start")
    stands = (F.substring("_text", F.col("quote_start") + 1, size) == F.col("quote")) & (size == F.length("quote"))
    no = lambda x: ~F.coalesce(x, F.lit(False))
    failure = (
        F.when(F.col("_url").isNull(), "claim_source_url_invalid").when(no(bound), "immutable_binding_mismatch").when(no(F.col("_n") == 1), "extracted_version_not_unique")
        .when(no(stands), "quote_offsets_mismatch").when(no(supports(F.col("quote"), F.col("statement"))), "statement_not_directly_supported")
        .when(F.col("_allowed").isNull(), "source_role_not_authorized").when(F.col("_seen").isNull(), "m2_relevance_binding_missing")
    )
    return c.select("claim_id", failure.alias("failure"))


def spot_check(claims: DataFrame, roles: DataFrame) -> DataFrame:
    """(claim_role, claim_id, failure): the first claim (by place) of each role of ``roles`` (claim_role); none is a failure."""
    first = claims.groupBy("claim_role").agg(F.min_by("claim_id", "place").alias("claim_id"))
    j = roles.join(first.hint("merge"), "claim_role", "left")
    return j.select("claim_role", "claim_id", F.when(F.col("claim_id").isNull(), F.concat(F.lit("representative_claim_role_missing:"), "claim_role")).alias("failure"))


def hypothesis_gate(candidates: DataFrame, claims: DataFrame) -> DataFrame:
    """(place, hypothesis_id, failures) for each candidate; without failures it stands as an unverified hypothesis.

    ``candidates``: (place, hypothesis_id, title, statement, problem, target_user, claim_ids, assumptions, unknowns, method,
    participants, sample_size, steps, success, failure, stops, permission, execution), places being unique; of equal ids the
    first by place counts. ``claims``: (claim_id).
    """
    asked = candidates.select("place", F.posexplode("claim_ids").alias("_pos", "claim_id"))
    missing = asked.join(claims.select("claim_id").distinct().hint("merge"), "claim_id", "left_anti")
    missing = missing.groupBy("place").agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "claim_id"))), lambda x: F.concat(F.lit("supporting_atomic_claim_missing:"), x["claim_id"])).alias("_missing"))
    c = candidates.withColumn("_again", F.row_number().over(Window.partitionBy("hypothesis_id").orderBy("place")) > 1).join(missing.hint("merge"), "place", "left")
    filled = lambda name: (F.size(name) > 0) & F.forall(name, lambda x: trimmed(x) != "")
    blank = lambda name: trimmed(F.col(name)) == ""
    vague = F.exists(F.concat("success", "failure"), lambda x: ~x.rlike("[0-9]"))
    head = failures(
        (blank("hypothesis_id"), "hypothesis_id_required"),
        (~F.col("title").startswith(UNVERIFIED), "hypothesis_title_must_be_explicitly_unverified"),
        (~F.col("statement").rlike(UNCERTAINTY), "hypothesis_uncertainty_language_required"),
        (F.concat_ws("\n", "title", "statement", "problem").rlike(CERTAINTY), "commercialization_or_certainty_conclusion_forbidden"),
        (F.length(trimmed(F.col("target_user"))) < 6, "target_user_not_specific"),
        (F.length(trimmed(F.col("problem"))) < 8, "target_problem_not_specific"),
        (~filled("claim_ids"), "supporting_atomic_claim_required"),
    )
    tail = failures(
        (~filled("assumptions"), "hypothesis_assumptions_required"),
        ((F.size("unknowns") < 2) | ~filled("unknowns"), "at_least_two_unknowns_required"),
        (blank("method") | blank("participants"), "validation_method_and_participant_profile_required"),
        (F.col("sample_size").isNull() | (F.col("sample_size") < 3), "validation_minimum_sample_size_below_3"),
        (~filled("steps"), "validation_steps_required"),
        (~filled("success"), "validation_success_criteria_required"),
        (~filled("failure"), "validation_failure_criteria_required"),
        (vague, "validation_criteria_must_be_measurable"),
        (~filled("stops"), "validation_stop_conditions_required"),
        ((F.col("permission") != "L5") | (F.col("execution") != "not_started"), "validation_must_remain_not_started_behind_L5"),
        (F.col("_again"), "hypothesis_id_duplicate"),
    )
    none = F.array().cast("array<string>")
    return c.select("place", "hypothesis_id", F.array_distinct(F.concat(head, F.coalesce("_missing", none), tail)).alias("failures"))
