"""Results of research modules: which claims are confirmed, which rows they cover, and each module's status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.text import SPACE, normalize_text
from claimloom.operators import evidence as E
from claimloom.sources.scratch import cut, hinted

# The relationships of samples that each module may use, and what its claims must not say.
SAMPLE_RELATIONSHIPS = {
    "market_landscape": [],
    "regulation_and_standards": [],
    "consumer_demand": ["direct_competitor"],
    "ecommerce_competitor_research": ["direct_competitor", "channel_actor"],
    "content_and_traffic": ["content_actor"],
    "business_model_and_supply_chain": ["supply_chain_actor", "channel_actor", "business_model_analogy"],
}
CONVERSION = r"(?i)(?:转化|conversion)"
INDUSTRY_WIDE = r"(?i)(?:全行业|industry[- ]wide|overall market)"
PROFIT = r"(?i)(?:盈利|利润|毛利|profit|margin)"


def _empty(kind: str = "array<string>") -> Column:
    return F.array().cast(kind)


def _codes(checks: list[tuple[Column, Column | str]]) -> Column:
    return F.array_compact(F.array(*(F.when(c, F.lit(code) if isinstance(code, str) else code) for c, code in checks)))


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), rf"\A{SPACE}+|{SPACE}+\z", "")


def _quoted(evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """(evidence_id, held, elsewhere): whether its own document holds the quote, and else whether any other does.

    A quote is first looked for in the one document that it names; only those not found there are searched for in all.
    """
    q = evidence.select("evidence_id", "doc", normalize_text(F.col("quote")).alias("q")).where((F.length("q") >= 4) & F.col("doc").isNotNull())
    texts = documents.select("doc", F.col("text").alias("_t"))
    held = cut(texts.join(hinted(q), "doc").where(normalize_text(F.col("_t")).contains(F.col("q"))).select("evidence_id", F.lit(True).alias("held")).distinct(), "held")
    lost = cut(q.join(held.hint("merge"), "evidence_id", "left_anti").select("evidence_id", "q"), "lost")
    if lost.isEmpty():
        return held.withColumn("elsewhere", F.lit(False))
    found = E.match_quotes(lost, texts, quote_id="evidence_id", doc_id="doc", quote_col="q", doc_col="_t").select("evidence_id").distinct().withColumn("elsewhere", F.lit(True))
    return held.join(found.hint("merge"), "evidence_id", "full").na.fill(False, ["held", "elsewhere"])


def _validated(bound: DataFrame, policy: DataFrame) -> DataFrame:
    """``bound`` with reasons (why its quote does not support the claim, in order) and good."""
    allowed = hinted(policy.groupBy(F.col("source_role").alias("_role")).agg(F.collect_set("claim_role").alias("_may")))
    j = bound.join(allowed, F.col("doc_role") == F.col("_role"), "left").withColumns({"_q": _trimmed(F.col("quote")), "_n": normalize_text(F.col("quote")), "_agrees": F.col("held") & F.col("doc_source").eqNullSafe(F.col("source"))})
    asks = F.coalesce("claim_role", F.lit("")) != ""
    role = (
        F.when(F.col("doc_role").isNull() & ~asks, None).when(F.col("doc_role").isNull(), "source_role_missing").when(~asks, "claim_role_missing").when(F.col("_may").isNull(), "source_role_policy_missing")
        .when(~F.array_contains("_may", F.col("claim_role")), F.concat_ws(":", F.lit("source_role_not_authorized"), "doc_role", "claim_role"))
    )
    failure = (
        F.when(~F.col("held") & ~F.col("elsewhere"), "quote_not_found_in_raw_documents").when(~F.col("_agrees"), "evidence_reference_mismatch")
        .when(~F.coalesce("confirmable", F.lit(False)), F.concat(F.lit("source_not_confirmable:"), F.coalesce("doc_type", F.lit("unknown")))).otherwise(role)
    )
    j = j.withColumn("_failure", failure)
    text = F.col("statement")
    # the URL and the source of a bound quote count as its text
    spoken = F.concat_ws("\n", "_q", F.when(F.col("_failure").isNull(), F.concat_ws("\n", F.coalesce("url", F.lit("")), F.col("source").cast("string"))))
    direct = F.forall(E.must_quote(text), lambda x: F.col("_n").contains(x))
    more = _codes([
        (F.col("_failure").isNotNull(), F.col("_failure")),
        (E.high_risk(text) & ~direct, "high_risk_claim_not_directly_quoted"),
        (~E.covered(text, spoken), "important_claim_text_not_covered_by_quotes"),
        ((F.col("claim_role") == "consumer_need") & text.rlike(E.DEMAND) & ~F.col("_q").rlike(E.DIRECT_DEMAND), "demand_inference_without_direct_user_evidence"),
    ])
    j = j.withColumn("reasons", F.when(F.col("_q") == "", F.array(F.lit("missing_evidence_quote"))).otherwise(more))
    return j.drop("_q", "_n", "_agrees", "_failure", "_role", "_may")


def module_claims(
    claims: DataFrame, evidence: DataFrame, documents: DataFrame, sources: DataFrame, *, rows: DataFrame, samples: DataFrame, assignments: DataFrame, module_roles: DataFrame, policy: DataFrame,
    relationships: dict[str, list[str]] = SAMPLE_RELATIONSHIPS,
) -> DataFrame:
    """(claim, module, status, failures, sources, source_roles): a claim is confirmed if nothing speaks against it.

    ``claims``: (claim, claim_id, module, statement, claim_role, evidence_ids, items, samples), one row a ``claim``, whose lists
    are short. ``evidence``: (evidence_id, quote, source, doc, claim_role, source_role, accepted), ids once;
    ``documents``: (doc, source, url, text, role, doc_type, confirmable), text with title and excerpt; ``sources``: (source, role);
    ``rows``: (module, axis, axis_items) of the coverage matrix; ``samples``: (sample, relationship);
    ``assignments``: (sample, axis, item); ``module_roles``: (module, claim_role); ``policy``: (source_role, claim_role).

    Failures stand in the order of the checks: the claim's own, its items, its samples, its evidence in its order, what its
    module must not say. Each evidence must have the claim's role, a document and a source that belong together and
    whose roles agree and allow the claim, and a quote that supports the statement. Nulls count as empty or missing. Texts
    meet only the quotes that name them; claims meet ids.
    """
    own = cut(claims.select("claim", F.coalesce("claim_id", F.lit("")).alias("claim_id"), "module", F.coalesce("statement", F.lit("")).alias("statement"), "claim_role", *(F.coalesce(c, _empty(dict(claims.dtypes)[c])).alias(c) for c in ("evidence_ids", "items", "samples"))), "claims")
    failure = lambda df, phase, pos, codes: df.select("claim", F.lit(phase).alias("phase"), pos.alias("pos"), F.posexplode(codes).alias("step", "f"))

    # a row for each module of the plan
    plan = rows.groupBy("module").agg(F.collect_set("axis").alias("_axes"), F.array_distinct(F.flatten(F.collect_list("axis_items"))).alias("_items"))
    plan = hinted(cut(plan.join(module_roles.groupBy("module").agg(F.collect_set("claim_role").alias("_roles")).hint("merge"), "module", "full"), "plan"))
    has_in = lambda c, x: F.coalesce(F.array_contains(c, x), F.lit(False))
    unknown = F.transform(F.filter("items", lambda x: ~has_in("_items", x)), lambda x: F.concat(F.lit("unknown_axis_item:"), F.coalesce(x.cast("string"), F.lit(""))))
    basic = failure(own.join(plan, "module", "left"), 0, F.lit(0), F.concat(_codes([
        (_trimmed(F.col("claim_id")) == "", "claim_id_required"), (_trimmed(F.col("statement")) == "", "claim_statement_required"),
        (~has_in("_roles", F.col("claim_role")), F.concat(F.lit("claim_role_not_allowed_for_module:"), F.coalesce("claim_role", F.lit("")))), (F.size("evidence_ids") == 0, "claim_evidence_required"),
    ]), unknown))

    has = assignments.groupBy("sample").agg(F.collect_set(F.struct("axis", "item")).alias("_has"))
    chosen = hinted(cut(samples.select("sample", "relationship", F.lit(True).alias("_known")).dropDuplicates(["sample"]).join(has.hint("merge"), "sample", "left"), "samples"))
    s = own.select("claim", "module", "items", F.posexplode("samples").alias("pos", "sample")).join(chosen, "sample", "left").join(plan.select("module", "_axes"), "module", "left")
    fits = reduce(lambda a, b: a | b, ((F.col("module") == m) & F.col("relationship").isin(*r) for m, r in relationships.items() if r), F.lit(False))
    covers = F.exists("_has", lambda x: F.array_contains("_axes", x["axis"]) & F.array_contains("items", x["item"]))
    code = lambda name: F.concat(F.lit(name + ":"), F.coalesce(F.col("sample").cast("string"), F.lit("")))
    s = failure(s, 2, F.col("pos"), _codes([
        (F.col("_known").isNull(), code("unknown_representative_sample")), (F.col("_known") & ~F.coalesce(fits, F.lit(False)), code("sample_relationship_not_allowed")),
        (F.col("_known") & ~F.coalesce(covers, F.lit(False)), code("sample_does_not_cover_claim_axis")),
    ]))

    ev = evidence.select("evidence_id", "quote", "source", "doc", F.col("claim_role").alias("own_role"), "source_role", F.coalesce("accepted", F.lit(False)).alias("accepted"), F.lit(True).alias("_found"))
    meta = documents.select("doc", F.col("source").alias("doc_source"), "url", F.col("role").alias("doc_role"), "doc_type", "confirmable", F.lit(True).alias("_doc"))
    theirs = sources.select("source", F.col("role").alias("their_role"), F.lit(True).alias("_source"))
    # what does not depend on a claim is worked out once for each evidence
    ev = ev.join(meta.hint("merge"), "doc", "left").join(hinted(theirs), "source", "left").join(_quoted(evidence, documents).hint("merge"), "evidence_id", "left").na.fill(False, ["held", "elsewhere"])
    ev = cut(E.role_gate(ev, policy, roles=["source_role", "doc_role", "their_role"], claim_role="own_role").drop("role"), "evidence")
    asked = own.select("claim", "module", "statement", "claim_role", F.posexplode("evidence_ids").alias("pos", "evidence_id")).join(ev.hint("merge"), "evidence_id", "left")
    both = F.col("_doc") & F.col("_source")
    j = cut(_validated(asked.na.fill(False, ["_found", "_doc", "_source", "held", "elsewhere", "accepted"]), policy), "asked")
    missing = failure(j.where("not _found").select("claim").distinct(), 3, F.lit(0), F.array(F.lit("claim_evidence_missing")))
    gated = F.col("accepted") & F.col("role_failure").isNull()
    named = lambda code: F.concat(F.lit(code + ":"), F.col("evidence_id").cast("string"))
    said = _codes([
        (~F.col("own_role").eqNullSafe(F.col("claim_role")), named("evidence_claim_role_mismatch")), (~F.col("_doc"), named("raw_document_missing")), (~F.col("_source"), named("source_missing")),
        (F.col("_doc") & ~F.col("doc_source").eqNullSafe(F.col("source")), named("evidence_raw_source_mismatch")), (both & ~gated, F.coalesce("role_failure", named("evidence_role_gate_failed"))),
    ])
    because = F.transform(F.when(both, F.col("reasons")).otherwise(_empty()), lambda r: F.concat(named("evidence_validation_failed"), F.lit(":"), r))
    bound = failure(j.where("_found"), 4, F.col("pos"), F.concat(said, because))

    good = j.where(F.col("_found") & both & gated & (F.size("reasons") == 0) & F.col("their_role").isNotNull())
    good = good.groupBy("claim").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_set("their_role")).alias("source_roles"))
    good = cut(own.select("claim", "module", "statement").join(good.hint("merge"), "claim", "left"), "good").withColumns({"source_roles": F.coalesce("source_roles", _empty())})
    text, module = F.col("statement"), F.col("module")
    guarded = failure(good, 5, F.lit(0), _codes([
        ((module == "content_and_traffic") & text.rlike(CONVERSION), "content_metrics_cannot_support_conversion_claim"),
        ((module == "ecommerce_competitor_research") & text.rlike(INDUSTRY_WIDE), "brand_claim_cannot_be_industry_wide"),
        ((module == "business_model_and_supply_chain") & text.rlike(PROFIT) & ~F.array_contains("source_roles", "financial_report"), "profitability_requires_financial_report"),
    ]))

    every = reduce(DataFrame.unionByName, [basic, s, missing, bound, guarded])
    once = every.groupBy("claim", "f").agg(F.min(F.struct("phase", "pos", "step")).alias("at"))
    listed = once.groupBy("claim").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "f"))), lambda x: x["f"]).alias("failures"))
    out = good.drop("statement").join(listed.hint("merge"), "claim", "left").withColumns({"failures": F.coalesce("failures", _empty()), "sources": F.coalesce("sources", _empty(dict(good.dtypes)["sources"]))})
    return out.withColumn("status", F.when(F.size("failures") == 0, "confirmed").otherwise("blocked"))


def module_coverage(claims: DataFrame, rows: DataFrame, assignments: DataFrame) -> DataFrame:
    """(module, row_id, covered, sources, roles, samples, gaps, status): what the confirmed claims of a row's module give it.

    ``claims``: confirmed ones, (claim, module, items, samples, sources, source_roles); ``rows``: (module, row_id, axis, axis_items, min_sources,
    min_roles, min_samples); ``assignments``: (sample, axis, item) of the selected samples. A claim counts for a row if it
    names one of its items; where samples are required, an item must also be one that a sample of such a claim has on the row's axis.
    """
    rows = cut(rows, "rows")
    asked = rows.select("module", "row_id", "axis", "min_samples", F.explode(F.array_distinct("axis_items")).alias("item"))
    named = claims.select("claim", "module", F.explode(F.array_distinct("items")).alias("item"))
    hit = cut(named.join(hinted(asked), ["module", "item"]), "hit")
    told = hit.select("module", "row_id", "axis", "claim").distinct().join(claims.select("claim", "samples", "sources", "source_roles").hint("merge"), "claim")
    key = ["module", "row_id"]
    distinct = lambda c, name: told.select(*key, F.explode(c).alias("v")).distinct().groupBy(*key).agg(F.count("*").alias(name))
    bound = told.select(*key, "axis", F.explode("samples").alias("sample")).distinct()
    sampled = bound.join(hinted(assignments.select("sample", "axis", "item").distinct()), ["sample", "axis"]).select(*key, "item").distinct().withColumn("_sampled", F.lit(True))
    covered = hit.select(*key, "item", "min_samples").distinct().join(sampled.hint("merge"), [*key, "item"], "left").where("min_samples <= 0 or _sampled")
    covered = covered.groupBy(*key).agg(F.collect_set("item").alias("_items"))
    j = rows
    for part in (covered, distinct("sources", "sources"), distinct("source_roles", "roles"), distinct("samples", "samples")):
        j = j.join(part.hint("merge"), key, "left")
    j = j.na.fill(0, ["sources", "roles", "samples"]).withColumn("_items", F.coalesce("_items", _empty(dict(rows.dtypes)["axis_items"])))
    left = F.filter("axis_items", lambda x: ~F.array_contains("_items", x))
    short = [(F.col(have) < F.col(least), F.concat(F.lit(name + ":"), F.col(have).cast("string"), F.lit("/"), F.col(least).cast("string"))) for have, least, name in (("sources", "min_sources", "independent_sources"), ("roles", "min_roles", "source_roles"), ("samples", "min_samples", "representative_samples"))]
    gaps = _codes([*short, (F.size(left) > 0, F.concat(F.lit("uncovered_axis_items:"), F.array_join(left.cast("array<string>"), ",")))])
    return j.select(*key, F.size("_items").alias("covered"), "sources", "roles", "samples", gaps.alias("gaps"), F.when(F.size(gaps) == 0, "pass").otherwise("blocked").alias("status"))


def module_status(modules: DataFrame, claims: DataFrame, coverage: DataFrame) -> DataFrame:
    """(module, status): blocked_missing_evidence without confirmed claims, complete if every row passes, else blocked_insufficient_coverage."""
    ok = claims.where("status = 'confirmed'").groupBy("module").agg(F.count("*").alias("confirmed"))
    gaps = coverage.where("status = 'blocked'").groupBy("module").agg(F.count("*").alias("gaps"))
    j = modules.join(ok, "module", "left").join(gaps, "module", "left")
    status = F.when(F.coalesce("confirmed", F.lit(0)) == 0, "blocked_missing_evidence").when(F.coalesce("gaps", F.lit(0)) == 0, "complete").otherwise("blocked_insufficient_coverage")
    return j.select("module", status.alias("status"))
