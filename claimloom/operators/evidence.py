"""Binding quotes to documents, and the gates that claims pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.text import normalize_text
from claimloom.operators.containment import checked, containing, in_one_pass, runs_of
from claimloom.sources.scratch import cut, hinted

# Fixed values.
HIGH_RISK = [
    r"(?i)\b\d+(\.\d+)?\s*(k|m|万|亿)?\s*(users|customers|orders|sales|销量|用户|订单)\b", r"(?i)\btop\s*\d+\b", r"(?i)#\s*\d+\s*(rated|ranked)?", r"(?i)\b(?:no\.?|number)\s*1\b",
    r"排名\s*(?:第)?[一二三四五六七八九十\d]+", r"市场份额", r"(?i)market share", r"转化率", r"(?i)conversion rate", r"销售额", r"(?i)sales revenue|\brevenue\b",
]
MARKERS = [
    r"top\s*\d+", r"#\s*\d+\s*(?:rated|ranked)?", r"(?:no\.?|number)\s*1", r"排名\s*(?:第)?[一二三四五六七八九十\d]+", r"market share", r"市场份额", r"conversion rate", r"转化率",
    r"sales revenue|\brevenue\b", r"销售额", r"users|customers|orders|sales|销量|用户|订单",
]
GENERIC_TERMS = ["brand", "product", "market", "website", "official", "品牌", "产品", "市场", "官网", "线上"]
DEMAND = r"(?i)(?:demand|need|pain point|gap|opportunit|underdeveloped|not popular|lack of|用户需求|消费者需求|痛点|缺口|机会|增长|尚未普及|认知门槛|市场教育)"
DIRECT_DEMAND = r"(?i)(?:customer|consumer|user|review|feedback|survey|question|complaint|frequently asked|消费者|用户|买家|评论|反馈|调研|问答|常见问题|投诉|困扰|需求)"
NUMBER = r"\d+(?:\.\d+)?%?"
TERM = r"[a-z][a-z0-9-]{3,}|\p{IsHan}{2,}"


def matches_any(c: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (c.rlike(p) for p in patterns))


def match_quotes(quotes: DataFrame, docs: DataFrame, *, quote_id: str, doc_id: str, quote_col: str = "text", doc_col: str = "text", k: int = 5, least: int = 4) -> DataFrame:
    """(quote_id, doc_id) of every document whose normalised text contains the normalised quote.

    A quote of k + 2 words or more is looked up by one run of k of its inner words (its first and last may be parts of
    words in a document), the one that the fewest documents have; the hits are then checked for the whole quote. Shorter
    quotes, which have no such run, are looked up by their rarest characters (``containment``). Few quotes are given to
    every task and found in one pass over the texts. Else, only runs that a quote has are kept from the documents and
    written once, so that common runs are counted but never paired.
    """
    q = quotes.select(F.col(quote_id).alias("q"), normalize_text(F.col(quote_col)).alias("quote")).where(F.length("quote") >= least)
    d = docs.select(F.col(doc_id).alias("d"), normalize_text(F.col(doc_col)).alias("hay"))

    words = F.split("quote", " ")
    q = q.withColumn("inner", F.when(F.size(words) >= k + 2, F.array_join(F.slice(words, 2, F.size(words) - 2), " ")))
    q = cut(q.withColumn("n", F.monotonically_increasing_id()), "quotes")
    found = in_one_pass(q.select("n", F.col("quote").alias("needle"), "inner"), d, words=k)
    if found is not None:
        return cut(found, "found").join(hinted(q.select("n", "q")), "n").select(F.col("q").alias(quote_id), F.col("d").alias(doc_id)).distinct()
    long = cut(runs_of(q.where("inner is not null").select(F.col("q").alias("d"), F.col("inner").alias("hay")), words=k).withColumnRenamed("d", "q"), "quote-runs")
    have = cut(runs_of(d, words=k, wanted=long.select("run").distinct()), "runs")
    often = have.groupBy("run").agg(F.count("*").alias("n"))
    rarest = long.join(often.hint("merge"), "run").groupBy("q").agg(F.min_by("run", F.struct("n", "run")).alias("run"))
    pairs = have.join(rarest.hint("merge"), "run").select("q", "d")
    likely = cut(pairs.join(q.select("q", F.col("quote").alias("needle")).hint("merge"), "q"), "likely")
    found = checked(d, likely).select("q", "d")
    brief = q.where("inner is null").select("q", F.col("quote").alias("needle"))
    found = found.unionByName(containing(brief, d))
    return found.distinct().select(F.col("q").alias(quote_id), F.col("d").alias(doc_id))


def constrained(matches: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """Whether a match agrees with the quote's references; a null reference asks for nothing."""
    return reduce(lambda a, b: a & b, (F.col(r).isNull() | (F.col(r) == F.col(c)) for r, c in pairs), F.lit(True))


def bind_unique(quotes: DataFrame, matches: DataFrame, *, quote_id: str) -> DataFrame:
    """(quote_id, doc, reason): the one document that a quote can only mean, or why there is none.

    ``matches`` has (quote_id, doc, agrees, confirmable, doc_type, role_failure) for every containing document.
    """
    ok = F.col("agrees")
    counted = matches.groupBy(quote_id).agg(
        F.count("*").alias("n"), F.count_if(ok).alias("n_ok"), F.min(F.when(ok, F.struct("doc", "confirmable", "doc_type", "role_failure"))).alias("one")
    )
    one = F.col("one")
    reason = (
        F.when(F.coalesce("n", F.lit(0)) == 0, "quote_not_found_in_raw_documents").when(F.col("n_ok") == 0, "evidence_reference_mismatch").when(F.col("n_ok") > 1, "ambiguous_quote_match")
        .when(~one["confirmable"], F.concat(F.lit("source_not_confirmable:"), F.coalesce(one["doc_type"], F.lit("unknown")))).when(one["role_failure"].isNotNull(), one["role_failure"])
    )
    return quotes.select(quote_id).join(counted, quote_id, "left").select(quote_id, F.when(F.col("n_ok") == 1, one["doc"]).alias("doc"), reason.alias("reason"))


def claim_terms(c: Column) -> Column:
    """The first 20 distinct terms: Latin words of four characters or more, pairs of Han characters; generic ones left out."""
    found = F.filter(F.regexp_extract_all(normalize_text(c), F.lit(TERM), F.lit(0)), lambda x: ~x.isin(*GENERIC_TERMS))
    pairs = lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substring(x, i, 2))
    return F.slice(F.array_distinct(F.flatten(F.transform(found, lambda x: F.when(x.rlike(r"\p{IsHan}"), pairs(x)).otherwise(F.array(x))))), 1, 20)


def covered(claim: Column, quotes: Column) -> Column:
    """Whether enough of a claim's terms (35 %, one to three) occur in the joined text of its quotes; no terms: yes."""
    def enough(given: Column) -> Column:
        n = F.size(given["terms"])
        required = F.least(F.lit(3), F.greatest(F.lit(1), F.ceil(n * 0.35)))
        return (n == 0) | (F.size(F.filter(given["terms"], lambda x: given["text"].contains(x))) >= required)

    # bound, so that both are worked out once and not for each term
    return F.element_at(F.transform(F.array(F.struct(claim_terms(claim).alias("terms"), normalize_text(quotes).alias("text"))), enough), 1)


def claims_covered(claims: DataFrame, quotes: DataFrame, *, claim_id: str, claim_col: str = "text", quote_col: str = "quote") -> DataFrame:
    """(claim_id, covered) for each claim that has quotes: ``covered`` over all of them, each tested by itself.

    No term holds white space, so none lies across two quotes. Texts aren't dealt by claim: the claims' terms are
    broadcast if they are counted to be small, and only the terms found (20 at most a claim) leave the scan of the quotes.
    """
    own = claims.select(claim_id, claim_terms(F.col(claim_col)).alias("terms")).distinct()
    small = own.limit(100_001).count() <= 100_000
    asked = own.groupBy(claim_id).agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("all"))
    text = quotes.select(claim_id, normalize_text(F.col(quote_col)).alias("q")).join(F.broadcast(asked) if small else asked, claim_id)
    seen = text.select(claim_id, F.explode_outer(F.filter("all", lambda x: F.col("q").contains(x))).alias("term")).distinct()
    found = seen.groupBy(claim_id).agg(F.collect_set("term").alias("found"))
    n = F.size("terms")
    enough = F.size(F.array_intersect("terms", "found")) >= F.least(F.lit(3), F.greatest(F.lit(1), F.ceil(n * 0.35)))
    return claims.select(claim_id, claim_terms(F.col(claim_col)).alias("terms")).join(found, claim_id).select(claim_id, ((n == 0) | enough).alias("covered"))


def high_risk(c: Column) -> Column:
    return matches_any(c, HIGH_RISK)


def must_quote(claim: Column) -> Column:
    """Numbers and markers of a claim that one quote must hold."""

    def parts(c: Column) -> Column:
        markers = F.filter(F.array(*(F.regexp_extract(c, f"({p})", 1) for p in MARKERS)), lambda x: x != "")
        return F.concat(F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0)), markers)

    # bound, so that a text is normalised once and not for each marker
    return F.element_at(F.transform(F.array(normalize_text(claim)), parts), 1)


def high_risk_supported(claims: DataFrame, quotes: DataFrame, *, claim_id: str, claim_col: str = "text", quote_col: str = "quote") -> DataFrame:
    """(claim_id, supported): whether some single quote of the claim holds all of its numbers and markers."""
    own = claims.select(claim_id, must_quote(F.col(claim_col)).alias("must"))
    joined = own.join(quotes.select(claim_id, normalize_text(F.col(quote_col)).alias("quote")), claim_id, "left")
    holds = F.coalesce(F.col("quote").isNotNull() & F.forall("must", lambda x: F.col("quote").contains(x)), F.lit(False))
    return joined.groupBy(claim_id).agg(F.bool_or(holds).alias("supported"))


def demand_gate(claims: DataFrame, quotes: DataFrame, *, claim_id: str, claim_col: str, quote_col: str, demand: str = DEMAND, direct: str = DIRECT_DEMAND) -> DataFrame:
    """(claim_id, infers, direct, passes): claims that infer demand need a quote in which users speak."""
    c = claims.groupBy(claim_id).agg(F.bool_or(F.col(claim_col).rlike(demand)).alias("infers"))
    q = quotes.groupBy(claim_id).agg(F.bool_or(F.col(quote_col).rlike(direct)).alias("direct"))
    out = c.join(q, claim_id, "left").withColumn("direct", F.coalesce("direct", F.lit(False)))
    return out.withColumn("passes", ~F.col("infers") | F.col("direct"))


def validate_claims(bound: DataFrame, claims: DataFrame, *, claim_id: str) -> DataFrame:
    """(claim_id, status, confirmed, failures): no quotes: rejected; all confirmed and nothing against it: approved; else needs_review.

    ``bound`` has a row (claim_id, quote_id, quote, doc, reason) for each quote, ``claims`` (claim_id, claim, required,
    need_demand), one row a claim. Of the quotes only flags are gathered, never texts.
    """
    asked = claims.withColumns({"_must": must_quote(F.col("claim")), "_terms": F.coalesce(claim_terms(F.col("required")), F.array().cast("array<string>"))})
    rows = bound.join(asked.select(claim_id, "_must", "_terms").hint("merge"), claim_id).withColumn("_q", normalize_text(F.col("quote")))
    # a bit for each of the (at most 20) terms; no term holds white space, so none lies across two quotes
    bits = F.aggregate(F.transform("_terms", lambda x, i: F.when(F.col("_q").contains(x), F.call_function("shiftleft", F.lit(1), i)).otherwise(0)), F.lit(0), lambda x, y: x + y)
    own = rows.groupBy(claim_id).agg(
        F.count("*").alias("quotes"), F.count_if(F.col("reason").isNull()).alias("confirmed"), F.collect_set("reason").alias("reasons"), F.bit_count(F.bit_or(bits)).alias("_found"),
        F.bool_or(F.forall("_must", lambda x: F.col("_q").contains(x))).alias("_held"), F.bool_or(F.col("quote").rlike(DIRECT_DEMAND)).alias("_direct"),
    )
    j = asked.join(own.hint("merge"), claim_id, "left")
    n = F.size("_terms")
    enough = (n == 0) | (F.col("_found") >= F.least(F.lit(3), F.greatest(F.lit(1), F.ceil(n * 0.35))))
    failures = F.concat(
        "reasons",
        F.when(high_risk(F.col("claim")) & ~F.col("_held"), F.array(F.lit("high_risk_claim_not_directly_quoted"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("required").isNotNull() & ~enough, F.array(F.lit("important_claim_text_not_covered_by_quotes"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("need_demand") & F.col("claim").rlike(DEMAND) & ~F.col("_direct"), F.array(F.lit("demand_inference_without_direct_user_evidence"))).otherwise(F.array().cast("array<string>")),
    )
    failures = F.when(F.col("quotes").isNull(), F.array(F.lit("missing_evidence_quote"))).otherwise(F.array_sort(F.array_distinct(failures)))
    status = F.when(F.col("quotes").isNull(), "rejected").when((F.col("confirmed") == F.col("quotes")) & (F.size(failures) == 0), "approved").otherwise("needs_review")
    return j.select(claim_id, status.alias("status"), F.coalesce("confirmed", F.lit(0)).alias("confirmed"), failures.alias("failures"))


def merge_status(model: Column, validation: Column) -> Column:
    return F.when(validation == "rejected", "rejected").when(validation == "needs_review", "needs_review").when(model == "approved", "approved").otherwise("needs_review")


def role_gate(df: DataFrame, policy: DataFrame, *, roles: list[str], claim_role: str) -> DataFrame:
    """``df`` with role and role_failure: the roles given must agree, and the policy (source_role, claim_role) must allow the claim.

    Nothing known at all passes; ``policy`` is a small dimension.
    """
    known = F.array_distinct(F.array_compact(F.array(*roles)))
    role = F.try_element_at(known, F.lit(1))
    allowed = hinted(policy.groupBy(F.col("source_role").alias("_role")).agg(F.collect_set("claim_role").alias("_allowed")))
    j = df.withColumns({"_known": known, "role": role}).join(allowed, F.col("role") == F.col("_role"), "left")
    n = F.size("_known")
    failure = (
        F.when((n == 0) & F.col(claim_role).isNull(), None).when(n == 0, "source_role_missing").when(n > 1, "source_role_conflict").when(F.col(claim_role).isNull(), "claim_role_missing")
        .when(F.col("_allowed").isNull(), "source_role_policy_missing").when(~F.array_contains("_allowed", F.col(claim_role)), F.concat_ws(":", F.lit("source_role_not_authorized"), "role", claim_role))
    )
    return j.withColumn("role_failure", failure).drop("_known", "_role", "_allowed")


def bind_source_role(docs: DataFrame, sources: DataFrame, *, source_col: str, role_col: str = "role") -> DataFrame:
    """``docs`` with the role of their source, and ``conflict`` where they have another one of their own."""
    j = docs.join(sources.select(source_col, F.col(role_col).alias("_theirs")), source_col, "left")
    conflict = F.coalesce(F.col("_theirs").isNotNull() & F.col(role_col).isNotNull() & (F.col("_theirs") != F.col(role_col)), F.lit(False))
    return j.withColumn("conflict", conflict).withColumn(role_col, F.coalesce("_theirs", role_col)).drop("_theirs")


def lean_evidence(docs: DataFrame, *, run: str, order_col: str, most: int = 12, cut: int = 500) -> DataFrame:
    """The first ``most`` documents of each run with a quote: the excerpt, else the text's beginning, else the title."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    quote = F.coalesce(blank(F.col("excerpt")), blank(F.substring("text", 1, cut)), F.col("title"))
    ranked = docs.withColumn("place", F.row_number().over(Window.partitionBy(run).orderBy(order_col))).where(F.col("place") <= most)
    return ranked.withColumn("quote", quote)


def evidence_completeness(findings: DataFrame, *, run: str) -> DataFrame:
    """(run, findings, complete, ratio) from (run, status) of findings."""
    complete = F.count_if(F.col("status") == "approved")
    return findings.groupBy(run).agg(F.count("*").alias("findings"), complete.alias("complete"), (complete / F.count("*")).alias("ratio"))


def review_queue(entities: DataFrame, evidence: DataFrame) -> DataFrame:
    """(entity_id, kind, status, claim_role): approved if all evidence is complete; an opportunity's own status counts too.

    ``entities`` has (entity_id, kind, own_status, evidence_ids), ``evidence`` (evidence_id, complete, claim_role).
    """
    rows = entities.select("entity_id", "kind", "own_status", F.explode_outer("evidence_ids").alias("evidence_id")).join(evidence.hint("merge"), "evidence_id", "left")
    done = F.bool_and(F.coalesce("complete", F.lit(False)))
    roles = F.collect_set("claim_role")
    g = rows.groupBy("entity_id", "kind", "own_status").agg(done.alias("done"), F.when(F.size(roles) == 1, roles[0]).alias("claim_role"))
    status = F.when((F.col("kind") == "opportunity") & (F.col("own_status") == "rejected"), "rejected").when(F.col("done") & ((F.col("kind") != "opportunity") | (F.col("own_status") == "approved")), "approved").otherwise("needs_review")
    return g.select("entity_id", "kind", status.alias("status"), "claim_role")


def accepted_evidence(evidence: DataFrame, docs: DataFrame, sources: DataFrame, policy: DataFrame) -> DataFrame:
    """Evidence whose document is accepted and has a URL, whose validation holds, and whose roles pass.

    ``evidence``: (evidence_id, doc_id, source, matched, source_ok, complete, claim_role, evidence_role); ``docs``: (doc_id,
    url, accepted, doc_role); ``sources``: (source, source_role).
    """
    j = evidence.join(docs, "doc_id").join(sources, "source", "left").where("accepted and url <> '' and matched and source_ok and complete")
    return role_gate(j, policy, roles=["evidence_role", "doc_role", "source_role"], claim_role="claim_role").where("role_failure is null")
