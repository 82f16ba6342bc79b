"""Review of claims: what can be confirmed, where evidence stands, and what a run still lacks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.text import SPACE
from claimloom.operators.evidence import high_risk, must_quote, normalize_text


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def confirmable(items: DataFrame, evidence: DataFrame, claims: DataFrame) -> DataFrame:
    """(item_id, confirmable) for every row of ``items`` (item_id, status, claim_role, evidence_ids).

    An approved item is confirmable if it has evidence and all of it is accepted, if all of it has the item's claim role
    (unless that is null), and if each high-risk claim of the item has its numbers and markers in one accepted quote.
    ``evidence`` has (evidence_id, accepted, claim_role, quote), ids being unique; ``claims`` (item_id, claim).
    Ids without evidence aren't accepted. Item ids must be unique.
    """
    asked = items.select("item_id", F.col("claim_role").alias("_role"), F.explode(F.array_distinct("evidence_ids")).alias("evidence_id"))
    roles = evidence.select("evidence_id", F.coalesce("accepted", F.lit(False)).alias("accepted"), F.col("claim_role").alias("_theirs"))
    rows = asked.join(roles.hint("merge"), "evidence_id", "left")
    gate = rows.groupBy("item_id").agg(
        F.bool_and(F.coalesce("accepted", F.lit(False))).alias("accepted"),
        F.bool_and(F.col("_role").isNull() | F.coalesce(F.col("_theirs") == F.col("_role"), F.lit(False))).alias("roles"),
    )
    risky = claims.where(high_risk(F.col("claim"))).select("item_id", F.xxhash64("claim").alias("_claim"), must_quote(F.col("claim")).alias("must"))
    quotes = evidence.where("accepted").select("evidence_id", normalize_text(F.col("quote")).alias("quote"))
    own = asked.join(risky.select("item_id").distinct().hint("merge"), "item_id", "left_semi").join(quotes.hint("merge"), "evidence_id").select("item_id", "quote")
    held = risky.join(own.hint("merge"), "item_id", "left").groupBy("item_id", "_claim").agg(F.bool_or(F.coalesce(F.forall("must", lambda x: F.col("quote").contains(x)), F.lit(False))).alias("held"))
    quoted = held.groupBy("item_id").agg(F.bool_and("held").alias("quoted"))
    j = items.join(gate.hint("merge"), "item_id", "left").join(quoted.hint("merge"), "item_id", "left")
    ok = (F.col("status") == "approved") & F.col("accepted") & F.col("roles") & F.coalesce("quoted", F.lit(True))
    return j.select("item_id", F.coalesce(ok, F.lit(False)).alias("confirmable"))


def credibility_metrics(docs: DataFrame, evidence: DataFrame, items: DataFrame, crawls: DataFrame, *, run: str) -> DataFrame:
    """One row of counts for each run that any table has; what a table lacks counts 0.

    ``docs`` has (run, low_quality), ``evidence`` (run, accepted), ``items`` (run, status, confirmable), ``crawls``
    (run, failed, fallback).
    """
    open_item = (F.col("status") != "rejected") & ~F.col("confirmable")
    parts = [
        docs.groupBy(run).agg(F.count("*").alias("crawled_documents"), F.count_if("low_quality").alias("low_quality_sources")),
        evidence.groupBy(run).agg(F.count_if("accepted").alias("effective_evidence")),
        items.groupBy(run).agg(F.count_if("confirmable").alias("confirmed_findings"), F.count_if(open_item).alias("needs_review_findings")),
        crawls.groupBy(run).agg(F.count_if("failed").alias("crawl_failures"), F.bool_or("fallback").alias("llm_fallback")),
    ]
    joined = reduce(lambda a, b: a.join(b.hint("merge"), run, "full"), parts)
    counts = [c for p in parts for c in p.columns if c not in (run, "llm_fallback")]
    return joined.select(run, *(F.coalesce(c, F.lit(0)).alias(c) for c in counts), F.coalesce("llm_fallback", F.lit(False)).alias("llm_fallback"))


def quote_context(evidence: DataFrame, docs: DataFrame, *, around: int = 100, beyond: int = 360) -> DataFrame:
    """(evidence_id, doc_id, context): what stands around a quote in its document.

    The document is the one named by ``doc_id``, else the first (smallest id) of the evidence's source. An exact hit gives
    ``around`` characters on both sides; else, for quotes of two words or more, a window at the first word, whatever its
    case; without that the document's ``excerpt``. Blank quotes and unknown documents give the excerpt or an empty text.
    ``evidence`` has (evidence_id, doc_id, source, quote), ``docs`` (doc_id, source, text, excerpt), ids being unique.
    """
    known = docs.select(F.col("doc_id").alias("_known"))
    first = docs.groupBy("source").agg(F.min("doc_id").alias("_first"))
    named = evidence.join(known.hint("merge"), F.col("doc_id") == F.col("_known"), "left").join(first.hint("merge"), "source", "left")
    named = named.select("evidence_id", "quote", F.coalesce("_known", "_first").alias("_doc"))
    j = named.join(docs.select(F.col("doc_id").alias("_doc"), "text", "excerpt").hint("merge"), "_doc", "left")
    quote = F.coalesce("quote", F.lit(""))
    words = F.filter(F.split(trimmed(quote), SPACE + "+"), lambda w: w != "")
    text = F.coalesce("text", F.lit(""))
    exact = F.instr(text, quote)
    near = F.instr(F.lower(text), F.lower(F.try_element_at(words, F.lit(1))))

    def window(at: Column, size: Column | int) -> Column:  # from ``around`` characters before the 1-based place ``at``
        start = F.greatest(F.lit(1), at - around)
        return trimmed(F.substring(text, start, at + size - start))

    context = (
        F.when((trimmed(quote) == "") | F.col("text").isNull(), "")
        .when(exact > 0, window(exact, F.length(quote) + around)).when((F.size(words) > 1) & (near > 0), window(near, beyond)).otherwise("")
    )
    return j.select("evidence_id", F.col("_doc").alias("doc_id"), F.coalesce(F.nullif(context, F.lit("")), "excerpt", F.lit("")).alias("context"))


def evidence_lookup(entities: DataFrame, evidence: DataFrame, docs: DataFrame, sources: DataFrame, *, most: int = 6) -> DataFrame:
    """(entity_id, place, evidence_id, quote, url, source, reliability): of each entity the first ``most`` ids that exist.

    The URL is the document's, else the source's; the title is the source's, else the document's. ``entities`` has
    (entity_id, evidence_ids), ``evidence`` (evidence_id, doc_id, source_id, quote), ``docs`` (doc_id, url, title,
    source_type), ``sources`` (source_id, value, source_title).
    """
    asked = entities.select("entity_id", F.posexplode("evidence_ids").alias("_pos", "evidence_id"))
    found = asked.join(evidence.hint("merge"), "evidence_id")
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("entity_id").orderBy("_pos"))).where(F.col("place") <= most)
    j = found.join(docs.hint("merge"), "doc_id", "left").join(sources.hint("merge"), "source_id", "left")
    return j.select("entity_id", "place", "evidence_id", "quote", F.coalesce("url", "value").alias("url"), F.coalesce("source_title", "title").alias("source"), F.col("source_type").alias("reliability"))


def decision_guidance(runs: DataFrame) -> DataFrame:
    """(run, readiness, commercialization) from (run, external, accepted, confirmed, hypotheses, failures) per run.

    ``external`` tells whether real evidence was looked for at all; a technical failure without evidence says nothing
    about the market, and only a hypothesis on confirmed findings is ready for validation.
    """
    readiness = (
        F.when(~F.col("external"), "contract_only").when((F.col("failures") > 0) & (F.col("accepted") == 0), "technical_blocked")
        .when((F.col("accepted") == 0) | (F.col("confirmed") == 0), "evidence_gap").when(F.col("hypotheses") > 0, "validation_ready").otherwise("ready_for_human_review")
    )
    return runs.select("run", readiness.alias("readiness")).withColumn("commercialization", F.when(F.col("readiness") == "validation_ready", "requires_real_world_validation").otherwise("not_evaluated"))


def reviewed_split(items: DataFrame, overrides: DataFrame, evidence: DataFrame, claims: DataFrame) -> DataFrame:
    """(item_id, status, section): reviewers' statuses replace those of ``items``, and the report's lists are built anew.

    ``overrides`` has (item_id, status), one row an item at most; the other tables are those of ``confirmable``. Sections
    are confirmed, candidate (neither confirmable nor rejected) and rejected.
    """
    theirs = overrides.select("item_id", F.col("status").alias("_status"))
    now = items.join(theirs.hint("merge"), "item_id", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")
    j = now.select("item_id", "status").join(confirmable(now, evidence, claims).hint("merge"), "item_id")
    return j.select("item_id", "status", F.when(F.col("confirmable"), "confirmed").when(F.col("status") == "rejected", "rejected").otherwise("candidate").alias("section"))


def blockers(runs: DataFrame, docs: DataFrame, crawls: DataFrame, jobs: DataFrame, *, most: int = 12) -> DataFrame:
    """(run, kind, id, n) of all that stands in the way of a run.

    ``no_documents``; each failed crawl; the first ``most`` extraction jobs (by id) that failed and await review, and how
    many more there are (``more_extractions``, n); ``fallback``. ``runs`` has (run, fallback), ``docs`` (run), ``crawls``
    (run, crawl_id, status), ``jobs`` (run, job_id, status, failed).
    """
    none, one = F.lit(None).cast("long"), F.lit(1).cast("long")
    row = lambda df, kind, id_col=none, n=one: df.select("run", F.lit(kind).alias("kind"), id_col.cast("long").alias("id"), n.cast("long").alias("n"))
    waiting = jobs.where("status = 'needs_review' and failed").withColumn("_place", F.row_number().over(Window.partitionBy("run").orderBy("job_id"))).where(F.col("_place") <= most)
    counted = jobs.where("status = 'needs_review' and failed").groupBy("run").agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    parts = [
        row(runs.join(docs.select("run").distinct().hint("merge"), "run", "left_anti"), "no_documents"),
        row(crawls.where("status = 'failed'"), "crawl_failed", F.col("crawl_id")),
        row(waiting, "extraction_failed", F.col("job_id")),
        row(counted, "more_extractions", n=F.col("_n") - most),
        row(runs.where("fallback"), "fallback"),
    ]
    return reduce(DataFrame.unionByName, parts)
