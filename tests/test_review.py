"""Review operators on literal rows."""

import hashlib

from pyspark.sql import functions as F

from claimloom.operators import atomic, review


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_confirmable(spark):
    items = frame(spark, [(1, "approved", None, [1, 2, 1]), (2, "approved", "a", [1]), (3, "approved", "b", [1]), (4, "approved", None, []), (5, "needs_review", None, [1]), (6, "approved", None, [1, 9]), (7, "approved", None, [3]), (8, "approved", None, None), (9, "approved", None, [1])], "item_id long, status string, claim_role string, evidence_ids array<long>")
    evidence = frame(spark, [(1, True, "a", "Sales of 40 units"), (2, True, None, "x"), (3, False, None, "x"), (4, None, None, "y")], "evidence_id long, accepted boolean, claim_role string, quote string")
    claims = frame(spark, [(1, "top 40 sales"), (9, "40 sales"), (9, "market share of 7"), (2, "no number")], "item_id long, claim string")
    got = {r.item_id: r.confirmable for r in review.confirmable(items, evidence, claims).collect()}
    assert got == {1: False, 2: True, 3: False, 4: False, 5: False, 6: False, 7: False, 8: False, 9: False}
    again = {r.item_id: r.section for r in review.reviewed_split(items, frame(spark, [(5, "approved"), (2, "rejected")], "item_id long, status string"), evidence, claims.where("item_id = 2")).collect()}
    assert again == {1: "confirmed", 2: "rejected", 3: "candidate", 4: "candidate", 5: "confirmed", 6: "candidate", 7: "candidate", 8: "candidate", 9: "confirmed"}


def test_quote_context(spark):
    text = "a" * 150 + " the Quote here " + "b" * 500
    docs = frame(spark, [(1, "s", text, "short"), (2, "s", None, None)], "doc_id long, source string, text string, excerpt string")
    rows = [(1, 1, "s", "Quote here"), (2, None, "s", "quote x"), (3, 7, "t", "Quote"), (4, 1, "s", "  "), (5, 1, "s", "quote"), (6, 2, "s", "Quote here"), (7, 1, "s", None)]
    got = {r.evidence_id: r for r in review.quote_context(frame(spark, rows, "evidence_id long, doc_id long, source string, quote string"), docs).collect()}
    assert got[1].context == "a" * 95 + " the Quote here " + "b" * 99 and got[2].context == "a" * 95 + " the Quote here " + "b" * 349
    assert (got[3].doc_id, got[3].context) == (None, "") and got[4].context == got[5].context == got[7].context == "short" and got[6].context == ""


def test_lookup_guidance_blockers(spark):
    ids = frame(spark, [(1, [9, 1, 2, 1]), (2, []), (3, None)], "entity_id long, evidence_ids array<long>")
    evidence = frame(spark, [(1, 1, "s", "q"), (2, None, "t", "r")], "evidence_id long, doc_id long, source_id string, quote string")
    docs = frame(spark, [(1, "u", "title", "news")], "doc_id long, url string, title string, source_type string")
    got = review.evidence_lookup(ids, evidence, docs, frame(spark, [("t", "v", "T")], "source_id string, value string, source_title string"), most=2).orderBy("place").collect()
    assert [tuple(r) for r in got] == [(1, 1, 1, "q", "u", "title", "news"), (1, 2, 2, "r", "v", "T", None)]
    rows = [(1, False, 0, 0, 0, 0), (2, True, 0, 0, 0, 1), (3, True, 0, 0, 1, 0), (4, True, 1, 1, 1, 9), (5, True, 1, 1, 0, 0), (6, True, 1, 0, 1, 1)]
    runs = frame(spark, rows, "run long, external boolean, accepted long, confirmed long, hypotheses long, failures long")
    assert [r.readiness for r in review.decision_guidance(runs).orderBy("run").collect()] == ["contract_only", "technical_blocked", "evidence_gap", "validation_ready", "ready_for_human_review", "evidence_gap"]
    jobs = frame(spark, [(1, k, "needs_review", k != 3) for k in range(16)], "run long, job_id long, status string, failed boolean")
    out = review.blockers(frame(spark, [(1, True), (2, False)], "run long, fallback boolean"), frame(spark, [(1,)], "run long"), frame(spark, [(2, 5, "failed")], "run long, crawl_id long, status string"), jobs)
    found = sorted((r.run, r.kind, r.id or 0, r.n) for r in out.collect())
    assert len(found) == 16 and (1, "more_extractions", 0, 3) in found and (2, "no_documents", 0, 1) in found and (2, "crawl_failed", 5, 1) in found and (1, "fallback", 0, 1) in found
    assert max(i for r, kind, i, n in found if kind == "extraction_failed") == 12


def test_atomic_claims(spark):
    text = "Before. The tank holds 4 l. After."
    candidates = [
        (1, "a", " The tank holds 4 l. ", "m", "https://x.y/1", "The tank holds 4 l."), (2, "a", "The tank holds 4 l", "m", "https://x.y/1", "The tank holds 4 l."), (3, "b", "abc", "n", "nowhere", "none"),
        (4, "", "A! B? 此外 C", "m", "https://x.y/2", ""), (5, None, None, None, None, None),
    ]
    c = frame(spark, candidates, "place long, candidate_id string, statement string, claim_role string, url string, quote string")
    docs = frame(spark, [(1, "https://x.y/1", 7, "old"), (2, "https://www.x.y/1", 8, text)], "place long, url string, doc_id long, text string")
    relevant = frame(spark, [(1, "https://x.y/1", "r"), (1, "https://x.y/2", "q")], "place long, url string, source_role string")
    routes = frame(spark, [(1, "https://x.y/1", "t", "o", "r"), (1, "https://x.y/2", "t", "o", "r")], "place long, url string, task_id string, route_id string, source_role string")
    stored = frame(spark, [(1, "https://x.y/1", "raw", "t", "o", "r"), (1, "https://x.y/2", "raw2", "t", "p", "r")], "place long, url string, document_id string, task_id string, route_id string, source_role string")
    tasks = frame(spark, [("t", "row", ["m"])], "task_id string, coverage_row string, target_roles array<string>")
    policy = frame(spark, [("r", "m")], "source_role string, claim_role string")
    out = {r.place: r for r in atomic.atomic_claims(c, docs, relevant, routes, stored, tasks, policy).collect()}
    assert (out[1].failures, out[1].doc_id, out[1].quote_start, out[1].quote_end, out[1].coverage_row) == ([], 8, 8, 27, "row")
    assert out[1].content_hash == hashlib.sha256(text.encode()).hexdigest()
    assert out[2].failures == ["candidate_id_duplicate", "statement_not_directly_supported_by_quote"] or out[2].failures == ["candidate_id_duplicate"]
    assert out[3].failures == [
        "atomic_statement_too_short", "candidate_source_url_invalid", "m2_strong_relevance_gate_failed", "extracted_raw_document_missing", "acquisition_route_missing", "immutable_raw_document_missing",
        "acquisition_task_missing", "quote_not_exactly_matched", "statement_not_directly_supported_by_quote",
    ]
    assert out[4].failures == [
        "compound_statement_requires_split", "multiple_sentences_require_split", "candidate_id_required", "extracted_raw_document_missing", "m2_source_role_mismatch", "immutable_route_binding_mismatch", "quote_required", "quote_not_exactly_matched",
    ]
    assert "candidate_id_required" in out[5].failures
    good = atomic.atomic_claims(c, docs, relevant, routes, stored, tasks, policy).where("size(failures) = 0").withColumn("claim_id", F.col("candidate_id"))
    seen = frame(spark, [("https://x.y/1", "r", "t")], "url string, source_role string, task_id string")
    audit = lambda claims, docs=docs, seen=seen: atomic.audit_claims(claims, docs, stored, seen, policy).first().failure
    assert audit(good) is None and audit(good.withColumn("quote_start", F.lit(9))) == "quote_offsets_mismatch" and audit(good.withColumn("task_id", F.lit("u"))) == "immutable_binding_mismatch"
    assert audit(good, docs.union(docs)) == "extracted_version_not_unique" and audit(good, seen=seen.limit(0)) == "m2_relevance_binding_missing" and audit(good.withColumn("source_url", F.lit("x"))) == "claim_source_url_invalid"
    roles = frame(spark, [("m",), ("n",)], "claim_role string")
    assert sorted(tuple(r) for r in atomic.spot_check(good, roles).collect()) == [("m", "a", None), ("n", None, "representative_claim_role_missing:n")]


def test_hypothesis_gate(spark):
    fine = dict(place=1, hypothesis_id="h", title="待验证：x", statement="可能 x", problem="long enough", target_user="owners", claim_ids=["c", "c"], assumptions=["a"], unknowns=["u", "v"], method="m", participants="p", sample_size=3, steps=["s"], success=["2 of 3"], failure=["0"], stops=["s"], permission="L5", execution="not_started")
    bad = dict(fine, place=3, hypothesis_id="k", title="x", statement="必然", claim_ids=["z", "c", "y"], unknowns=["u"], sample_size=None, failure=["few"], execution="started")
    rows = [fine, dict(fine, place=2), bad, dict(fine, place=4, hypothesis_id="l", claim_ids=[], steps=[" "])]
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'long' if isinstance(v, int) else 'string'}" for k, v in fine.items())
    got = {r.place: r.failures for r in atomic.hypothesis_gate(frame(spark, [tuple(r.values()) for r in rows], schema), frame(spark, [("c",)], "claim_id string")).collect()}
    assert got[1] == [] and got[2] == ["hypothesis_id_duplicate"] and got[4] == ["supporting_atomic_claim_required", "validation_steps_required"]
    assert got[3] == [
        "hypothesis_title_must_be_explicitly_unverified", "hypothesis_uncertainty_language_required", "commercialization_or_certainty_conclusion_forbidden", "supporting_atomic_claim_missing:z", "supporting_atomic_claim_missing:y",
        "at_least_two_unknowns_required", "validation_minimum_sample_size_below_3", "validation_criteria_must_be_measurable", "validation_must_remain_not_started_behind_L5",
    ]
