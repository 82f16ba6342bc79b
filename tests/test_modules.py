"""Module results: a claim for each check, then rows and statuses of modules."""

import pytest
from pyspark.sql import functions as F

from claimloom.plans import modules as M

TEXT = "The kitchen appliance maker sold many quiet dishwashers to families during spring."
QUOTE = "quiet dishwashers to families"


@pytest.fixture(scope="module")
def tables(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    ev = {  # evidence_id: quote, source, doc, claim_role, source_role, accepted
        "ok": (QUOTE, "s1", "d1", "fact", None, True), "role": (QUOTE, "s1", "d1", "other", None, True), "no doc": (QUOTE, "s1", None, "fact", None, True), "no source": (QUOTE, "s9", "d1", "fact", None, True),
        "gate": (QUOTE, "s1", "d1", "fact", None, False), "conflict": (QUOTE, "s1", "d1", "fact", "media", True), "not found": ("words of no document", "s1", "d1", "fact", None, True), "elsewhere": ("only in the other document", "s1", "d1", "fact", None, True),
        "tiny": ("qui", "s1", "d1", "fact", None, True), "blank": (" 　", "s1", "d1", "fact", None, True), "weak": (QUOTE, "s2", "d2", "fact", None, True), "need": (QUOTE, "s1", "d1", "consumer_need", None, True),
        "report": (QUOTE + " profit", "s3", "d3", "fact", None, True), "no role": (QUOTE, "s4", "d4", "fact", None, True), "policy": (QUOTE, "s5", "d5", "fact", None, True), "repeated": (QUOTE, "s1", "d6", "fact", None, True),
    }
    docs = [("d1", "s1", "https://shop.example/1", TEXT, "brand", "page", True), ("d2", "s2", "https://b.example", "It is only in the other document: " + QUOTE, "brand", "robots", False), ("d3", "s3", "u3", QUOTE + " profit", "financial_report", "page", True),
        ("d4", "s4", "u4", TEXT, None, None, True), ("d5", "s5", "u5", TEXT, "stranger", "page", True), ("d6", "s1", "https://shop.example/2", TEXT, "brand", "page", True), ("d7", None, None, None, None, None, None)]
    return {
        "evidence": df([(k, *v) for k, v in ev.items()] + [(None,) * 6 + (None,)], "evidence_id string, quote string, source string, doc string, claim_role string, source_role string, accepted boolean"),
        "documents": df(docs, "doc string, source string, url string, text string, role string, doc_type string, confirmable boolean"),
        "sources": df([("s1", "brand"), ("s2", "brand"), ("s3", "financial_report"), ("s4", None), ("s5", "stranger")], "source string, role string"),
        "rows": df([(m, "need", ["i1", "i2"]) for m in M.SAMPLE_RELATIONSHIPS], "module string, axis string, axis_items array<string>"),
        "samples": df([("p1", "direct_competitor"), ("p2", "content_actor"), ("p3", "direct_competitor"), ("p4", "direct_competitor")], "sample string, relationship string"),
        "assignments": df([("p1", "need", "i1"), ("p2", "need", "i1"), ("p3", "other axis", "i1")], "sample string, axis string, item string"),
        "module_roles": df([(m, r) for m in M.SAMPLE_RELATIONSHIPS for r in ("fact", "consumer_need")], "module string, claim_role string"),
        "policy": df([(s, r) for s in ("brand", "financial_report") for r in ("fact", "consumer_need")], "source_role string, claim_role string"),
    }


def judge(spark, tables, claims):
    schema = "claim string, claim_id string, module string, statement string, claim_role string, evidence_ids array<string>, items array<string>, samples array<string>"
    full = [(name, *({"claim_id": name, "module": "consumer_demand", "statement": QUOTE, "claim_role": "fact", "evidence_ids": ["ok"], "items": ["i1"], "samples": []} | c).values()) for name, c in claims.items()]
    out = M.module_claims(spark.createDataFrame(full, schema), tables["evidence"], tables["documents"], tables["sources"], **{k: v for k, v in tables.items() if k not in ("evidence", "documents", "sources")})
    return {r.claim: r for r in out.collect()}


def test_each_check(spark, tables):
    v = "evidence_validation_failed:"
    cases = {
        "good": ({}, []),
        "no id": ({"claim_id": " "}, ["claim_id_required"]),
        "no statement": ({"statement": None}, ["claim_statement_required"]),
        "role": ({"claim_role": "odd", "evidence_ids": ["role"]}, ["claim_role_not_allowed_for_module:odd", "evidence_claim_role_mismatch:role", "source_role_not_authorized:brand:other", v + "role:source_role_not_authorized:brand:odd"]),
        "no evidence": ({"evidence_ids": []}, ["claim_evidence_required"]),
        "null lists": ({"evidence_ids": None, "items": None, "samples": None}, ["claim_evidence_required"]),
        "items": ({"items": ["x", "i1", "y", "x"]}, ["unknown_axis_item:x", "unknown_axis_item:y"]),
        "samples": ({"samples": ["p1", "p9", "p2", "p3", "p4"]}, ["unknown_representative_sample:p9", "sample_relationship_not_allowed:p2", "sample_does_not_cover_claim_axis:p3", "sample_does_not_cover_claim_axis:p4"]),
        "missing": ({"evidence_ids": ["gone", "ok", "gone2"]}, ["claim_evidence_missing"]),
        "no doc": ({"evidence_ids": ["no doc"]}, ["raw_document_missing:no doc"]),
        "no source": ({"evidence_ids": ["no source"]}, ["source_missing:no source", "evidence_raw_source_mismatch:no source"]),
        "gate": ({"evidence_ids": ["gate"]}, ["evidence_role_gate_failed:gate"]),
        "conflict": ({"evidence_ids": ["conflict"]}, ["source_role_conflict"]),
        "not found": ({"statement": "words", "evidence_ids": ["not found"]}, [v + "not found:quote_not_found_in_raw_documents"]),
        "elsewhere": ({"statement": "document", "evidence_ids": ["elsewhere"]}, [v + "elsewhere:evidence_reference_mismatch"]),
        "tiny": ({"statement": "q", "evidence_ids": ["tiny"]}, [v + "tiny:quote_not_found_in_raw_documents"]),
        "blank": ({"evidence_ids": ["blank"]}, [v + "blank:missing_evidence_quote"]),
        "weak": ({"evidence_ids": ["weak"]}, [v + "weak:source_not_confirmable:robots"]),
        "no role": ({"evidence_ids": ["no role"]}, ["source_role_missing", v + "no role:source_role_missing"]),
        "policy": ({"evidence_ids": ["policy"]}, ["source_role_policy_missing", v + "policy:source_role_policy_missing"]),
        "risk": ({"statement": "Top 3 quiet dishwashers families"}, [v + "ok:high_risk_claim_not_directly_quoted"]),
        "uncovered": ({"statement": "entirely different wording throughout"}, [v + "ok:important_claim_text_not_covered_by_quotes"]),
        "by its url": ({"statement": "shop example"}, []),
        "need": ({"claim_role": "consumer_need", "statement": "demand quiet dishwashers", "evidence_ids": ["need"]}, [v + "need:demand_inference_without_direct_user_evidence"]),
        "two": ({"evidence_ids": ["repeated", "gate", "ok", "gate"]}, ["evidence_role_gate_failed:gate"]),
        "conversion": ({"module": "content_and_traffic", "statement": QUOTE + " Conversion"}, ["content_metrics_cannot_support_conversion_claim"]),
        "wide": ({"module": "ecommerce_competitor_research", "statement": QUOTE + " industry-wide"}, ["brand_claim_cannot_be_industry_wide"]),
        "profit": ({"module": "business_model_and_supply_chain", "statement": QUOTE + " profit"}, ["profitability_requires_financial_report"]),
        "reported profit": ({"module": "business_model_and_supply_chain", "statement": QUOTE + " profit", "evidence_ids": ["report"]}, []),
    }
    got = judge(spark, tables, {k: c for k, (c, _) in cases.items()})
    assert {k: r.failures for k, r in got.items()} == {k: f for k, (_, f) in cases.items()}
    assert all((r.status == "confirmed") == (not r.failures) for r in got.values())
    assert got["good"].sources == ["s1"] and got["good"].source_roles == ["brand"] and got["gate"].sources == []
    assert judge(spark, tables, {"good": {}})["good"].status == "confirmed"


def test_coverage_and_status(spark):
    claims = spark.createDataFrame([(1, "m", ["a", "b"], ["p"], ["s1"], ["r1"]), (2, "m", ["b", "z"], [], ["s1", "s2"], ["r1"]), (3, "n", ["a"], [], ["s9"], ["r9"])], "claim long, module string, items array<string>, samples array<string>, sources array<string>, source_roles array<string>")
    rows = spark.createDataFrame([("m", 1, "x", ["a", "b"], 2, 1, 0), ("m", 2, "x", ["a", "b"], 1, 2, 1), ("m", 3, "x", ["c"], 1, 1, 2), ("n", 4, "x", ["a"], 1, 1, 0), ("o", 5, "x", ["a"], 0, 0, 0)], "module string, row_id int, axis string, axis_items array<string>, min_sources int, min_roles int, min_samples int")
    assigned = spark.createDataFrame([("p", "x", "b"), ("p", "y", "a")], "sample string, axis string, item string")
    out = M.module_coverage(claims, rows, assigned)
    got = {r.row_id: (r.covered, r.gaps, r.status) for r in out.collect()}
    assert got == {
        1: (2, [], "pass"), 2: (1, ["source_roles:1/2", "uncovered_axis_items:a"], "blocked"),
        3: (0, ["independent_sources:0/1", "source_roles:0/1", "representative_samples:0/2", "uncovered_axis_items:c"], "blocked"), 4: (1, [], "pass"), 5: (0, ["uncovered_axis_items:a"], "blocked"),
    }
    status = M.module_status(rows.select("module").distinct(), claims.withColumn("status", F.lit("confirmed")), out)
    assert {r.module: r.status for r in status.collect()} == {"m": "blocked_insufficient_coverage", "n": "complete", "o": "blocked_missing_evidence"}
