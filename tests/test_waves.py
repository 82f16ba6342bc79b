"""Wave verification: one document for each rule."""

import pytest

from claimloom.plans import waves

RECORD = "洗碗机 洗碗机 GB/T 4706.25-2008 发布单位 发布日期"


def audit(spark, docs, routes, **more):
    d = spark.createDataFrame(docs, "id string, url string, title string, text string, accepted boolean")
    r = spark.createDataFrame(routes, "ord int, reference string, route_id string, task_id string, role string")
    return waves.verify_wave(d, r, terms=["洗碗机", "Dish Washer"], conflicts=["洗衣机", "Dryer"], **more)


def test_each_status(spark):
    routes = [(1, "https://a.com/x", "r1", "t1", "regulator"), (2, "https://a.com/y", "r2", "t1", "media"), (3, "https://a.com/x", "r3", "t2", "regulator"), (4, "no url", "r4", "t3", "media")]
    docs = [
        ("relevant", "https://a.com/y", "dishwasher", "DISH　WASHER", True),
        ("one hit", "https://a.com/y", "", "洗碗机", True),
        ("conflict in url", "https://a.com/y?q=dryer", "洗碗机", "洗碗机", True),
        ("conflict in title", "https://a.com/y", "d r y e r 洗碗机", "洗碗机", True),
        ("conflict in text only", "https://a.com/y", "洗碗机", "洗碗机 dryer", True),
        ("no route", "https://a.com/z", "洗碗机", "洗碗机", True),
        ("pdf", "https://a.com/x", "", " \n%PDF-1.4 " + RECORD, True),
        ("not accepted", "https://a.com/y", "", RECORD, False),
        ("official record", "https://a.com/x", "", RECORD, False),
        ("number in a word", "https://a.com/x", "", RECORD.replace("GB", "XGB"), False),
        ("number after Han", "https://a.com/x", "", RECORD.replace(" GB", "按GB"), False),
        ("one term of a record", "https://a.com/x", "", RECORD.replace("发布日期", ""), False),
        ("nulls", None, None, None, None),
        ("nulls routed", "https://a.com/y", None, None, None),
    ]
    rows = {r.id: r for r in audit(spark, docs, routes).collect()}
    want = {
        "relevant": waves.RELEVANT, "one hit": "category_relevance_mismatch", "conflict in url": "route_missing", "conflict in title": "category_relevance_mismatch", "conflict in text only": waves.RELEVANT, "no route": "route_missing",
        "pdf": "source_quality_rejected", "not accepted": "source_quality_rejected", "official record": waves.RELEVANT, "number in a word": "source_quality_rejected", "number after Han": waves.RELEVANT,
        "one term of a record": "source_quality_rejected", "nulls": "route_missing", "nulls routed": "source_quality_rejected",
    }
    assert {k: r.status for k, r in rows.items()} == want
    assert rows["official record"].route_id == "r3" and rows["official record"].task_id == "t2"  # the last route of a URL
    assert rows["relevant"].hits == 2 and rows["conflict in url"].conflicting == ["Dryer"]
    assert rows["pdf"].binary and rows["pdf"].override and not rows["relevant"].override


def test_terms_are_needed(spark):
    with pytest.raises(ValueError):
        waves.verify_wave(spark.range(1), spark.range(1), terms=[])
    with pytest.raises(ValueError):
        audit(spark, [], []).sparkSession and waves.squeeze([" 　"])


def test_coverage_and_decision(spark):
    routes = [(n, f"https://{h}.com/{n}", f"r{n}", t, role) for n, (h, t, role) in enumerate([("a", "t1", "media"), ("www.a", "t1", "media"), ("b", "t1", "regulator"), ("c", "t2", "media")])]
    docs = [(str(n), r[1], "洗碗机", "洗碗机", True) for n, r in enumerate(routes)]
    found = audit(spark, docs, routes)
    tasks = spark.createDataFrame([("t1", 2, 2, 0, "critical"), ("t2", 2, 2, 1, "normal"), ("t3", 0, 0, 0, "normal")], "task_id string, min_sources int, min_roles int, min_samples int, priority string")
    cover = waves.wave_coverage(found, tasks)
    got = {r.task_id: (r.docs, r.hosts, r.roles, r.gaps, r.status) for r in cover.collect()}
    assert got["t1"] == (3, 2, 2, [], waves.MET) and got["t3"] == (0, 0, 0, [], waves.MET)
    assert got["t2"] == (1, 1, 1, ["independent_source_coverage_missing", "source_role_coverage_missing", "representative_sample_coverage_missing"], "raw_candidate_gap")
    (one,) = waves.wave_decision(found, cover, tasks).collect()
    assert (one.documents, one.relevant, one.met, one.gaps, one.critical_met, one.critical_gaps, one.next_action) == (4, 4, 2, 1, 1, 0, "begin_m3_claim_extraction")
    (one,) = waves.wave_decision(found, cover, tasks.withColumn("priority", tasks.priority.isNotNull().cast("string")).replace("true", "critical", "priority")).collect()
    assert one.critical_gaps == 1 and one.reason == "critical_raw_candidate_coverage_gaps_remain"
