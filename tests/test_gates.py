"""Known noise blocks one by one, the gate over selected samples, and checks of a store with its audit and summary."""

from pyspark.sql import functions as F

from claimloom.operators import cleaning as C
from claimloom.plans import coverage as P


def test_known_blocks(spark):
    cases = {
        "x --> --> y": "x\ny",
        "a -->b --> c -> d": "a -->b\nc\nd",
        "vor 方太隐私声明 eins\nzwei 请勾选方太隐私协议 nach": "vor nach",
        "vor 尊敬的用户：您好《个人信息保护政策》请 确定 首页": "vor 首页",
        "vor 尊敬的用户：您好《个人信息保护政策》请 确定 其他": "vor 尊敬的用户：您好《个人信息保护政策》请 确定 其他",
        "vor\nwww.a.com # www.b.com is blocked for\nyou": "vor",
        "vor This page has been blocked by an extension x\nERR\\BLOCKED_BY_CLIENT nach": "vor nach",
        "One-time Discount Get up to 20% off + Free Shipping now\nnach": "nach",
        "vor 产品搜索 首页 资生堂日本 官方产品介绍网站 x © Shiseido y": "vor",
        "Shop NowShop Now": "Shop Now",
    }
    df = spark.createDataFrame([(n, x) for n, x in enumerate(cases)], "doc_id int, text string")
    got = {r.doc_id: r.text for r in C.drop_noise_lines(df).collect()}
    assert [got[n] for n in range(len(cases))] == list(cases.values())


def gate(spark, samples, assigned, axes, minimums, least_each=1):
    s = spark.createDataFrame(samples, "sample int, relationship string")
    a = spark.createDataFrame(assigned, "sample int, axis string, item string")
    x = spark.createDataFrame(axes, "axis string, item string")
    g = P.coverage_gate(s, a, x, spark.createDataFrame(minimums, "requirement string, least int"), least_each=least_each)
    gaps = [r.gap for r in P.gate_gaps(g, s, a, x).orderBy("phase", "place", "item").collect()]
    return {r.requirement: (r.found, r.least, r.status) for r in g.collect()}, gaps


def test_gate_passes(spark):
    rows, gaps = gate(spark, [(1, "direct_competitor"), (1, "direct_competitor")], [(1, "taxonomy", "t"), (1, "population", "p"), (9, "taxonomy", "u")], [("taxonomy", "t"), ("channel", "c")], [("population", 1), ("direct_competitor", 1)])
    assert all(r[2] == "pass" for r in rows.values()) and rows["direct_competitor"] == (1, 1, "pass") and rows["population"] == (1, 1, "pass")
    assert gaps == [P.GATE_PASSED]


def test_gate_gaps_in_order(spark):
    samples = [(1, "direct_competitor"), (2, "content_actor")]
    assigned = [(1, "taxonomy", "t1"), (2, "taxonomy", "t1"), (1, "taxonomy", "t2"), (1, "channel", "unknown")]
    axes = [("taxonomy", "t1"), ("taxonomy", "t2"), ("channel", "c"), ("value_chain", "v2"), ("value_chain", "v1")]
    rows, gaps = gate(spark, samples, assigned, axes, [("channel", 1), ("direct_competitor", 2), ("channel_actor", 1)], least_each=2)
    assert rows["taxonomy"] == (1, 2, P.BLOCKED) and rows["channel"] == (0, 1, P.BLOCKED) and rows["business_model"] == (0, 0, "pass")
    assert gaps == [P.GATE_BLOCKED, "uncovered_axis_item:v1", "uncovered_axis_item:v2", "uncovered_axis_item:c", "relationship_minimum:direct_competitor:1/2", "relationship_minimum:channel_actor:0/1"]


def test_gate_of_nothing(spark):
    rows, gaps = gate(spark, [], [], [], [])
    assert len(rows) == 10 and all(r == (0, 0, "pass") for r in rows.values()) and gaps == [P.GATE_PASSED]


def test_store_audit_and_summary(spark):
    from claimloom.operators import snapshots as V

    first = V.version_chain(V.content_address(spark.createDataFrame([(n, f"https://a.com/{n % 2}", f"text {n}") for n in range(4)], "captured_at int, url string, content string")))
    store = first.withColumns({"place": F.col("captured_at"), "run": F.lit("r"), "requests": F.lit(1), "credits": F.lit(1), "cost": F.lit(0.5)})
    assert V.verify_store(store).count() == 0
    copy = store.where("place = 2").withColumn("snapshot_id", F.lit("zz"))
    got = {(r.snapshot_id, r.violation) for r in V.verify_store(store.unionByName(copy)).collect()}
    assert got == {("zz", "id"), ("zz", "content_duplicate")}
    twice = {r.violation for r in V.verify_store(store.unionByName(store.where("place = 2"))).collect()}
    assert twice == {"duplicate", "content_duplicate"}

    events = store.select("place", "snapshot_id", "url", "requests", F.when(F.col("supersedes").isNull(), "stored_new_document").otherwise("stored_new_version").alias("action"))
    check = lambda e, s=store: {(r.place, r.violation) for r in V.verify_audit(s, e, same=["url"], usage=["requests"]).collect()}
    assert check(events) == set()
    assert check(events.where("place <> 1")) == {(1, "count")} and check(events, store.where("place <> 1")) == {(1, "count")}
    for column, value in {"snapshot_id": F.lit("x"), "url": F.lit(None).cast("string"), "requests": F.lit(-1), "action": F.lit("other")}.items():
        assert check(events.withColumn(column, F.when(F.col("place") == 3, value).otherwise(F.col(column)))) == {(3, "audit")}

    fresh = V.store_summary(store, run="run")
    assert V.verify_summary(fresh, fresh, run="run").count() == 0
    assert V.verify_summary(fresh.withColumn("versions", F.col("versions") + 1), fresh, run="run").count() == 1
    assert V.verify_summary(fresh.limit(0), fresh, run="run").count() == 1


def test_fresh_candidates(spark):
    rows = [("r", 1, "https://a.com/x"), ("r", 2, "https://A.com/x#top"), ("r", 3, "https://a.com/y"), ("r", 4, "no url"), ("r", 5, "no url"), ("q", 1, "https://a.com/y"), ("q", 2, None), ("q", 3, None)]
    c = spark.createDataFrame(rows, "run string, ord int, url string")
    fresh = lambda known: sorted((r.run, r.ord) for r in P.fresh_candidates(c, spark.createDataFrame(known, "run string, url string")).collect())
    assert fresh([]) == [("q", 1), ("q", 2), ("r", 1), ("r", 3), ("r", 4)]
    assert fresh([("r", "https://a.com/y#z"), ("q", "https://a.com/z")]) == [("q", 1), ("q", 2), ("r", 1), ("r", 4)]
    assert fresh([("r", "also none")]) == [("q", 1), ("q", 2), ("r", 1), ("r", 3)]
