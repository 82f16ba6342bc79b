"""Database tables of runs: what binds a website, which topics it gets, keywords, numbers, weekly reports and replacement."""

import random
import re

import pytest
from pyspark.sql import functions as F

from claimloom.operators import databases as D

ENTITY = "run string, ord long, id string, evidence_ids array<string>"
OWN = {
    "competitors": "name string, channel string, positioning string, sections array<string>, commerce array<string>",
    "products": "competitor string, category string, signal string, tags array<string>",
    "pains": "theme string, need string, frequency long",
    "contents": "platform string, topic string, content_type string, why string",
    "opportunities": "title string, summary string, total int, review string",
}


def made(spark, evidence=(), documents=(), projects=(("r", "cat", "mk"),), **entities):
    tables = [spark.createDataFrame([(*x, *([None] * (len(OWN[name].split(", ")) + 4 - len(x)))) for x in entities.get(name, ())], f"{ENTITY}, {own}") for name, own in OWN.items()]
    return D.build_databases(
        spark.createDataFrame(list(projects), "run string, category string, market string"), *tables,
        spark.createDataFrame(list(evidence), "run string, evidence string, ord long, source string, document string, new boolean"),
        spark.createDataFrame(list(documents), "run string, document string, url string"), week="2026-06-01",
    )


def test_websites_and_topics(spark):
    evidence = [("r", f"e{k}", k, s, d, True) for k, (s, d) in enumerate([("s1", "d1"), ("s1", "d2"), ("s2", "d3"), ("s3", None), ("s4", "d4"), ("s5", "gone"), ("s6", "d5")])] + [("q", "e0", 0, "s1", "d1", True)]
    documents = [("r", "d1", "https://A.example.com:8080/x"), ("r", "d2", "http://u@a.example.com/y"), ("r", "d3", "https://www.a.example.com/"), ("r", "d4", "no url"), ("r", "d5", "")]
    competitors = [
        ("r", 0, "one", ["e1", "e0", "e3", "e1", "missing"]), ("r", 1, "two hosts", ["e0", "e2"]), ("r", 2, "unbound", ["e3"]), ("r", 3, "bare", ["e4"]), ("r", 4, "document gone", ["e5"]), ("r", 5, "none", None), ("r", 6, "empty url", ["e6"]), ("q", 0, "one", ["e0"]),
    ]
    contents = [("r", 0, "t1", ["e3"], "p", "Topic"), ("r", 1, "t2", ["e0", "e1"], "p", "Other"), ("r", 2, "t3", ["e4"], "p", "Topic"), ("r", 3, "t4", None, "p", "Lost"), ("q", 0, "t5", ["e0"], "p", "Elsewhere")]
    out = made(spark, evidence, documents, competitors=competitors, contents=contents)
    sites = {x.competitor: (x.url, x.source_ids) for x in out["website_structure_database"].collect()}
    assert sites == {"one": ("http://u@a.example.com/y", ["s1", "s3"]), "bare": ("no url", ["s4"])}
    assert {(x.competitor, x.content, x.topic) for x in out["website_topics"].collect()} == {("one", "t1", "Topic"), ("one", "t2", "Other"), ("bare", "t3", "Topic")}
    assert {x.competitor: x.source_ids for x in out["competitor_database"].collect()}["none"] == []


def _many_signals():
    """Websites and signals in two runs: one source that many share, some with all sources, ids of both the same."""
    r = random.Random(5)
    evidence = [(run, f"e{k}", k, None if k == 30 else "hot" if k % 3 == 0 else f"s{k % 8}", f"d{k}" if k % 7 else None, True) for run in "rq" for k in range(31)]
    documents = [(run, f"d{k}", f"https://a.example.com/{k}") for run in "rq" for k in range(31)]
    some = lambda k: [f"e{k}" for k in range(31)] if k % 9 == 0 else [f"e{r.randrange(34)}" for _ in range(k % 6)]
    competitors = [(run, k, f"x{k}", some(k)) for run in "rq" for k in range(25)]
    contents = [(run, k, f"x{k}", some(k), "p", f"Topic {k % 4}") for run in "rq" for k in range(40)]
    source = {(run, e): s for run, e, _, s, _, _ in evidence}
    bound = {(run, e) for run, e, _, _, d, _ in evidence if d}
    of = lambda x: {source.get((x[0], e)) for e in x[3]} - {None}
    want = sorted((a[0], b[2], a[2], b[1], b[5]) for a in competitors for b in contents if a[0] == b[0] and of(a) & of(b) and any((a[0], e) in bound for e in a[3]))
    return evidence, documents, competitors, contents, want


@pytest.mark.parametrize("sizes", [{}, {"SITES": 3, "SIGNALS": 4, "TASK_ROWS": 50}, {"LISTED": 2, "FEW_SOURCES": 0}, {"LISTED": 0, "SITES": 1}])
def test_a_signal_meets_a_website_once_however_many_sources_they_share(spark, monkeypatch, sizes):
    for name, n in sizes.items():
        monkeypatch.setattr(D, name, n)
    evidence, documents, competitors, contents, want = _many_signals()
    got = made(spark, evidence, documents, competitors=competitors, contents=contents)["website_topics"]
    assert got.columns == ["run", "content", "competitor", "ord", "topic"] and sorted(map(tuple, got.collect())) == want and len(want) > 500


def test_no_pair_of_website_and_signal_is_shuffled(spark, monkeypatch):
    monkeypatch.setattr(D, "TASK_ROWS", 100, raising=False)
    evidence, documents, competitors, contents, want = _many_signals()
    plan = made(spark, evidence, documents, competitors=competitors, contents=contents)["website_topics"]._jdf.queryExecution().executedPlan().toString()
    above, _, join = plan.partition("SortMergeJoin")
    # the pairs are the join of sources, and what is above it only chooses columns; tasks follow its rows and not the bytes of its sides
    assert "source" in join.split("\n")[0] and not re.search("Exchange|Aggregate|Sort|Join", above)
    tasks = int(re.search(r"source#\d+, _block#\d+, _slice#\d+, (\d+)\), REPARTITION_BY_NUM", join)[1])
    assert tasks >= len(want) / 100 and "REPARTITION_BY_NUM" not in above


def test_keywords_products_and_week(spark):
    products = [("r", k, f"p{k}", [f"e{k}"], "c", "cat", f"signal {k}", [" Tag ", f"t{k}"]) for k in range(12)]
    out = made(
        spark, [("r", f"e{k}", k, "s", None, k > 1) for k in range(9)], products=products, pains=[("r", 0, "x", ["e0", "e9"], " TAG　")],
        contents=[("r", k, f"c{k}", [], "p", f"topic {k}") for k in range(4)], competitors=[("r", k, f"c{k}", [], f"name {k}") for k in range(2)],
    )
    words = {x.key: (x.id, x.keyword, x.intent) for x in out["keyword_database"].collect()}
    assert words["tag"] == ("keyword-db-deepseek-1", " Tag ", "purchase") and words["t0"][0] == "keyword-db-deepseek-2" and words["topic 0"][2] == "research" and len(words) == 17
    assert {x.evidence for x in out["keyword_evidence"].where("key = 'tag'").collect()} == {f"e{k}" for k in range(12)}
    assert {x.id: x.name for x in out["product_database"].collect()} == {f"product-db-p{k}": f"cat {D.SIGNAL} {k + 1}" for k in range(12)}
    week = out["weekly_intelligence_reports"].first()
    assert week.new_signals == ["signal 0", "signal 1", "signal 2", "topic 0", "topic 1"] and week.watch_list == ["name 0", "name 1"] and week.evidence_ids == [f"e{k}" for k in range(2, 7)]


def test_places_over_many_tasks(spark):
    r = random.Random(8)
    rows = [("hot" if r.random() < 0.6 else f"r{r.randrange(4)}", r.randrange(200), k) for k in range(3000)]
    got = {(x.run, x.ord, x.id): x.number for x in D.numbered(spark.createDataFrame(rows, "run string, ord long, id long"), run="run", order=["ord", "id"]).collect()}
    for run in {x[0] for x in rows}:
        assert [got[x] for x in sorted(x for x in rows if x[0] == run)] == list(range(1, 1 + sum(x[0] == run for x in rows)))


def test_empty_and_replaced(spark):
    out = made(spark)
    assert {name: df.count() for name, df in out.items() if df.count()} == {"weekly_intelligence_reports": 1}
    assert out["weekly_intelligence_reports"].first().watch_list == []
    old, new = (spark.createDataFrame(x, "run string, v int") for x in ([("a", 1), ("b", 1)], [("b", 2), ("b", 3)]))
    got = D.replace_databases({"t": old, "kept": old}, {"t": new, "more": new})
    assert sorted(map(tuple, got["t"].collect())) == [("a", 1), ("b", 2), ("b", 3)] and got["kept"] is old and got["more"].agg(F.count("*")).first()[0] == 2
