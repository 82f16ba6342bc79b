"""Containment, full-text index and clustered vectors against brute force, and how much they read."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from claimloom.operators import clusters, containment, postings, retrieval
from claimloom.sources.scratch import scratch_path


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("gram", [1, 2, 4])
def test_containing(spark, gram):
    r = random.Random(gram)
    alphabet = ["a", "b", "é", "中", "😀", " ", "\n", "*", "."]
    hays = [(k, "".join(r.choice(alphabet) for _ in range(r.choice([0, 1, 3, 30, 200])))) for k in range(150)] + [(900, None)]
    needles = [(k, "".join(r.choice(alphabet) for _ in range(r.choice([0, 1, 2, 3, 4, 5, 9])))) for k in range(120)] + [(901, None), (902, hays[5][1]), (5, "a")]
    got = containment.containing(spark.createDataFrame(needles, "q long, needle string"), spark.createDataFrame(hays, "d long, hay string"), gram=gram)
    assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)
    want = {(q, d) for q, n in needles for d, h in hays if n and h is not None and n in h}
    rows = [tuple(x) for x in got.collect()]
    assert set(rows) == want and len(rows) == len(want) > 300


def test_containing_many(spark, monkeypatch):
    monkeypatch.setattr(containment, "FEW", -1)
    test_containing(spark, 4)
    test_nothing_to_look_for(spark)


def test_nothing_to_look_for(spark):
    hays = spark.createDataFrame([(1, "abc")], "d long, hay string")
    assert containment.containing(spark.createDataFrame([], "q long, needle string"), hays).collect() == []
    assert containment.containing(spark.createDataFrame([(1, "abcdef")], "q long, needle string"), hays.limit(0)).collect() == []


def words_of(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def plain_bm25(docs, queries, k, k1=1.2, b=0.75):
    lists = {d: Counter(words_of(t)) for d, t in docs}
    sizes = {d: sum(c.values()) for d, c in lists.items()}
    filled = [n for n in sizes.values() if n]
    mean = sum(filled) / len(filled)
    df = Counter(w for c in lists.values() for w in c)
    out = set()
    for q, text in queries:
        scored = []
        for d, c in lists.items():
            hits = [w for w in set(words_of(text)) if w in c]
            if hits:
                s = sum(math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * (k1 + 1) / (c[w] + k1 * (1 - b + b * sizes[d] / mean)) for w in hits)
                scored.append((-round(s, 6), d))
        out |= {(q, d, place) for place, (s, d) in enumerate(sorted(scored)[:k], 1)}
    return out


def corpus(seed, n):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["common"] * 60
    return [(k, None if k % 41 == 0 else " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 2, 10, 60])))) for k in range(n)]


def found(df):
    return {(r.q, r.doc, r.place) for r in df.collect()}


def test_index_equals_plain_scores_and_takes_more(spark, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 8)
    monkeypatch.setattr(postings, "PART", 50)
    docs = corpus(1, 300)
    queries = [(1, "w3 w7 common"), (2, "common"), (3, "nothing here"), (4, "W5!"), (5, None), (6, "w1 w2 w3 w4 w5 w6")]
    frame = spark.createDataFrame(docs, "d long, text string")
    asked = spark.createDataFrame(queries, "q long, text string")
    index = postings.Index(spark, scratch_path(spark, "test-index"), buckets=16).add(frame.where("d < 200"), doc_id="d")
    assert found(index.search(asked, k=5, query_id="q")) == plain_bm25(docs[:200], queries, 5)
    index.add(frame.where("d >= 200"), doc_id="d")
    assert found(index.search(asked, k=5, query_id="q")) == plain_bm25(docs, queries, 5)
    once = retrieval.text_search(frame.withColumnRenamed("d", "doc"), asked, k=5, doc_id="doc", query_id="q")
    assert found(once) == plain_bm25(docs, queries, 5)


def test_a_search_reads_its_buckets_and_the_blocks_that_matter(spark, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 8)
    docs = [(k, "common " * (1 + k % 50) + f"own{k}") for k in range(400)] + [(k, "other") for k in range(400, 900)]
    index = postings.Index(spark, scratch_path(spark, "test-index"), buckets=32).add(spark.createDataFrame(docs, "d long, text string"), doc_id="d")
    one = spark.createDataFrame([("own7",)], "token string")
    read = index.blocks(one)
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan_of(read)) and read.select("bucket").distinct().count() == 1
    visits = []
    asked = spark.createDataFrame([(1, "common")], "q long, text string")
    assert found(index.search(asked, k=5, query_id="q", visits=visits)) == plain_bm25(docs, [(1, "common")], 5)
    every, read = (x.count() for x in visits)
    assert every == 50 and read <= 10


def test_empty_index(spark):
    index = postings.Index(spark, scratch_path(spark, "test-index")).add(spark.createDataFrame([], "d long, text string"), doc_id="d")
    assert index.search(spark.createDataFrame([(1, "a")], "q long, text string"), k=3, query_id="q").collect() == []


def plain_nearest(rows, queries, k):
    out = set()
    for q, v in queries:
        if v is None or not any(v) or not all(x is not None and math.isfinite(x) for x in v):
            continue
        scored = []
        for i, w in rows:
            if w is None or len(w) != len(v) or not any(w) or not all(x is not None and math.isfinite(x) for x in w):
                continue
            a, b = np.array(v), np.array(w)
            scored.append((-math.floor(float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))) * 1e6 + 0.5), i))
        out |= {(q, i, place) for place, (_, i) in enumerate(sorted(scored)[:k], 1)}
    return out


def grouped(seed, n, dim, spread):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(20, dim))
    return [(k, [float(x) for x in middle[k % 20] + spread * r.normal(size=dim)]) for k in range(n)]


@pytest.mark.parametrize("spread", [0.05, 2.0])
def test_clustered_search_equals_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(clusters, "PIECE", 40)
    rows = grouped(3, 500, 8, spread)
    rows += [(600, None), (601, [0.0] * 8), (602, [1.0, None] + [0.0] * 6), (603, [float("nan")] * 8), (604, [1.0, 2.0]), (605, [2.0, 1.0]), *[(700 + k, rows[3][1]) for k in range(30)]]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    queries = [(k, v) for k, v in rows if k % 10 == 0 or k > 598]
    asked = spark.createDataFrame(queries, "q long, embedding array<double>")
    visits = []
    index = clusters.Clusters.of(df, id_col="id")
    got = index.search(asked, k=4, query_id="q", visits=visits)
    assert {(r.q, r.id, r.place) for r in got.collect()} == plain_nearest(rows, queries, 4)
    pairs = sum(x.agg({"n": "sum"}).first()[0] or 0 for x in visits)
    if spread < 1:  # clusters far from a query are not read
        assert pairs < 0.25 * len(rows) * len(queries)


def test_clusters_of_nothing(spark):
    none = spark.createDataFrame([], "id long, embedding array<double>")
    one = spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<double>")
    assert clusters.Clusters.of(none, id_col="id").search(one.withColumnRenamed("id", "q"), k=2, query_id="q").collect() == []
    assert clusters.Clusters.of(one, id_col="id").search(one.withColumnRenamed("id", "q"), k=2, query_id="q").count() == 1
    assert clusters.Clusters.of(one, id_col="id").search(none.withColumnRenamed("id", "q"), k=2, query_id="q").count() == 0
