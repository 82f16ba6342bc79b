"""Queries over whole tables against brute force on small fixtures."""

import hashlib
import re
from collections import Counter

from claimloom.queries import QUERIES


def test_hash_embed_of_every_document(spark, tmp_path):
    docs = [(k, t) for k, t in enumerate(["one two two three", "", None, "é1 é1 Two", "four, five; ONE", "one", "... !"])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {}
    for k, t in docs:
        sums = Counter()
        for w in re.findall(r"\w+", (t or "").lower()):
            h = hashlib.sha256(w.encode()).digest()
            sums[h[0] % 64] += 1 if h[1] % 2 == 0 else -1
        size = sum(v * v for v in sums.values()) ** 0.5
        want |= {(k, b): round(v / size, 6) for b, v in sums.items() if v}
    got = {(r.doc_id, r.bucket): r.value for r in QUERIES["t4_hash_embed"](spark, str(tmp_path)).collect()}
    assert got == want and {k for k, _ in got} == {0, 3, 4, 5}


def test_next_roles_of_late_orders(spark, tmp_path):
    for name, rows, schema in [
        ("orders", [(401, 1), (9000, 2), (2, 3)], "o_orderkey long, o_custkey long"), ("customer", [(1, 1), (2, 2), (3, 3)], "c_custkey long, c_nationkey long"), ("nation", [(1, "a"), (2, "b"), (3, "c")], "n_nationkey long, n_name string"),
    ]:
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert [r.role for r in QUERIES["p17_next_roles"](spark, str(tmp_path)).collect()] == ["a", "b"]


def test_claims_covered_by_all_quotes(spark, tmp_path):
    benchmark = [(1, "alpha beta1 gamma delta zeta"), (2, "alpha beta1"), (3, "a b"), (4, "alpha"), (5, "omega"), (5, "omega alpha")]
    docs = [(1, "x " * 200 + "ALPHA"), (41, "gam"), (81, "ma beta1"), (2, "none"), (3, None), (5, "omega")]
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["e6_claim_covered"](spark, str(tmp_path)).collect()
    assert sorted((r.item_id, r.covered) for r in got) == [(1, True), (2, False), (3, True), (5, True), (5, True)]
