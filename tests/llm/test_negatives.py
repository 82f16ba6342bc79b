"""Hard negatives against a plain model."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.llm import negatives


def plain(rows, anchors, positives=5, count=3, low=50, high=95, scale=256):
    fine = [(i, k, [math.floor(scale * x) for x in v]) for i, v, k in rows if i is not None and k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, k, v) in enumerate(fine):
        if not anchors(i):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, label) for b, (j, label, w) in enumerate(fine) if b != a and len(w) == len(v))
        for s, j, _ in [x for x in scored if x[2] == k][:positives]:
            fits = [(n, -t) for t, n, label in scored if label != k and low * -s <= 100 * -t <= high * -s]
            out += [(i, j, rank, n, -s, t) for rank, (n, t) in enumerate(fits[:count], 1)]
    return sorted(out)


def vectors(seed, n, dim, labels=4, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(3)]
    return [(i, [c + spread * rng.gauss(0, 1) for c in rng.choice(centres)], rng.randrange(labels)) for i in range(n)]


def run(spark, rows, every=5, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as row", "2 as tile", "3 as score", "'x' as id").repartition(3)
    return sorted(tuple(r) for r in negatives.hard_negatives(df, anchors=F.col("vec_id") % every == 0, **how).collect())


@pytest.mark.parametrize("spread, tile", [(0.1, 1 << 20), (1.0, 37), (0.3, 64)])
def test_equal_to_a_plain_model(spark, monkeypatch, spread, tile):
    rows = vectors(3, 300, 6, spread=spread)
    got = run(spark, rows, tile_rows=tile)
    assert got == plain(rows, lambda i: i % 5 == 0)
    assert len(got) > 20


def test_small_blocks_of_scores(spark):
    rows = vectors(4, 200, 4, spread=0.05)
    tile_rows = [(i, [round(x, 1) for x in v], k) for i, v, k in rows]  # many ties
    assert run(spark, tile_rows, every=3, positives=7, negatives=4, low=80, high=99) == plain(tile_rows, lambda i: i % 3 == 0, 7, 4, 80, 99)


def test_nulls_sizes_zeros_and_repeated_rows(spark):
    rows = vectors(5, 60, 3)
    rows += [(61, None, 1), (62, [1.0, None, 2.0], 1), (63, [float("nan"), 1.0, 1.0], 1), (64, [float("inf"), 1.0, 1.0], 2), (65, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1)]
    rows += [(70, [0.0, 0.0, 0.0], 1), (75, [1.0, 1.0], 1), (76, [1.0, 1.0], 1), (77, [0.9, 0.8], 2), (80, [], 1), (81, [], 1), (82, [], 2)]
    rows += [rows[10], rows[10], rows[11]]
    assert run(spark, rows) == plain(rows, lambda i: i % 5 == 0)


def test_large_components_stay_exact_or_fail(spark):
    rows = [(i, [x * 1e6 for x in v], k) for i, v, k in vectors(6, 60, 4)]
    assert run(spark, rows) == plain(rows, lambda i: i % 5 == 0)
    with pytest.raises(Exception, match="64 bits"):
        run(spark, [(0, [1e12], 1), (1, [1e12], 1)])


def test_empty_table_and_one_label(spark):
    assert run(spark, []) == [] and run(spark, [(i, [1.0, float(i)], 1) for i in range(20)]) == []


def test_selection_over_blocks():
    rng = np.random.default_rng(1)
    for k in (1, 3, 8):
        scores, allowed = rng.integers(-5, 5, (20, 50)), rng.random((20, 50)) < 0.3
        best = negatives.merged(negatives.first(scores[:, :30], allowed[:, :30], k), (lambda s, p: (s, np.where(p < 0, -1, p + 30)))(*negatives.first(scores[:, 30:], allowed[:, 30:], k)), k)
        for n in range(20):
            want = sorted((-s, j) for j, (s, ok) in enumerate(zip(scores[n], allowed[n])) if ok)[:k]
            assert [(-s, j) for s, j in zip(best[0][n], best[1][n]) if j >= 0] == want
