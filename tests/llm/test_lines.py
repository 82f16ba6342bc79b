"""Line deduplication against a plain model."""

import random
from collections import Counter

import numpy as np
import pytest

from claimloom.llm import lines

BLANK = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def plain(rows, *, least, min_chars, keep):
    split = [(doc, (text or "").split("\n")) for doc, text in rows]
    seen = Counter(k for _, ls in split for k in {key_of(x) for x in ls} if len(k) >= min_chars)
    gone = {k for k, n in seen.items() if n >= least}
    out, owned = [], {}
    if keep == "first":  # ids are unique and not null in the tests of this mode
        for doc, ls in sorted(split):
            for k in map(key_of, ls):
                owned.setdefault(k, doc)
    for doc, ls in split:
        kept, used = [], set()
        for x in ls:
            k = key_of(x)
            if k not in gone or keep == "first" and owned[k] == doc and k not in used:
                kept.append(x)
                used.add(k)
        out.append((doc, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def corpus(seed, n=150):
    rng = random.Random(seed)
    pool = [" License line ", "license LINE\r", "é", "É", "x", "", "  ", "\t", "long " * 200, "a\x0bb", " pad ", *(f"common {k}" for k in range(12))]
    rows = []
    for k in range(n):
        own = [rng.choice(pool) if rng.random() < 0.3 else f"unique {k} {j}" for j in range(rng.choice([1, 1, 4, 40]))]
        rows.append((k, rng.choice(["\n".join(own), "\n".join(own) + "\n", None if k % 29 == 0 else "\n".join(own)])))
    return rows


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "'x' as n_lines", "2 as r1").repartition(5)
    return sorted((tuple(r) for r in lines.without_repeated(df, **how).collect()), key=repr)


@pytest.mark.parametrize("least, min_chars", [(10, 1), (2, 1), (3, 6), (2, 0)])
def test_dropped_lines_equal_a_plain_model(spark, least, min_chars):
    rows = corpus(least) + [(None, "twice\nhere"), (None, "twice\nhere"), (5, "common 1\nx"), (5, "common 1\nx"), (6, "")]
    got = run(spark, rows, min_documents=least, min_chars=min_chars, keep="none")
    assert got == plain(rows, least=least, min_chars=min_chars, keep="none") and any(r[2] for r in got)


def test_the_first_occurrence_stays(spark):
    rows = corpus(9)
    for least in (2, 5):
        assert run(spark, rows, min_documents=least) == plain(rows, least=least, min_chars=1, keep="first")


def test_blocks_that_are_too_many_for_a_broadcast(spark):
    rows = corpus(4)
    assert run(spark, rows, min_documents=2, keep="none", most_blocks=1) == plain(rows, least=2, min_chars=1, keep="none")


def test_empty_table_and_wrong_arguments(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == [(1, 1, 0, "")]
    with pytest.raises(ValueError):
        run(spark, [(1, "a")], min_documents=1)


def test_only_suspected_lines_are_shuffled(spark):
    """Of lines that no other document has nearly none is in the filter, and of repeated ones all are."""
    rows = [(k, "\n".join([f"own {k} {j}" for j in range(20)] + ["everywhere"])) for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    blocks, segment_bits, twice_bits = lines.seen_twice(df)
    held = {r.block: [r.b0, r.b1, r.b2, r.b3] for r in blocks.collect()}

    def suspected(key):
        h = int(lines.hashes([key])[0])
        block = ((h >> (64 - segment_bits)) << twice_bits) + ((h >> 24) & ((1 << twice_bits) - 1))
        return block in held and all(held[block][k] >> ((h >> 6 * k) & 63) & 1 for k in range(4))

    assert suspected(b"everywhere")
    assert sum(suspected(f"own {k} {j}".encode()) for k in range(500) for j in range(20)) < 100


def test_bloom_filters_lose_nothing():
    h = np.random.default_rng(3).integers(0, 1 << 63, 4000).view(np.uint64)
    bloom = lines.Bloom(256)
    assert not bloom.has(h).any()
    bloom.add(h[:2000])
    assert bloom.has(h[:2000]).all() and bloom.has(h[2000:]).mean() < 0.05
