"""Prefix counts and packing against the tokenizer library and plain readings."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from claimloom.llm import packing, tokens

PIECES = ["'", "r", "e", "l", "v", " ", " ", "\n", "\t", "a", "B", "é", "ß", "1", "23", "-", "--", "<|endoftext|>", "<|end", "　", "\x1c", "\x85", "the", "日本", "🙂", ".", " 's"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(tokens.default_path())
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def bpe():
    return tokens.Bpe(tokens.default_path())


def samples(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(PIECES) for _ in range(r.randint(0, 14))) for _ in range(n)]


def test_every_prefix(library, bpe):
    for text in samples(800, 1):
        got = np.cumsum(bpe.prefix_deltas(text), dtype=np.int64).tolist()
        assert got == [len(library(text[: k + 1])) for k in range(len(text))], repr(text)


def test_ids(library, bpe):
    for text in [*samples(800, 2), "", " ", "a" * 5000, " ".join("abcdefg"[i % 7] * (i % 9) for i in range(3000))]:
        assert np.frombuffer(bpe.ids(text), "<u4").tolist() == library(text), repr(text)


def test_whole_texts(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: len(library(r.text or "")) for r in docs.collect()}
    got = tokens.token_counts(docs).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in got[:50]:
        assert r.over_limit == (r.n_tokens > 512)
        if r.over_limit:
            assert len(library(text[r.doc_id][: r.fits_chars])) <= 512 < len(library(text[r.doc_id][: r.fits_chars + 40]))


def test_questions(spark, library):
    docs = spark.createDataFrame([(1, "it'll be  fine <|endoftext|> ok", "x"), (2, None, "x"), (3, "", "x")], "doc_id long, text string, deltas string")
    table = tokens.prefix_counts(docs)
    asked = spark.createDataFrame([(1, k) for k in range(0, 35)] + [(2, 3), (3, 0), (9, 1)], "doc_id long, chars long")
    for r in tokens.count_at(table, asked).collect():
        text = {1: "it'll be  fine <|endoftext|> ok"}.get(r.doc_id, "")
        assert r.n_tokens == len(library(text[: r.chars]))
    assert tokens.count_at(table, asked).count() == 37
    fits = {r.doc_id: r for r in tokens.fit_budget(table, 4).collect()}
    assert (fits[2].fits_chars, fits[2].n_tokens) == (0, 0)
    assert len(library("it'll be  fine <|endoftext|> ok"[: fits[1].fits_chars])) <= 4


def test_plan_covers():
    r = random.Random(4)
    for n in (0, 1, 50, 4000, 120000):
        need = Counter(min(128, int(r.lognormvariate(3.2, 1.0)) + 1) for _ in range(n))
        got, used = Counter(), 0
        for config, times in packing.solve(need, 128):
            assert sum(k * a for k, a in config) <= 128
            used += times
            for k, a in config:
                got[k] += a * times
        assert got == need
        assert used <= 1.01 * sum(k * v for k, v in need.items()) / 128 + 5 + sum(v for k, v in need.items() if k > 64) * (n < 100)


def fewest(sizes, capacity):
    """The fewest bins, by trying every place for each piece."""
    best = len(sizes)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for i in sorted({b: i for i, b in enumerate(bins)}.values()):
            if bins[i] + sizes[k] <= capacity:
                place(k + 1, [*bins[:i], bins[i] + sizes[k], *bins[i + 1 :]])
        place(k + 1, [*bins, sizes[k]])

    place(0, [])
    return best


def test_bound():
    r = random.Random(6)
    for _ in range(40):  # never above the optimum
        sizes = sorted((r.randint(1, 20) for _ in range(r.randint(1, 9))), reverse=True)
        plan, bound = packing.optimised(Counter(sizes), 20, least=1)
        assert bound <= fewest(sizes, 20) + 1e-6 and fewest(sizes, 20) <= sum(n for _, n in plan)
    for spread in (0.4, 0.8, 1.2):  # and close to what is used, where there are many pieces
        need = Counter(min(256, int(r.lognormvariate(4.2, spread)) + 1) for _ in range(60000))
        plan, bound = packing.optimised(need, 256)
        assert sum(k * v for k, v in need.items()) / 256 <= bound <= sum(n for _, n in plan) <= 1.03 * bound + 5


def check_packing(rows, ids_of, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == ids_of.keys()
    for d, own in by_doc.items():
        own.sort(key=lambda r: r.piece)
        ids = ids_of[d]
        at = 0
        for k, r in enumerate(own):
            assert (r.piece, r.start) == (k, at)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            assert k == 0 or r.length == capacity
            at += r.length
        assert at == len(ids) and (len(own) == 1) == (at <= capacity)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence)


def test_packing(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.packed(docs).collect()
    ids_of = {r.doc_id: library(r.text or "") + [2] for r in docs.collect()}
    n = check_packing(rows, ids_of, 1024)
    assert n <= 1.02 * sum(map(len, ids_of.values())) / 1024 + 2


def test_packing_edges(spark, library):
    rows = [(1, None, 5), (2, "", 5), (3, "the cat " * 300, 5), (4, "a", 5), (5, "b" * 40000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    check_packing(packing.packed(docs, capacity=64).collect(), {d: library(t or "") + [2] for d, t, _ in rows}, 64)
    assert packing.packed(docs.limit(0)).count() == 0
    twice = packing.pack(packing.pieces(docs.union(docs), capacity=64), capacity=64, rows_per_salt=3).collect()
    assert len({(r.sequence_id, r.offset) for r in twice}) == len(twice)
    assert packing.pieces(docs, with_ids=True).where("doc_id = 2").first().ids == [2]


def test_very_many_salted_lengths(spark):
    """Every length may be salted, at any number of shuffle partitions: the plan does not grow with them."""
    import time

    before = spark.conf.get("spark.sql.shuffle.partitions")
    table = spark.range(3 * 1024).selectExpr("id as doc_id", "0 as piece", "0L as start", "1 + id % 1024 as length", "id as ids_crc32")
    spark.conf.set("spark.sql.shuffle.partitions", 2000)
    try:
        began = time.time()
        packed = packing.pack(table, capacity=1024, rows_per_salt=2)
        packed._jdf.queryExecution().executedPlan()
        assert time.time() - began < 60
        spark.conf.set("spark.sql.shuffle.partitions", before)
        rows = packed.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in used.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(rows) == 3072
