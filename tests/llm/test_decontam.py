"""The index against plain string matching."""

import hashlib
import random
import re

import numpy as np

from claimloom.llm import decontam

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(texts, items, width):
    windows = {}
    for i, t in items:
        w = WORD.findall(t.lower())
        for k in range(max(1, len(w) - width + 1)):
            if w:
                windows.setdefault(tuple(w[k : k + width]), set()).add(i)
    for t in texts:
        w = WORD.findall(t.lower())
        hit, found = [False] * len(w), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit[k : k + size] = [True] * size
                    found |= windows[tuple(w[k : k + size])]
        yield len(w), hit, found


def test_against_plain_matching():
    r = random.Random(8)
    vocabulary = ["a", "b", "c", "D", "é", "x1"]
    for _ in range(60):
        text = lambda n: r.choice([" ", ", ", "\n"]).join(r.choice(vocabulary) for _ in range(n)).encode()
        texts = [text(r.randint(0, 60)) for _ in range(r.randint(0, 12))]
        items = [(i, text(r.randint(0, 9))) for i in range(r.randint(0, 8))]
        sizes, starts, hit, found = decontam.shard_hits(texts, decontam.Phrases(items, 4))
        for k, (n, want, of) in enumerate(plain(texts, items, 4)):
            assert sizes[k] == n and hit[starts[k] : starts[k + 1]].tolist() == want and set(found[k]) == of


def test_index_parts():
    r = np.random.default_rng(3)
    text = np.append(r.integers(0, 5, 400), 0)
    index = decontam.FmIndex(text, 5)
    patterns = r.integers(1, 5, (50, 3))
    low, high = index.search(patterns)
    for p, a, b in zip(patterns, low, high):
        want = [k for k in range(len(text) - 2) if (text[k : k + 3] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_frames(spark):
    items = spark.createDataFrame([(1, "one two three four"), (2, "five"), (3, ""), (4, None), (None, "one")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "zero ONE, two three é", "x"), (2, None, "x"), (3, "", "x"), (4, "a five. b", "x"), (4, "a five. b", "x"), (5, "w " * 50000 + "one two three four", "x")], "doc_id long, text string, items string"
    )
    got = decontam.digest(decontam.contamination(docs, items, width=3)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_words, r.n_hit, r.n_items) for r in got] == [(1, 5, 3, 1), (2, 0, 0, 0), (3, 0, 0, 0), (4, 3, 1, 1), (4, 3, 1, 1), (5, 50004, 4, 1)]
    assert got[0].items_sha256 == hashlib.sha256(b"1").hexdigest() and got[1].items_sha256 == hashlib.sha256(b"").hexdigest()
    blocks = decontam.digest(decontam.contamination(docs, items.union(items), width=3, block_bytes=4)).orderBy("doc_id").collect()
    assert blocks == got
    clean = {r.doc_id: r.text for r in decontam.without_hits(docs, items, width=3).collect()}
    assert (clean[1], clean[2], clean[4]) == ("zero  é", None, "a . b")
    assert decontam.contamination(docs.limit(0), items).count() == 0
    assert decontam.contamination(docs, items.limit(0)).where("n_hit > 0").count() == 0


def test_blocks_change_nothing(spark):
    r = random.Random(5)
    text = lambda n: " ".join(r.choice("abcdef") for _ in range(n))
    items = spark.createDataFrame([(k % 6, text(r.randint(3, 6))) for k in range(8)] + [(8, "one two three four"), (9, "three four five six")], "item_id long, text string")
    rows = [(r.choice([None, 1, 2]), text(40)) for _ in range(30)] + [(None, "x one two three four five six y"), (None, "x one two three four y y y"), (7, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = lambda n: [tuple(x) for x in decontam.contamination(docs, items, width=3, block_bytes=n).collect()]
    clean = lambda n: [tuple(x) for x in decontam.without_hits(docs, items, width=3, block_bytes=n).collect()]
    assert len(list(decontam._blocks(items, "item_id", "text", 20))) > 4
    assert found(20) == found(1 << 20) and len(found(20)) == len(rows)
    assert clean(20) == clean(1 << 20) and clean(20)[30][1] == "x  y"
