"""Collocations against a plain model, also with colliding fingerprints and small windows."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from claimloom.llm import phrases


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_counts(rows, most):
    f, totals, first = Counter(), Counter(), {}
    for doc, text, lang in rows:
        lang, text = "und" if lang is None else lang, lowered(text or "")
        for piece in re.finditer(r"[^.,;:!?\x0A-\x0D]+", text):
            ws = [(m.group(), len(text[: piece.start() + m.start()].encode())) for m in re.finditer(r"[^\x20\x09]+", piece.group())]
            totals[lang] += len(ws)
            for k in range(1, most + 1):
                for i in range(len(ws) - k + 1):
                    key = lang, " ".join(w for w, _ in ws[i : i + k])
                    f[key] += 1
                    if doc is not None:
                        first[key] = min(first.get(key, (doc, ws[i][1])), (doc, ws[i][1]))
    return f, totals, first


def plain(rows, *, most=4, least=8, top=2000):
    f, totals, first = plain_counts(rows, most)
    cand = {p: a for p, a in f.items() if a >= least and " " in p[1]}
    found = {}
    for (lang, phrase), a in cand.items():
        ws = phrase.split(" ")
        covered = any(g == lang and len(q.split(" ")) > len(ws) and f" {phrase} " in f" {q} " and 100 * b >= 80 * a for (g, q), b in cand.items())
        cuts = []
        for k in range(1, len(ws)):
            l, r = f[lang, " ".join(ws[:k])], f[lang, " ".join(ws[k:])]
            cuts.append((2_000_000 * a // (l + r), k, l, r))
        if not covered:
            score, _, l, r = min(cuts)
            found.setdefault(lang, []).append((-score, -a, phrase.encode(), l, r))
    rows = []
    for lang, of in found.items():
        for rank, (score, a, phrase, l, r) in enumerate(sorted(of)[:top], 1):
            rows.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score, *first.get((lang, phrase.decode()), (None, None))))
    return sorted(rows, key=repr)


def corpus(seed=1):
    rng = random.Random(seed)
    words = ["a", "b", "Zé", "zé", "ab", "a b", "x-y", "中", "\x00", "UP", "up"]
    rows = []
    for n in range(120):
        size = rng.choice([0, 1, 3, 30, 200])
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", "\x0b", "?!"]) for _ in range(size))
        rows.append((n, rng.choice(["", " ", "\n"]) + text, rng.choice(["en", "en", "en", "fr", None, ""])))
    rows += [(3, "same words here", "en")] * 40 + [(None, "no id has this phrase", "en")] * 35 + [(7, None, "en"), (8, "", None)]
    rows += [(500 + k, "left or right " * 20 + ". one two three four five" * 3, "de") for k in range(20)]
    return rows


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as phrase", "'x' as n", "2 as fp", "3 as k").repartition(3)
    return sorted((tuple(r) for r in phrases.collocations(df, least=8, **how).collect()), key=repr)


def test_collocations_equal_a_plain_model(spark):
    rows = corpus()
    expected = plain(rows)
    assert len(expected) > 40 and {r[0] for r in expected} >= {"en", "de", "und"}
    assert run(spark, rows) == expected
    assert run(spark, rows, top=3) == plain(rows, top=3)


@pytest.mark.parametrize("bits", [3, 8])
def test_colliding_fingerprints_come_apart(spark, bits):
    rows = corpus(2)
    assert run(spark, rows, fingerprint_bits=bits) == plain(rows)


def test_empty_table_and_rare_phrases(spark):
    assert run(spark, []) == [] and run(spark, [(1, "only once", "en"), (2, None, None)]) == []


def test_windows_split_nothing():
    rng = random.Random(5)
    for trial in range(60):
        data = "".join(rng.choice(["a", "bb", "é" * 9, " ", " ", "\t", ".", "\n", "w" * 40]) for _ in range(rng.randrange(120))).encode()
        for k in (1, 2, 4):
            whole = Counter()
            for piece in re.split(rb"[.,;:!?\x0A-\x0D]", data):
                ws = piece.replace(b"\t", b" ").split()
                whole.update(b" ".join(ws[i : i + k]) for i in range(len(ws) - k + 1))
            for size in (1, 7, 16, 1000):
                got = Counter()
                for words in phrases.windows(data, 3, size):
                    cells = [data[a:e] for a, e in zip(words.start, words.end)]
                    got.update(b" ".join(cells[i : i + k]) for i in words.within(k))
                assert got == whole, (data, k, size)


def test_filter_of_frequent_fingerprints_loses_none(spark):
    values = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 500)
    known = phrases.Frequent(spark, spark.createDataFrame([(int(v),) for v in values], "fp long"))
    assert known.has(values.view(np.uint64)).all()
    others = np.random.default_rng(2).integers(-(1 << 63), 1 << 63, 5000).view(np.uint64)
    assert known.has(others).mean() < 0.1


def test_words_of_equal_hash_come_apart():
    data = b"ab cd ab xyz cd ef ab"
    words = next(phrases.windows(data, 3))
    words.hash = words.hash & type(words.hash[0])(1)
    number = {}
    ids = phrases.numbered(data, words, np.arange(5), number)
    names = list(number)
    assert [names[i] for i in ids[:5]] == data.split()[:5] and (ids[5:] == -1).all()


def test_phrases_that_all_tasks_know_are_not_sent(spark, monkeypatch):
    made, cut = {}, phrases.cut

    def kept(df, name):
        made[name] = cut(df, name)
        return made[name]

    monkeypatch.setattr(phrases, "cut", kept)
    rows = [(n, "left or right in every text", "en") for n in range(80)] + [(None, "no id, left or right", "en")] * 9 + [(200, "a late phrase", None)] * 12
    assert run(spark, rows) == plain(rows)
    sent = {r["phrase"] for r in made["texts"].where("k > 0").collect()}
    assert "a late phrase" in sent and not {p for p in sent if "left" in p or "every" in p}
    rows = [(None, text, lang) for _, text, lang in rows]
    assert run(spark, rows) == plain(rows)
