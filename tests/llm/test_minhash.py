"""Near-duplicate texts against all pairs, by the plain definition of weighted Jaccard similarity."""

import random
from collections import Counter

import numpy as np

from claimloom.llm import minhash
from claimloom.llm.common import words


def plain_classes(texts, width, threshold, idf):
    """Single linkage over all pairs of (id, text)."""
    sets = {}
    for i, t in texts:
        w = words((t or "").encode())
        h, _ = minhash.word_hashes([(t or "").encode()])
        rarity = idf[(h & np.uint64(len(idf) - 1)).astype(int)]
        s = Counter()
        for k in range(max(1, len(w) - width + 1) if w else 0):
            s[tuple(w[k : k + width])] += float(np.mean(rarity[k : k + width]))
        sets.setdefault(i, s)
    where, root = {}, {i: i for i in sets}
    for i, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(i)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sure = set()
    for own in where.values():
        for x in range(len(own)):
            for y in range(x):
                a, b = own[y], own[x]
                if (a, b) in sure:
                    continue
                sure.add((a, b))
                low = sum(min(v, sets[b][g]) for g, v in sets[a].items() if g in sets[b])
                if low / (sum(sets[a].values()) + sum(sets[b].values()) - low) >= threshold:
                    p, q = sorted((find(a), find(b)))
                    root[q] = p
    return {i: find(i) for i in sets}


def test_sampler_estimates():
    r = np.random.default_rng(5)
    sampler = minhash.Sampler(256)
    for share in (0.3, 0.8):
        base = r.integers(1, 1 << 63, 3000, dtype=np.uint64)
        m = int(2000 * share / (1 + share))
        a, b = np.sort(base[:1000]), np.sort(np.concatenate((base[:m], base[1000 : 2000 - m])))
        weight = {int(x): 1 + float(x % 7) for x in base}
        wa, wb = np.array([weight[int(x)] for x in a]), np.array([weight[int(x)] * 1.1 for x in b])
        both = {int(x): w for x, w in zip(a, wa)}
        low = sum(min(both.get(int(x), 0), w) for x, w in zip(b, wb))
        want = low / (wa.sum() + wb.sum() - low)
        s = sampler.samples(np.concatenate((a, b)), np.concatenate((wa, wb)), np.array([0, 1000, 2000]), block=300)
        assert abs((s[0] == s[1]).mean() - want) < 0.1


def test_word_hashes():
    h, n = minhash.word_hashes([b"One two", b"", b"  TWO! one", "é".encode()])
    assert n.tolist() == [2, 0, 2, 1] and h[0] == h[3] and h[1] == h[2] and len(set(h.tolist())) == 3


def test_classes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    idf = minhash.inverse_frequencies(docs.selectExpr("doc_id as id", "text"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain_classes([r[:2] for r in rows], 5, 0.8, idf)
    got = minhash.near_texts(docs).collect()
    assert {r.doc_id: r.class_id for r in got} == want and len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)
    assert len(set(want.values())) < len(want)


def test_planted_families_and_tiles(spark):
    r = random.Random(11)
    vocabulary = [f"w{k}" for k in range(4000)]
    rows, n = [], 0
    for family in range(6):
        base = [r.choice(vocabulary) for _ in range(120)]
        for copy in range(25):
            own = list(base)
            for _ in range(r.randint(0, 3)):
                own[r.randrange(120)] = r.choice(vocabulary)
            rows.append((n, " ".join(own), "s"))
            n += 1
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    for _ in range(40):  # a passage shared by texts that are otherwise different
        rows.append((n, passage + " " + " ".join(r.choice(vocabulary) for _ in range(90)), "s"))
        n += 1
    rows += [(n, None, "s"), (n + 1, "", "s"), (n + 2, "!!", "s"), (n + 3, "one two", "s"), (n + 4, "One, two", "s"), (n + 5, "x " * 60000, "s"), (3, rows[3][1], "s"), (None, rows[3][1], "s"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    idf = minhash.inverse_frequencies(docs.selectExpr("doc_id as id", "text"))
    want = plain_classes([r[:2] for r in rows if r[0] is not None], 5, 0.8, idf)
    got = minhash.near_texts(docs, tile=7, tile_shingles=600).collect()
    assert {x.doc_id: x.class_id for x in got if x.doc_id is not None} == want and len(got) == len(rows)
    assert [(x.class_id, x.kept) for x in got if x.doc_id is None] == [(None, True)] * 2
    assert minhash.near_texts(docs.limit(0)).count() == 0


def exact_pairs(texts, idf, width=5, threshold=0.8):
    """{(i, j): similarity} of all pairs at the threshold or more: two such texts share one of the rarest shingles of each
    that carry more than 1 - threshold of its weight, so only texts that share one of those are compared."""
    key, weight, bounds = minhash.shingles(texts, width, idf)
    _, number, often = np.unique(key, return_inverse=True, return_counts=True)
    total = [weight[a:b].sum() for a, b in zip(bounds, bounds[1:])]
    posted, out = {}, {}
    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
        order = np.lexsort((key[a:b], often[number[a:b]]))
        n = int(np.searchsorted(np.cumsum(weight[a:b][order]), (1 - threshold) * total[k] + 1e-9, side="right")) + 1
        for x in number[a:b][order[:n]].tolist():
            posted.setdefault(x, []).append(k)
    for i, j in {(own[j], own[i]) for own in posted.values() for i in range(len(own)) for j in range(i)}:
        a, b = slice(bounds[i], bounds[i + 1]), slice(bounds[j], bounds[j + 1])
        _, x, y = np.intersect1d(key[a], key[b], assume_unique=True, return_indices=True)
        low = np.minimum(weight[a][x], weight[b][y]).sum()
        if low / (total[i] + total[j] - low) >= threshold:
            out[i, j] = low / (total[i] + total[j] - low)
    return out


def test_recall_by_band():
    """Of planted near copies in every band of similarity from 0.8 on, nearly all are candidates."""
    r = random.Random(21)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(700):
        base = [r.choice(vocabulary) for _ in range(r.randint(60, 300))]
        texts.append(" ".join(base))
        own, changes = list(base), r.randint(1, max(1, len(base) // 45))
        for _ in range(changes):
            own[r.randrange(len(own))] = r.choice(vocabulary)
        texts.append(" ".join(own))
    texts = [t.encode() for t in dict.fromkeys(texts)]
    idf = np.ones(1 << 18)
    key, weight, bounds = minhash.shingles(texts, 5, idf)
    samples = minhash.Sampler(64).samples(key, weight, bounds)
    keys = minhash.band_keys(samples, 4)
    least = minhash._least(64, 0.8)
    found = {}
    for (i, j), s in exact_pairs(texts, idf).items():
        found.setdefault(min(int(s * 20), 19), []).append(bool((keys[i] == keys[j]).any() and (samples[i] == samples[j]).sum() >= least))
    assert {16, 17, 18} <= found.keys() and all(np.mean(x) >= 0.98 for x in found.values()), {k: (len(x), np.mean(x)) for k, x in found.items()}
