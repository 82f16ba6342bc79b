"""Vectors, archives, URL filter and toxicity against plain versions, and the pipeline."""

import base64
import hashlib
import math
import random

import numpy as np
import pytest

from claimloom.llm import embeddings, toxicity, urlgraph, warc
from claimloom.llm.common import components


# --- vectors


def plain_links(rows, threshold):
    ids = [r[0] for r in rows]
    links = {k: set() for k in range(len(rows))}
    for a in range(len(rows)):
        for b in range(a):
            (_, x, lx), (_, y, ly) = rows[a], rows[b]
            if lx is None or lx != ly or x is None or y is None or len(x) != len(y):
                continue
            if any(v is None or not math.isfinite(v) for v in x + y):
                continue
            x, y = np.array(x), np.array(y)
            n = np.linalg.norm(x) * np.linalg.norm(y)
            if n and x @ y / n >= threshold:
                links[a].add(b)
                links[b].add(a)
    root = list(range(len(rows)))
    changed = True
    smallest = {k: ids[k] for k in root}
    while changed:
        changed = False
        for a in links:
            low = min([smallest[a], *(smallest[b] for b in links[a])])
            if low < smallest[a]:
                smallest[a], changed = low, True
    return sorted((ids[k], len(links[k]), smallest[k], ids[k] == smallest[k]) for k in links)


def test_vectors(spark):
    r = np.random.default_rng(2)
    rows = []
    for group in range(8):
        base = r.normal(size=12)
        for _ in range(20):
            v = base + r.normal(size=12) * r.choice([0.0, 0.02, 0.06, 0.1])
            rows.append((len(rows) * 3, [float(np.float32(x)) for x in v * r.choice([1.0, 2.5])], group % 3))
    rows += [(900, None, 1), (901, [0.0] * 12, 1), (902, [1.0, None] + [0.0] * 10, 1), (903, [float("nan")] * 12, 1), (904, [float("inf")] + [1.0] * 11, 1), (905, rows[0][1], None), (906, [1.0] * 5, 0), (907, [1.0] * 5, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = embeddings.near_vectors(df, threshold=0.98, tile=16).collect()
    assert sorted((x.vec_id, x.n_links, x.component_id, x.kept) for x in got) == plain_links(rows, 0.98)
    assert embeddings.near_vectors(df.limit(0)).count() == 0
    none = spark.createDataFrame([(None, rows[0][1], 0)] * 3 + [(None, None, None)], df.schema)
    more = embeddings.near_vectors(df.union(none), threshold=0.98, tile=16).collect()
    assert sorted(tuple(x) for x in more if x.vec_id is not None) == sorted(map(tuple, got))
    assert [tuple(x) for x in more if x.vec_id is None] == [(None, 0, None, True)] * 4


def test_vector_blocks(spark):
    """Chains of links over many blocks and tiles; an id with two vectors; only vectors with a possible link are dealt whole."""
    r = np.random.default_rng(5)
    angles = np.cumsum(r.uniform(0.05, 0.19, 120))
    rows = [(k, [math.cos(a), math.sin(a), 0.0, 0.0], 1) for k, a in enumerate(angles[:90])] + [(500 + k, [0.0, 0.0, math.cos(a), math.sin(a)], 1) for k, a in enumerate(angles[90:])]
    rows = [rows[k] for k in r.permutation(len(rows))]
    schema = "vec_id long, embedding array<double>, label int"
    want = plain_links(rows, 0.98)
    for tile in (4, 64):
        got = embeddings.near_vectors(spark.createDataFrame(rows, schema), tile=tile).collect()
        assert sorted((x.vec_id, x.n_links, x.component_id, x.kept) for x in got) == want
    twice = [(7, [1.0, 0.0], 1), (7, [0.0, 1.0], 1), (8, [0.0, 1.001], 1), (9, [0.0, 1.002], 1)]
    got = sorted((x.vec_id, x.n_links, x.component_id) for x in embeddings.near_vectors(spark.createDataFrame(twice, schema)).collect())
    assert got == [(7, 0, 7), (7, 2, 7), (8, 2, 7), (9, 2, 7)]


def test_joined_places():
    r = np.random.default_rng(6)
    for _ in range(30):
        n = int(r.integers(1, 60))
        i, j = r.integers(0, n, (2, int(r.integers(0, 60))))
        plain = list(range(n))
        for a, b in zip(i.tolist(), j.tolist()):
            plain = [plain[b] if x == plain[a] else x for x in plain]
        got = embeddings.joined_places(n, i, j)
        assert all((got[a] == got[b]) == (plain[a] == plain[b]) for a in range(n) for b in range(n))


def test_hot_keys(spark, monkeypatch):
    """Stars, copies and payloads that hold most rows take the broadcast path, and give the same rows."""
    from claimloom.llm import common

    r = random.Random(8)
    edges = [(k, 0) for k in range(1, 400)] + [(1000 + k, 999) for k in range(300)] + [(5000 + k, 5000 + r.randrange(k)) for k in range(1, 200)] + [(399, 1000), (None, 1), (7, None)]
    frame = spark.createDataFrame(edges, "a long, b long")
    vectors = spark.createDataFrame([(k, [1.0, 0.0] if k % 3 else [0.6, 0.8], 1) for k in range(300)] + [(1000, [1.0, 0.01], 1)], "vec_id long, embedding array<float>, label int")
    pages = spark.createDataFrame([(k, "u", "same" if k % 4 else str(k)) for k in range(200)], "page_id long, url string, html string")
    forms = [
        lambda: {x.node: x.component for x in components(frame).collect()}, lambda: sorted(map(tuple, embeddings.near_vectors(vectors).collect())), lambda: sorted(map(str, warc.with_types(pages).collect())),
        lambda: sorted(map(str, warc.with_types(pages, most=0).select("page", "url", "html", "bytes", "sha", "refers_to").collect())),
    ]
    plain = [f() for f in forms]
    monkeypatch.setattr(common, "LEAST_HOT", 20)
    monkeypatch.setattr(common, "MOST_HOT", 30)
    assert [f() for f in forms] == plain
    assert set(plain[0].values()) == {0, 5000} and {v for k, v in plain[0].items() if k >= 5000} == {5000} and plain[2] == plain[3]
    assert {x[1] for x in plain[1]} == {99, 200, 300 - 100} and len(plain[1]) == 301


def test_bounds_are_rigorous():
    r = np.random.default_rng(4)
    x = r.normal(size=(200, 8))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    code, scale, h, e = embeddings.quantised(unit)
    assert (np.abs(unit @ unit.T - (code @ code.T) * scale[:, None] * scale[None]) <= h[:, None] * e[None] + e[:, None] * (h + e)[None] + 1e-9).all()
    i, j = embeddings.tile_pairs(x, None, 0.6)
    assert {(a, b) for a, b in zip(i.tolist(), j.tolist())} == {(a, b) for a in range(200) for b in range(a + 1, 200) if unit[a] @ unit[b] >= 0.6}


# --- archives


@pytest.mark.parametrize("most", [200_000, 0])
def test_null_ids_revisit_the_largest(spark, most):
    df = spark.createDataFrame([(1, "u", "a"), (None, "u", "a"), (5, "u", "a"), (None, "u", "alone"), (None, "u", "alone"), (3, None, "b")], "page_id long, url string, html string")
    got = sorted((r.page or 0, r.html.decode() if r.html is not None else "", r.refers_to or 0) for r in warc.with_types(df, most=most).collect())
    assert got == [(0, "", 5), (0, "alone", 0), (0, "alone", 0), (1, "", 5), (3, "b", 0), (5, "a", 0)]


def test_archives(spark, tmp_path):
    r = random.Random(6)
    rows = [(k, f"http://h/{k}", None if k % 11 == 0 else ("<p>é " + " ".join(r.choice(["a", "bc", "déf"]) for _ in range(r.randint(0, 40)))) if k % 3 else "same\r\n\r\nbody", "x") for k in range(300)]
    rows += [(300, None, "z" * 300_000, "x"), (301, "a\r\nb", "same\r\n\r\nbody", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, sha string")
    typed = warc.with_types(df)
    archives = warc.write_archives(typed, archive_bytes=20_000).cache()
    got = {x.page_id: x for x in warc.read_archives(archives, with_payload=True).collect()}
    assert got.keys() == {x[0] for x in rows}
    last = {}
    for p, _, h, _ in rows:
        last[h or ""] = max(p, last.get(h or "", -1))
    for p, _, h, _ in rows:
        data = (h or "").encode()
        want = ("response", None) if last[h or ""] == p else ("revisit", last[h or ""])
        assert (got[p].record_type, got[p].refers_to) == want
        assert got[p].payload_bytes == len(data) and got[p].payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert got[p].payload == (data if want[0] == "response" else None)
    written = warc.export(archives, str(tmp_path / "out")).collect()
    assert sum(w.bytes for w in written) == sum(len(a.data) for a in archives.collect())
    first = archives.first()
    assert first.data[:4] == warc.DICTIONARY_MAGIC.to_bytes(4, "little")
    assert len(list(warc.read_archive((tmp_path / "out" / first.archive).read_bytes()))) == first.records
    small = {x.page_id: x.record_type for x in warc.archived(df, min_bytes=10_000).collect()}
    assert set(small.values()) == {"response"}
    assert warc.archived(df.limit(0)).count() == 0
    none = warc.archived(df.limit(0).union(spark.createDataFrame([(None, None, None, "x"), (None, "u", "same", "x"), (5, "u", "same", "x"), (5, "u", "same", "x")], df.schema)), with_payload=True).collect()
    assert sorted((x.page_id or 0, x.record_type, x.refers_to, x.payload) for x in none) == [(0, "response", None, b""), (0, "revisit", 5, None), (5, "response", None, b"same"), (5, "response", None, b"same")]


# --- URL filter


def plain_rank(seeds, edges, damping, rounds=200):
    out, into = {}, {}
    for (a, b), n in edges.items():
        out[a] = out.get(a, 0) + n
        into[b] = into.get(b, 0) + n
    hosts = {*seeds, *(h for e in edges for h in e)}
    t = {h: (1 - damping) * seeds.get(h, (0, 0))[0] for h in hosts}
    d = {h: (1 - damping) * seeds.get(h, (0, 0))[1] for h in hosts}
    for _ in range(rounds):
        nt, nd = ({h: (1 - damping) * seeds.get(h, (0, 0))[k] for h in hosts} for k in (0, 1))
        for (a, b), n in edges.items():
            nt[b] += damping * t[a] * n / out[a]
            nd[a] += damping * d[b] * n / into[b]
        t, d = nt, nd
    return t, d


RULES = [urlgraph.Rule("allow", "good.org", "/"), urlgraph.Rule("block", "bad.net", "/"), urlgraph.Rule("block", "good.org", "/x/")]


def test_trust_settles(spark):
    hosts = [f"h{k}" for k in range(61)]
    edges = {(a, b): 1 + k % 3 for k, (a, b) in enumerate(zip(hosts, hosts[1:]))} | {("h3", "h1"): 2, ("h9", "h2"): 1}
    seeds = {"h0": (1.0, 0.0), "h60": (0.0, 1.0)}
    t, d = plain_rank(seeds, edges, 0.85, rounds=400)
    frame = spark.createDataFrame([(h, *x) for h, x in seeds.items()], "host string, trust double, distrust double")
    links = spark.createDataFrame([(*e, n) for e, n in edges.items()], "src string, dst string, n long")
    got = {r.host: r for r in urlgraph.spread(frame, links, every=10).collect()}
    assert got.keys() == set(hosts)
    for h in hosts:  # the far end of the chain, too, is near the fixed point
        assert got[h].trust == pytest.approx(t[h], rel=1e-5) and got[h].distrust == pytest.approx(d[h], rel=1e-5)
    assert got["h0"].distrust > 0 and got["h60"].trust > 0
    with pytest.raises(RuntimeError):
        urlgraph.spread(frame, links, rounds=20, every=10)


def test_url_filter(spark):
    link = lambda *hosts: "".join(f'<a href="{p}//{h}/q">' for h in hosts for p in ("http:", ""))
    rows = [
        (1, "http://A.Good.org/x/1?y", link("mid.com")), (2, "https://good.org/y#z", link("mid.com", "far.com")), (3, "http://bad.net/", link("mid.com")),
        (4, "http://mid.com/a", link("far.com")), (5, "http://spam.com/", link("bad.net", "bad.net")), (6, "http://far.com", "<a href='/rel'>"),
        (7, None, None), (8, "no scheme", ""), (9, "http://notgood.org/x/", None), (9, "http://notgood.org/x/", None), (10, "x://h?a://b", None), (11, "http://lone.com/", link("spam.com")),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in urlgraph.judged(df, RULES).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.good.org", "/x/1", "good.org/x/", "block")
    assert (got[2].host, got[2].path, got[2].rule, got[2].verdict) == ("good.org", "/y", "good.org/", "allow")
    assert (got[7].host, got[7].path, got[8].host, got[10].host, got[10].path) == ("", "", "", "h", "")
    assert (got[5].verdict, got[11].verdict, got[6].verdict, got[4].verdict, got[9].verdict) == ("block", "block", "allow", "allow", "allow")
    edges = {(r.src, r.dst): r.n for r in urlgraph.host_edges(df).collect()}
    assert edges[("spam.com", "bad.net")] == 4 and ("far.com", "far.com") not in edges
    seeds = {"a.good.org": (0.0, 1.0), "good.org": (1.0, 0.0), "bad.net": (0.0, 1.0)}
    t, d = plain_rank(seeds, edges, 0.85)
    frame = spark.createDataFrame([(h, *x) for h, x in seeds.items()], "host string, trust double, distrust double")
    for r in urlgraph.spread(frame, urlgraph.host_edges(df)).collect():
        assert abs(r.trust - t[r.host]) < 1e-6 and abs(r.distrust - d[r.host]) < 1e-6
    base = df.select(urlgraph.host_of(df.url).alias("host"), urlgraph.path_of(df.url).alias("path"))
    key = lambda f: sorted(map(str, f.select("host", "path", "rule", "rule_verdict").collect()))
    assert key(urlgraph.with_rules(base, RULES)) == key(urlgraph.with_rules(base, RULES, inline=0))
    assert urlgraph.judged(df.limit(0), RULES).count() == 0
    plan = urlgraph.judged(df, RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- toxicity


def test_grammar():
    m = toxicity.Model(words={"fool": 2.0}, stems={"idio": 3.0}, weights=np.array([-3.0, 2.0, 1.0, -1.0]))
    a = m.prefilter()
    (s, e, plain, off), *_ = m.clauses("Well, you idiots went. Fine", a)
    assert (plain, off) == (3.0 * toxicity.GAIN[toxicity.DIRECTED], False)
    assert m.clauses("He is not a fool.", a)[0][3] and m.clauses("they said fool", a)[0][3]
    assert not m.clauses("I will kill you", a)[0][3] and m.clauses("kill time, you know", a) == []
    assert m.score(m.clauses("you fool", a)) > m.score(m.clauses("you are not a fool", a)) > 0
    assert m.score([]) == pytest.approx(1 / (1 + math.exp(3.0)))


def plain_clause(read, reach=3):
    """What each word of a clause gives, straight from the words around it."""
    out = []
    for i, (cls, weight) in enumerate(read):
        near = lambda kind: any(c == kind for c, _ in read[max(0, i - reach) : i])  # noqa: E731, B023
        directed = cls == toxicity.INSULT and near(toxicity.TARGET)
        threat = (cls == toxicity.TARGET and near(toxicity.THREAT)) or (cls == toxicity.THREAT and near(toxicity.TARGET))
        gain = 1.25 if directed else 1.0 if cls == toxicity.INSULT else 1.5 if threat else 0
        if gain:
            out.append((weight * gain, near(toxicity.NEGATION) or any(c == toxicity.REPORT for c, _ in read[:i])))
    plain, off = (sum(w for w, held in out if held is k) for k in (False, True))
    return (plain or off, not plain) if plain or off else None


def test_grammar_against_plain_reading():
    r = random.Random(14)
    m = toxicity.Model(words={"fool": 2.0, "oaf": 1.5}, stems={"idio": 3.0})
    ready, words = m.prefilter(), ["fool", "oaf", "idiots", "Idio", "kill", "HURT", "you", "them", "not", "never", "said", "wrote", "the", "tree", "7"]
    for _ in range(3000):
        clauses = [" ".join(r.choice(words) for _ in range(r.randint(0, 9))) for _ in range(r.randint(1, 3))]
        text, want = "; ".join(clauses), []
        for c in clauses:
            got = plain_clause([m.read(w) for w in c.lower().split() if w.isalpha()])
            if got:
                want.append(got)
        assert [(pytest.approx(s), off) for _, _, s, off in m.clauses(text, ready)] == want, text


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels)
    rows = toxicity.scored(docs, model).join(labels, "doc_id").where(toxicity.held_out()).select("score", "toxic").collect()
    caught = [r.score >= 0.7 for r in rows if r.toxic]
    wrong = [r.score >= 0.7 for r in rows if not r.toxic]
    assert sum(caught) / len(caught) > 0.85 and sum(wrong) / len(wrong) < 0.01


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (2, "", 0.5), (3, "a " * 60000, 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.scored(docs, model).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.without_toxic(docs, model).count() == 4
    assert toxicity.scored(docs.limit(0), model).count() == 0


# --- pipeline


def test_pipeline(spark, sf):
    import corpus_pipeline as p
    from claimloom.llm import decontam, minhash, pii

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(p.STAGES):
        before, docs = docs, stage(spark, docs, sf)
        docs = p.cut(docs, name)
        kept[name] = docs
        if k + 1 < len(p.STAGES):
            assert docs.schema.simpleString() == before.schema.simpleString()
    tox, near, clean, masked, packed = (kept[n] for n, _ in p.STAGES)
    model = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    low = {r.doc_id for r in toxicity.scored(spark.read.parquet(f"{sf}/documents.parquet"), model).where("score < 0.7").collect()}
    assert {r.doc_id for r in tox.collect()} == low
    assert {r.doc_id for r in near.collect()} == {r.doc_id for r in minhash.near_texts(tox).where("kept").collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in near.collect()} == {r.doc_id for r in masked.collect()} == {r.doc_id for r in packed.select("doc_id").distinct().collect()}
    hit = {r.doc_id for r in decontam.contamination(near, spark.read.parquet(f"{sf}/benchmark.parquet")).where("n_hit > 0").collect()}
    was, now = ({r.doc_id: r for r in f.collect()} for f in (near, clean))
    assert {d for d in was if was[d].text != now[d].text} == hit
    assert decontam.contamination(clean, spark.read.parquet(f"{sf}/benchmark.parquet")).where("n_hit > 0").count() == 0
    assert pii.digest(pii.pii_spans(masked)).where("n_email + n_ip + n_card + n_phone > 0").count() == 0
    assert all(r.n_chars == len(r.text) for r in masked.collect() if r.text != was[r.doc_id].text)


def test_pipeline_edges(spark, sf):
    import corpus_pipeline as p

    rows = [(None, "one two three four five six", "en", "s", 27), (None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "word " * 90000, "en", "s", 450000), (3, "word " * 90000, "en", "s", 450000)]
    rows += [(4, "tie tie mail bob@x.org now", "en", "s", 26), (5, "tie tie mail bob@x.org now", "en", "s", 26), (5, "tie tie mail bob@x.org now", "en", "s", 26)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, component long, score double, _hits int, spans string, kept boolean, content string, rep long, length int, piece string"
    docs = spark.createDataFrame([(*r, "i", 1, 0.5, 2, "s", False, "c", 7, 8, "p") for r in rows], schema)
    for frame in (docs, docs.limit(0)):
        counts = []
        for k, (name, stage) in enumerate(p.STAGES):
            before, frame = frame, p.cut(stage(spark, frame, sf), name)
            counts.append(frame.count())
            if k + 1 < len(p.STAGES):
                assert frame.schema.simpleString() == before.schema.simpleString()
        if counts[0]:
            assert counts[:4] == [9, 7, 7, 7] and {r.text for r in before.where("doc_id = 4").collect()} == {"tie tie mail <email> now"}
            assert before.where("doc_id is null").count() == 2 and before.where("doc_id = 3").count() == 2 and before.where("doc_id = 1").first().text is None
            assert frame.where("doc_id = 4").count() == 1 and frame.agg({"length": "max"}).first()[0] == 1024
        else:
            assert counts == [0] * 5
