"""Secrets and personal data against plain readings of their rules."""

import itertools
import random
import re

import numpy as np
import pytest

from claimloom.llm import pii, secrets

ASSIGN = r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PIECES = ["password", "PASSWD", "token", "apikey", "Api_Key", "secret", "s", ":", "=", " = ", '"', "'", "abcdefgh", "a1b2", "AKIA", "ABCDEFGH12345", "0123456789abcdef", "f" * 16, "é", "İ", "ſecret", "ghp_", " ", "\n", ".", "+1", "(555)", "555-1234", "10.0.0.1", "255.", "1.2", ".", "@", "bob", "mail.example", "4", "4111 1111 1111 1111", "-", "411111111111", "1111", "+", "9" * 12]


def texts(n=1500, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice(PIECES) for _ in range(r.randint(0, 14))) for _ in range(n)] + ["", "9" * 50, "1." * 30]


def plain_secrets(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


def plain_pii(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(len(y) < 4 and int(y or 0) <= 255 for y in (x.lstrip("0") for x in m[0].split(".")))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_secrets():
    a = secrets.automaton()
    for t in texts():
        assert [x for x in secrets.find(t, a) if x[1] < 3] == plain_secrets(t), t


def test_checksums():
    body = "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    good = "ghp_" + body + secrets.checksum62(body)
    bad = good[:-1] + ("A" if good[-1] != "A" else "B")
    a = secrets.automaton()
    assert [secrets.KINDS[k] for _, k, _ in secrets.find(f"x {good} y", a)] == ["github"]
    assert secrets.find(f"x {bad} y", a) == []


def test_base_pii():
    for t in texts(seed=5):
        assert pii.base_spans(t) == plain_pii(t), t


@pytest.fixture(scope="module")
def crf():
    return pii.train(pii.labelled_table())


def test_chain_reads_its_table(crf):
    right = total = 0
    for words, tags in pii.labelled_table(16)[-100:]:  # later rounds were not in training
        text = " ".join(words)
        want = set()
        at = 0
        for w, t in zip(words, tags):
            if t.startswith("B"):
                want.add(t[2:])
            at += len(w) + 1
        got = {pii.KINDS[k] for _, k, _ in pii.model_spans([text], crf)[0]}
        right += got == want
        total += 1
    assert right / total > 0.9


def test_chain_adds_and_keeps(crf):
    t = "call (366) 555-9807 now, see 9.9. and key=a9f3 and 19 people"
    found = pii.all_spans([t], crf)[0]
    assert [(pii.KINDS[k], t[s:e], base) for s, k, e, base in found] == [("phone", "(366) 555-9807", False)]
    for t in texts(200, seed=9):
        found = pii.all_spans([t], crf)[0]
        base, more = [x[:3] for x in found if x[3]], [x for x in found if not x[3]]
        assert base == pii.base_spans(t) and all(x[2] <= b[0] or x[0] >= b[2] for x in more for b in base)


def test_long_digit_runs(crf):
    for t in ("0" * 5000 + ".1.1.1", "9" * 5000 + ".1.1.1", "1.1.1." + "0" * 5000 + "1", "7" * 9000, "5 " * 9000, "a@b " * 9000, "@" * 9000):
        assert pii.base_spans(t) == plain_pii(t)
        assert [x[:3] for x in pii.all_spans([t], crf)[0] if x[3]] == pii.base_spans(t)


def test_decoding_against_all_paths():
    r = np.random.default_rng(4)
    tags = range(len(pii.TAGS))
    pair = r.normal(size=(len(pii.TAGS), len(pii.TAGS)))
    runs = [r.normal(size=(n, len(pii.TAGS))) for n in (1, 3, 2, 4, 1)]
    best = pii.Crf({}, np.zeros((0, len(pii.TAGS))), pair).viterbi(runs)
    for u, got in zip(runs, best):
        total = lambda path: sum(u[i][t] for i, t in enumerate(path)) + sum(pair[a, b] for a, b in zip((0, *path), (*path, 0)))  # noqa: E731, B023
        paths = list(itertools.product(tags, repeat=len(u)))
        sums = np.array([total(p) for p in paths])
        assert tuple(got) == paths[int(sums.argmax())]
        f, b, logz = pii.forward_backward(u, pair)
        assert np.isclose(logz, np.log(np.exp(sums).sum()))
        for t in range(len(u)):  # the marginals of each word
            own = [np.log(sum(np.exp(x) for p, x in zip(paths, sums) if p[t] == k)) for k in tags] if len(u) < 4 else f[t] + b[t]
            assert np.allclose(f[t] + b[t], own)


#: Written by hand, with words and spellings that no template has; {} marks what is personal.
OWN = [
    ("Bitte rufen Sie {(030) 555-8812} an, danke", "phone"), ("mi teléfono es {415-555-0132}, gracias", "phone"), ("joindre le {212.555.0199} avant midi", "phone"), ("Reach me: {(917) 555-0148} or never", "phone"),
    ("envoyez à {jean.dupont@exemple.fr} svp", "email"), ("{info@firma7.de} hilft", "email"), ("ping {172.16.4.20} failed", "ip"), ("La tarjeta {4539 1488 0343 6467} venció", "card"), ("karte {4539148803436467} gesperrt", "card"),
    ("Rechnung 4539148803436460 liegt bei", None), ("serial 1234567890123456 end", None), ("Isbn 978-3-16-148410-0 im Regal", None), ("am 12.10.2024 um 14:30", None), ("les années 1914-1918", None), ("row 17, seat 4b", None),
    ("commit 9f86d081884c7d659a2feaa0c55ad015 fixed it", None), ("pi is 3.14159", None), ("costs 1,299.00 euro", None), ("ratio 16:9 at 60 Hz", None), ("§ 823 Abs. 1 BGB", None), ("v2.10.3-rc1 released", None), ("@handle said 5 things", None),
]


def test_chain_on_other_sentences(crf):
    hits = found = wanted = 0
    for marked, kind in OWN:
        at, end = marked.find("{"), marked.find("}") - 1
        got = [(s, pii.KINDS[k], e) for s, k, e in pii.model_spans([marked.replace("{", "").replace("}", "")], crf)[0]]
        found += len(got)
        wanted += kind is not None
        hits += kind is not None and (at, kind, end) in got
    assert hits / found >= 0.9 and hits / wanted >= 0.75, (hits, found, wanted)


def test_frames(spark, crf):
    rows = [(1, "token = abcdefgh1 bob@x.org", "en"), (2, None, None), (3, "", "de"), (3, "", "de"), (4, "é" * 70000 + " AKIA" + "A" * 16, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in secrets.digest(secrets.secret_spans(df), secrets.KINDS[:3]).collect()}
    assert (got[1].n_assign, got[4].n_access, got[2].spans, got[4].spans) == (1, 1, "", "access:70001:70021")
    got = {r.doc_id: r for r in pii.digest(pii.pii_spans(df, crf=crf)).collect()}
    assert (got[1].n_email, got[2].n_email, got[2].spans) == (1, 0, "")
    assert {r.doc_id: r.text for r in pii.masked(df, crf=crf).collect()}[1] == "token = abcdefgh1 <email>"
    assert pii.masked(df, crf=crf).where("doc_id = 2").first().text is None
    empty = df.limit(0)
    assert secrets.secret_spans(empty).count() == pii.pii_spans(empty, crf=crf).count() == 0
