"""Personal data: base expressions, and a linear-chain conditional random field over word shapes (operator 5)."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import slices, strings, with_texts

#: In the order in which kinds at one start are listed.
KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]\S*")
_WORD = re.compile(r"\S+")
_DIGIT = re.compile(r"[0-9]+")
_AFTER = re.compile(r"\s*(\S*)\s*(\S*)\s*(\S*)")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end): leftmost non-overlapping matches of each kind; those that fail its test are dropped.

    Each kind is found from the character it can't be without, so that long texts are passed once and no run of letters
    or digits is tried again from each of its places.
    """
    out, past, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > past and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            past = m.end()
        at = text.find("@", max(at + 1, past))
    for m in _DOTTED.finditer(text):
        groups = m[0].split(".")
        start = m.start()
        for i in range(0, len(groups) - 3, 4):
            four = groups[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(x) <= 3 and int(x or 0) <= 255 for x in (g.lstrip("0") for g in four)):
                out.append((start, 1, end))
            start = end + 1
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


# --- the labelled table -------------------------------------------------------------------------------------------


def labelled_table(rounds: int = 12) -> list[tuple[list[str], list[str]]]:
    """Small sentences with a tag for each word, made from templates: {e}, {i}, {c}, {p} stand for personal data in the
    usual spellings, {n} for numbers and codes that are none. The same table each time."""
    templates = [
        "write to {e} for more", "mail {e}, or call {p}.", "contact: {e}", "<{e}>", "from {i} at night", "host {i}, port {n}",
        "the address {i}.", "card {c} was used", "pay with {c}, please", "number {c}.", "call {p} today", "phone: {p}", "tel. {p}, ask",
        "fax ({p})", "the {n} th part", "chapter {n} begins", "in {n} we met", "see {n}, {n} and {n}", "key {n} here", "{n} and so on",
        "version {n} of it", "about {n} people", "order {n} was sent", "id={n} end", "from {n} to {n}", "at {n} or later", "x {n} y {n} z",
    ]
    state = 7

    def draw(n: int) -> int:
        nonlocal state
        state = (state * 1103515245 + 12345) % (1 << 31)
        return state // 65536 % n

    def digits(n: int) -> str:
        return str(1 + draw(9)) + "".join(str(draw(10)) for _ in range(n - 1))

    def letters(n: int, alphabet: str = "abcdefghijklmnopqrstuvwxyz") -> str:
        return "".join(alphabet[draw(len(alphabet))] for _ in range(n))

    def email() -> str:
        name = (letters(3 + draw(6)), f"{letters(4)}.{letters(5)}", f"{letters(5)}_{digits(2)}", f"{letters(3)}.{digits(2)}")[draw(4)]
        return f"{name}@{letters(4 + draw(5))}{('', digits(1))[draw(2)]}.{('com', 'org', 'example.net', 'de')[draw(4)]}"

    def ip() -> str:
        return ".".join(str(draw(256)) for _ in range(4))

    def card() -> str:
        body = "4" + digits(14)
        body += next(str(d) for d in range(10) if luhn(body + str(d)))
        return (body, " ".join(body[i : i + 4] for i in range(0, 16, 4)), "-".join(body[i : i + 4] for i in range(0, 16, 4)))[draw(3)]

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return (f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{digits(2)} {a} {b}{c}", f"+1-{a}-{b}-{c}", f"{a}.{b}.{c}")[draw(6)]

    def odd(n: int) -> str:  # as long as a card's number, with a wrong check digit
        body = digits(n - 1)
        return body + next(str(d) for d in range(draw(9), 10) if not luhn(body + str(d)))

    def number() -> str:
        return (
            digits(1 + draw(4)), digits(1) + ".", f"{digits(1)}.{digits(1)}.", f"{digits(2)}.{digits(2)}", f"{digits(1)},{digits(3)}", "19" + digits(2), f"{digits(2)}%",
            f"20{digits(2)}-0{digits(1)}-1{digits(1)}", f"{digits(1)}:{digits(2)}", letters(20, "0123456789abcdef"), letters(40, "0123456789abcdef"), "AKIA" + letters(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
            f"password={letters(16, '0123456789abcdef')}", digits(6), f"{letters(3)}{digits(2)}", f"v{digits(1)}.{digits(1)}", f"({digits(1)})", f"{digits(2)}-{digits(2)}", "@" + letters(6),
            odd(16), " ".join(re.findall("....", odd(16))), odd(15), digits(20 + draw(5)), digits(10 + draw(3)),
        )[draw(24)]

    make = {"e": (email, "email"), "i": (ip, "ip"), "c": (card, "card"), "p": (phone, "phone"), "n": (number, None)}
    out = []
    for _ in range(rounds):
        for template in templates:
            text, marks = "", []
            for part in re.split(r"(\{\w\})", template):
                if re.fullmatch(r"\{\w\}", part):
                    f, kind = make[part[1]]
                    value = f()
                    if kind:
                        marks.append((len(text), len(text) + len(value), kind))
                    text += value
                else:
                    text += part
            words, tags = [], []
            for m in _WORD.finditer(text):
                words.append(m[0])
                mark = next((x for x in marks if m.start() < x[1] and m.end() > x[0]), None)
                tags.append("O" if mark is None else ("B-" if m.start() <= mark[0] else "I-") + mark[2])
            out.append((words, tags))
    return out


# --- features and model -------------------------------------------------------------------------------------------

_CLASS = {**dict.fromkeys("0123456789", "9"), **dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "X"), **dict.fromkeys("abcdefghijklmnopqrstuvwxyz", "x")}


def shape(word: str) -> str:
    """Letters, digits and signs by class, runs of a class written once."""
    out = ""
    for c in word:
        k = _CLASS.get(c) or ("x" if c.isalpha() else c)
        if not out.endswith(k):
            out += k
    return out


def has_trigger(word: str) -> bool:
    return any(c in "0123456789@" for c in word)


def valid(words: list[str], i: int) -> str:
    """Whether the digits of word ``i``, or of it and neighbours of four digits, are as many as a card has and pass Luhn."""
    four = lambda j: 0 <= j < len(words) and len(words[j]) in (4, 5) and words[j][:4].isdecimal()
    for first in range(i - 3, i + 1):
        if all(map(four, range(first, first + 4))):
            return str(luhn("".join(_DIGIT.findall(" ".join(w[:4] for w in words[first : first + 4])))))
    digits = "".join(_DIGIT.findall(words[i])) if len(words[i]) < 40 else ""
    return str(luhn(digits)) if 14 <= len(digits) <= 19 else ""


def features(words: list[str], i: int) -> list[str]:
    """Names of the features of one word: its shape, the lengths of its digit runs, its check digit, and its neighbours'
    shapes."""
    w = words[i]
    core = w.strip(".,;:!?()<>[]\"'")
    runs = "-".join(str(min(len(r), 20)) for r in re.findall(r"[0-9]+", core)[:6])
    count = sum(c.isdigit() for c in core)
    out = ["1", f"s={shape(core)}", f"r={runs}", f"d={min(count, 20)}", f"a={'@' in core}", f"dots={min(core.count('.'), 5)}", f"p={w[0] if not w[0].isalnum() else ''}", f"x={bool(re.search('[A-Za-z]', core))}", f"l={valid(words, i)}"]
    for k in (-2, -1, 1, 2):
        j = i + k
        if 0 <= j < len(words):
            n = words[j]
            out.append(f"{k}:{shape(n) + '/' + str(sum(c.isdigit() for c in n)) if has_trigger(n) else 'word'}")
        else:
            out.append(f"{k}:none")
    return out


class Crf:
    """Weights of a linear chain: features by tag and tag by tag. Words without a digit or @ are held at O."""

    def __init__(self, names: dict[str, int], unary: np.ndarray, pair: np.ndarray):
        self.names, self.unary, self.pair = names, unary, pair

    def scores(self, feats: list[str]) -> np.ndarray:
        ids = [self.names[f] for f in feats if f in self.names]
        return self.unary[ids].sum(0) if ids else np.zeros(len(TAGS))

    def viterbi(self, runs: list[np.ndarray]) -> list[np.ndarray]:
        """Best tags of each run of words (scores: words x tags) between two words at O; runs of all lengths in one batch."""
        order = sorted(range(len(runs)), key=lambda k: -len(runs[k]))
        out: list[np.ndarray] = [np.zeros(0, int)] * len(runs)
        n, longest = len(order), len(runs[order[0]]) if order else 0
        lengths = np.array([len(runs[k]) for k in order])
        best = np.empty((n, len(TAGS)))
        back = np.zeros((longest, n, len(TAGS)), np.int8)
        for t in range(longest):
            live = int((lengths > t).sum())
            u = np.stack([runs[order[k]][t] for k in range(live)])
            if t == 0:
                best[:live] = u + self.pair[0]
            else:
                step = best[:live, :, None] + self.pair[None]
                back[t, :live] = step.argmax(1)
                best[:live] = step.max(1) + u
        last = (best + self.pair[:, 0][None]).argmax(1) if n else []
        for k in range(n):
            tags = np.empty(lengths[k], int)
            tags[-1] = last[k]
            for t in range(lengths[k] - 1, 0, -1):
                tags[t - 1] = back[t, k, tags[t]]
            out[order[k]] = tags
        return out


def forward_backward(u: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Log sums over the paths to and from each tag of a run (scores: words x tags) between two words at O, and over all."""
    n = len(u)
    f, b = np.empty_like(u), np.empty_like(u)
    f[0], b[-1] = u[0] + pair[0], pair[:, 0]
    for t in range(1, n):
        f[t] = _logsum(f[t - 1][:, None] + pair, 0) + u[t]
    for t in range(n - 2, -1, -1):
        b[t] = _logsum(pair + (u[t + 1] + b[t + 1])[None], 1)
    return f, b, float(_logsum(f[-1] + b[-1], 0))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def train(table: list[tuple[list[str], list[str]]], *, epochs: int = 40, rate: float = 0.5, l2: float = 1e-3) -> Crf:
    """Maximum likelihood by AdaGrad over the labelled sentences; the same weights each time."""
    names: dict[str, int] = {}
    data = []
    for words, tags in table:
        i = 0
        while i < len(words):
            if not has_trigger(words[i]):
                i += 1
                continue
            j = i
            while j < len(words) and has_trigger(words[j]):
                j += 1
            ids = [[names.setdefault(f, len(names)) for f in features(words, k)] for k in range(i, j)]
            data.append((ids, [TAGS.index(t) for t in tags[i:j]]))
            i = j
    k = len(TAGS)
    unary, pair = np.zeros((len(names), k)), np.zeros((k, k))
    illegal = np.array([[-1e4 if b.startswith("I-") and a[2:] != b[2:] else 0.0 for b in TAGS] for a in TAGS])
    su, sp = np.full_like(unary, 1e-8), np.full_like(pair, 1e-8)
    for _ in range(epochs):
        gu, gp = -l2 * unary, -l2 * pair
        full = pair + illegal
        for ids, tags in data:
            n = len(ids)
            u = np.array([unary[i].sum(0) for i in ids])
            f, b, logz = forward_backward(u, full)
            for t in range(n):
                p = -np.exp(f[t] + b[t] - logz)
                p[tags[t]] += 1
                np.add.at(gu, ids[t], p / len(data))
            path = [0, *tags, 0]
            for a, c in zip(path, path[1:]):
                gp[a, c] += 1 / len(data)
            gp[0] -= np.exp(f[0] + b[0] - logz) / len(data)
            gp[:, 0] -= np.exp(f[-1] + b[-1] - logz) / len(data)
            for t in range(1, n):
                gp -= np.exp(f[t - 1][:, None] + full + (u[t] + b[t])[None] - logz) / len(data)
        su += gu**2
        sp += gp**2
        unary += rate * gu / np.sqrt(su)
        pair += rate * gp / np.sqrt(sp)
    return Crf(names, unary, pair + illegal)


def words_before(text: str, end: int, n: int) -> list[str]:
    """The ``n`` whole words before a place."""
    out = []
    while end and len(out) < n:
        while end and text[end - 1].isspace():
            end -= 1
        start = end
        while start and not text[start - 1].isspace():
            start -= 1
        if start < end:
            out.append(text[start:end])
        end = start
    return out[::-1]


def model_spans(texts: list[str], crf: Crf) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) that the chain tags in each text, decoded together."""
    runs, places = [], []
    known: dict[tuple[str, ...], np.ndarray] = {}
    for which, text in enumerate(texts):
        run: list[tuple[int, int]] = []
        past = 0
        spans = []
        for m in _TRIGGER.finditer(text):
            start = m.start()
            while start > past and not text[start - 1].isspace():
                start -= 1
            past = m.end()
            spans.append((start, past))
        for k, (start, end) in enumerate(spans):
            run.append((start, end))
            if k + 1 < len(spans) and text[end : spans[k + 1][0]].isspace():
                continue
            before = words_before(text, run[0][0], 3)
            after = [x for x in _AFTER.match(text, end).groups() if x]
            words = [*before, *(text[a:b] for a, b in run), *after]
            scores = []
            for i in range(len(run)):
                feats = features(words, len(before) + i)
                key = tuple(feats)
                if key not in known:
                    known[key] = crf.scores(feats)
                scores.append(known[key])
            runs.append(np.array(scores))
            places.append((which, run))
            run = []
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (which, run), tags in zip(places, crf.viterbi(runs)):
        i = 0
        while i < len(run):
            tag = TAGS[tags[i]]
            j = i + 1
            if tag != "O":
                while j < len(run) and TAGS[tags[j]] == "I-" + tag[2:]:
                    j += 1
                start, end = run[i][0], run[j - 1][1]
                text = texts[which]
                while start < end and text[start] in ".,;:!?<>[]\"'":
                    start += 1
                while end > start and text[end - 1] in ".,;:!?<>[]\"'":
                    end -= 1
                if start < end:
                    out[which].append((start, KINDS.index(tag[2:]), end))
            i = j
    return out


def all_spans(texts: list[str], crf: Crf) -> list[list[tuple[int, int, int, bool]]]:
    """(start, kind, end, base) of the base spans, and of those of the chain that overlap none of them."""
    out = []
    for base, more in zip(map(base_spans, texts), model_spans(texts, crf)):
        starts, ends = [x[0] for x in base], list(accumulate((x[2] for x in base), max))
        free = lambda x: not (k := bisect_left(starts, x[2])) or ends[k - 1] <= x[0]  # noqa: E731, B023
        out.append(sorted([(*x, True) for x in base] + [(*x, False) for x in more if free(x)]))
    return out


def pii_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", crf: Crf | None = None) -> DataFrame:
    """(id, spans array<struct<kind, start, end, value, base>>) for every row, in one pass and without a shuffle.

    The chain is trained on the driver from a small labelled table (a few hundred sentences, the same at every size of
    input) and goes to the tasks with the function. ``base`` tells the spans of the expressions from those that only the
    chain finds. Positions are code points, ends exclusive. Null or empty texts have no spans; repeated rows give
    repeated rows.
    """
    crf = crf or train(labelled_table())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("base", pa.bool_())]))
        for b in slices(batches):
            texts = strings(b, "text")
            spans = [[{"kind": KINDS[k], "start": s, "end": e, "value": t[s:e], "base": own} for s, k, e, own in found] for t, found in zip(texts, all_spans(texts, crf))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], ["id", "spans"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, spans array<struct<kind:string,start:bigint,end:bigint,value:string,base:boolean>>")
    return out.withColumnRenamed("id", id_col)


def digest(spans: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind and the SHA-256 of the base spans; the text of all spans."""

    def line(s):
        return F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    base = F.filter("spans", lambda x: x["base"])
    def count(kind: str):
        return F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return spans.select(id_col, *map(count, KINDS), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def masked(docs: DataFrame, *, text_col: str = "text", length_col: str | None = None, crf: Crf | None = None) -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind in angle brackets; other columns as they are,
    but for ``length_col`` (if given), which gets the new number of characters of a text that changes.

    Overlapping spans are replaced once, by the kind that starts first. Null texts stay null.
    """
    crf = crf or train(labelled_table())
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            column = b.column(text_col).to_pylist()
            out = []
            for t, spans in zip(column, all_spans([t or "" for t in column], crf)):
                if spans:
                    parts, at = [], 0
                    for s, k, e, _ in spans:
                        if s >= at:
                            parts += [t[at:s], f"<{KINDS[k]}>"]
                        at = max(at, e)
                    t = "".join(parts) + t[at:]
                out.append(t)
            yield with_texts(b, names, text_col, length_col, out)

    return docs.mapInArrow(run, docs.schema)
