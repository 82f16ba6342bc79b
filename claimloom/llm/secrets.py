"""Secret scan: keyword prefilter, anchored expressions near hits, checksum validation (operator 2)."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import slices, strings

#: In the order in which kinds at one start are listed; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "github", "npm")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_CHECKED = {"github": re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"), "npm": re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")}

#: The lower-case keyword and the kind whose expression is tried where it stands.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm",
}

_DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def checksum62(body: str) -> str:
    """The six base-62 digits of the CRC-32 that such tokens end with."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = _DIGITS62[d] + out
    return out


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for k, kind in KEYWORDS.items():
        a.add_word(k, (len(k), kind))
    a.make_automaton()
    return a


def find(text: str, keywords) -> list[tuple[int, int, str]]:
    """(start, kind's place in KINDS, ...) of every secret: leftmost non-overlapping matches of each kind, failing ones dropped."""
    low = text.lower()
    if len(low) != len(text):
        low = text.translate(_ASCII_LOWER)
    hits = [(end - size + 1, kind) for end, (size, kind) in keywords.iter(low)]
    hits.sort()
    out, past = [], dict.fromkeys(KINDS, 0)
    for start, kind in hits:
        if start < past[kind]:
            continue  # inside an earlier match of its kind
        if kind == "assign":
            if m := _ASSIGN.match(text, start):
                past[kind] = m.end()
                if len(m[2]) >= 8:
                    out.append((start, 0, m.end()))
        elif kind == "access":
            if m := _ACCESS.match(text, start):
                past[kind] = m.end()
                if m.end() - start >= 16:
                    out.append((start, 1, m.end()))
        elif (m := _CHECKED[kind].match(text, start)) and checksum62(m[1]) == m[2]:
            past[kind] = m.end()
            out.append((start, KINDS.index(kind), m.end()))
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    out.sort()
    return out


def secret_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, end, value>>) for every row, in one pass and without a shuffle.

    An automaton finds the keywords of all kinds in one scan; the expression of a kind is tried only where its keyword
    stands. Runs of hexadecimal digits have no keyword and are scanned for directly. Tokens that carry a checksum
    (kinds ``github`` and ``npm``) count only if it holds. Positions are code points, ends exclusive. Null or empty
    texts have no spans; repeated rows give repeated rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
        for b in slices(batches):
            spans = [[{"kind": KINDS[k], "start": s, "end": e, "value": t[s:e]} for s, k, e in find(t, a)] for t in strings(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], ["id", "spans"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, spans array<struct<kind:string,start:bigint,end:bigint,value:string>>")
    return out.withColumnRenamed("id", id_col)


def digest(spans: DataFrame, kinds: tuple[str, ...], *, id_col: str = "doc_id") -> DataFrame:
    """Counts by base kind, the SHA-256 of the base spans and the text of all spans."""

    def line(only_base: bool):
        s = F.col("spans")
        if only_base:
            s = F.filter(s, lambda x: x["kind"].isin(*kinds))
        return F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return spans.select(id_col, *map(count, kinds), F.sha2(line(True), 256).alias("base_sha256"), line(False).alias("spans"))
