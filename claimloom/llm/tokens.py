"""Byte-level BPE: chunk-cached ids, and exact token counts at every prefix (operators 10 and 4)."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from functools import cached_property
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import slices, strings

#: Counts are taken for groups of texts: chunks that are new in a group go through the table together.
GROUP_ROWS, GROUP_BYTES = 4096, 4 << 20
#: Chunks of more bytes than this go through the table alone, not in columns beside others.
WIDE = 48

#: Unicode White_Space, which the tokenizer's pattern calls \s.
SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Aho-Corasick over the bytes of the vocabulary: after each byte, the tokens that end there, longest first.

    A state stands for the longest stretch before a place that begins some token; ``goto`` is its whole transition table.
    ``ends`` gives the state of the longest token that ends at a state, and ``shorter`` that of the next one; -1 is none.
    """

    def __init__(self, rank: dict[bytes, int]):
        stretches = {t[:k] for t in rank for k in range(len(t) + 1)}
        levels = [list(own) for _, own in groupby(sorted(stretches, key=len), len)]
        number = {t: k for k, t in enumerate(chain.from_iterable(levels))}
        n = len(number)
        self.goto = np.zeros((n, 256), np.int32)
        self.token, self.size = np.full(n, -1, np.int32), np.zeros(n, np.int32)
        self.ends, self.shorter = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        for depth, level in enumerate(levels):
            own = np.array([number[t] for t in level])
            self.size[own] = depth
            if depth:
                parent, byte = np.array([number[t[:-1]] for t in level]), np.array([t[-1] for t in level])
                fail = self.goto[fails[parent], byte] if depth > 1 else np.zeros(len(own), np.int32)
                self.goto[parent, byte] = own
                self.goto[own] = self.goto[fail]
                self.token[own] = token = np.array([rank.get(t, -1) for t in level])
                self.shorter[own] = self.ends[fail]
                self.ends[own] = np.where(token >= 0, own, self.ends[fail])
                fails[own] = fail
            else:
                fails = np.zeros(n, np.int32)


class Bpe:
    """A byte-level BPE file as ranks.

    Texts are cut at every space before a non-space: there the tokenizer's own pre-tokenization always cuts too, so ids and
    counts of a chunk do not depend on its neighbours, and repeated chunks come from a bounded cache.
    """

    def __init__(self, path: str, cache: int = 1 << 18):
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("a byte-level BPE file without prefix space and normalizer is needed")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.special.items()}
        alphabet = byte_alphabet()
        self.rank = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        vocab = spec["model"]["vocab"]
        parts = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        joined = [a + b for a, b in parts]
        #: token -> the two it is merged from, and the other way round; a token's id is the rank of its merge
        self.halves = {vocab[m]: (vocab[a], vocab[b]) for m, (a, b) in zip(joined, parts)}
        self.merges = {pair: m for m, pair in self.halves.items()}
        order = [vocab[m] for m in joined]
        if order != sorted(order):
            raise ValueError("ids must follow the order of the merges")
        pattern = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
        self.pieces = regex.compile(pattern).findall
        self.cut = regex.compile(rf" (?=[^{SPACE}])").split
        self.white = regex.compile(rf"[{SPACE}]+").fullmatch
        self.blank = {chr(c) for c in range(0x3001) if self.white(chr(c))}
        self.blank_code = np.array([chr(c) in self.blank for c in range(0x3002)])
        self.runs = regex.compile(rf"([{SPACE}]+) (?=[^{SPACE}])").finditer
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.enc = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=self.rank, special_tokens={})
        self.size = cache
        self.ids_cache: dict[str, bytes] = {}
        self.count_cache: dict[str, bytes] = {}
        self.pair_cache: dict[int, bool] = {}
        self.known, self.verdict = np.array([1 << 62]), np.zeros(1, bool)

    @cached_property
    def automaton(self) -> Automaton:
        return Automaton(self.rank)

    def segments(self, text: str) -> Iterator[tuple[str, int]]:
        """Plain stretches and the special token that follows each; -1 after the last."""
        if not any(s in text for s in self.special):
            yield text, -1
            return
        at = 0
        for m in self.at_special.finditer(text):
            yield text[at : m.start()], self.special[m[0]]
            at = m.end()
        yield text[at:], -1

    def coded(self, text: str, code, cache: dict[str, bytes]) -> bytes:
        """``code`` of each chunk, joined; chunks after the first start with a space and come from the cache."""
        first, *rest = text.split(" ")
        if len(cache) > self.size:
            cache.clear()
        get, out = cache.get, [code(first)]
        for c in rest:
            x = get(c)
            if x is None:
                if not c or c[0] in self.blank:  # this space starts no chunk
                    first, *rest = self.cut(text)
                    return code(first) + b"".join(code(" " + c) for c in rest)
                x = cache[c] = code(" " + c)
            out.append(x)
        return b"".join(out)

    def _ids(self, chunk: str) -> bytes:
        ids = self.enc.encode_ordinary(chunk)
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers; special strings become their token, as the library does by default."""
        out = []
        for plain, special in self.segments(text):
            out.append(self.coded(plain, self._ids, self.ids_cache))
            if special >= 0:
                out.append(struct.pack("<I", special))
        return b"".join(out)

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The parts that stood at one edge of a token while it was built, each with the rank at which it was used up."""
        out, until = [], 1 << 30
        while True:
            out.append((token, until))
            if token not in self.halves:
                return out
            until, token = token, self.halves[token][side]

    def _apart(self, left: int, right: int) -> bool:
        """Whether BPE keeps two tokens apart when their bytes stand together.

        A merge across the border happens if its rank comes before those that use up the two parts; of equal ranks the one
        further left goes first.
        """
        merges = self.merges
        for x, x_until in self._edge(left, 1):
            for y, y_until in self._edge(right, 0):
                m = merges.get((x, y))
                if m is not None and m < x_until and m <= y_until:
                    return False
        return True

    def _pair(self, key: int) -> bool:
        """``_apart`` of a pair in one number, from a bounded cache."""
        ok = self.pair_cache.get(key)
        if ok is None:
            if len(self.pair_cache) > 1 << 20:
                self.pair_cache.clear()
            ok = self.pair_cache[key] = self._apart(key >> 20, key & 0xFFFFF)
        return ok

    def _prefixes(self, piece: bytes) -> list[int]:
        """Token count of BPE for each prefix of ``piece``, from the empty one on.

        The last token of a prefix is the one that ends there and stays apart from the last token of the prefix before it;
        exactly one fits, so each prefix costs a step of the automaton and a look at the tokens that end there, and none is
        encoded again.
        """
        a, state = self.automaton, 0
        last, count = [0] * (len(piece) + 1), [0] * (len(piece) + 1)
        for i, byte in enumerate(piece, 1):
            state = a.goto.item(state, byte)
            u = a.ends.item(state)
            while (j := i - a.size.item(u)) and not self._pair(last[j] << 20 | a.token.item(u)):
                u = a.shorter.item(u)
            last[i] = a.token.item(u)
            count[i] = count[j] + 1
        return count

    def _apart_all(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 20 | right
        at = np.searchsorted(self.known, key)
        ok = self.verdict[at]
        new = np.flatnonzero(self.known[at] != key)
        if len(new):
            keys, back = np.unique(key[new], return_inverse=True)
            ok[new] = np.array([self._pair(k) for k in keys.tolist()])[back]
        return ok

    def _columns(self, data: np.ndarray, opens: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``data``, count of the prefix that ends there) for many chunks at once: the table of ``_prefixes``.

        A chunk is a column that begins at ``begin`` and has ``size`` bytes, longer ones first; ``opens`` tells where a piece
        begins, which is where the automaton starts anew.
        """
        a, n, width = self.automaton, len(begin), int(size[0])
        last, count = np.zeros((width + 1, n), np.int32), np.zeros((width + 1, n), np.int32)
        state, start = np.zeros(n, np.int32), np.zeros(n, np.int64)
        many = np.searchsorted(-size, -np.arange(1, width + 1), side="right")
        for i, m in enumerate(many.tolist(), 1):
            at = begin[:m] + (i - 1)
            fresh = opens[at]
            start = np.where(fresh, i - 1, start[:m])
            state = a.goto[np.where(fresh, 0, state[:m]), data[at]]
            rows, u = np.arange(m), a.ends[state]
            while len(rows):
                j, token = i - a.size[u], a.token[u]
                ok = j == start[rows]
                ask = np.flatnonzero(~ok)
                ok[ask] = self._apart_all(last[j[ask], rows[ask]], token[ask])
                done = rows[ok]
                last[i, done] = token[ok]
                count[i, done] = count[j[ok], done] + 1
                rows, u = rows[~ok], a.shorter[u[~ok]]
        inside = np.arange(width)[:, None] < size
        return (begin + np.arange(width)[:, None])[inside], count[1:][inside]

    def _chunk_deltas(self, chunks: list[str], heads: list[str]) -> list[bytes]:
        """For each chunk, and each head (the first chunk of a text), a signed byte per character: what it adds to the count."""
        if len(self.pair_cache) > 1.1 * len(self.known):
            self.known = np.append(np.sort(np.fromiter(self.pair_cache, np.int64, len(self.pair_cache))), 1 << 62)
            self.verdict = np.array([self.pair_cache.get(k, False) for k in self.known.tolist()])
        joined = "".join(chunks)
        pieces = self.pieces(joined)  # chunks together have the pieces that each has alone
        for head in heads:
            pieces += self.pieces(head)
        whole = joined + "".join(heads)
        data = np.frombuffer(whole.encode(), np.uint8)
        chars = np.append(np.flatnonzero(data & 0xC0 != 0x80), len(data))  # where characters begin
        ends = np.cumsum(np.fromiter(map(len, [*chunks, *heads]), np.int64, len(chunks) + len(heads)))
        bounds = np.concatenate(([0], chars[ends]))
        begin, size = bounds[:-1], np.diff(bounds)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        piece_starts = np.cumsum(lengths) - lengths
        opens = np.zeros(len(data), bool)
        opens[chars[piece_starts]] = True
        count = np.zeros(len(data), np.int64)
        order = np.argsort(-size, kind="stable")
        for k in order[size[order] > WIDE].tolist():
            of, total = [*(np.flatnonzero(opens[begin[k] : begin[k] + size[k]]) + begin[k]).tolist(), int(begin[k] + size[k])], 0
            for x, y in zip(of, of[1:]):
                count[x:y] = np.array(self._prefixes(data[x:y].tobytes())[1:]) + total
                total = int(count[y - 1])
        order = order[(size[order] <= WIDE) & (size[order] > 0)]
        for x in range(0, len(order), 1 << 14):
            own = order[x : x + (1 << 14)]
            at, n = self._columns(data, opens, begin[own], size[own])
            count[at] = n
        at_end = count[chars[1:] - 1]  # after each character
        deltas = np.diff(at_end, prepend=0)
        first = ends[:-1][size[1:] > 0] if len(ends) else ends
        deltas[first] = at_end[first]
        code = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        blank = self.blank_code[np.minimum(code, len(self.blank_code) - 1)]
        for k in piece_starts[(code[piece_starts] == 39) & (lengths == 3)].tolist():
            if whole[k : k + 3] in ("'re", "'ve", "'ll"):  # "'r" is not yet a contraction
                deltas[k : k + 3] = (1, 1, deltas[k : k + 3].sum() - 2)
        starts_chunk = np.zeros(len(code) + 1, bool)
        starts_chunk[ends] = True
        late = np.flatnonzero(blank[piece_starts] & blank[piece_starts - 1] & ~starts_chunk[piece_starts] & (piece_starts > 0))
        patches = [(k := int(piece_starts[x]), self._joined_space(pieces[x - 1], whole[k]) - int(deltas[k])) for x in late.tolist()]
        for k, more in patches:  # until a non-space follows, the whole run is one piece
            deltas[k] += more
            deltas[k + 1] -= more
        raw, bounds = deltas.astype(np.int8).tobytes(), [0, *ends.tolist()]
        return [raw[x:y] for x, y in zip(bounds, bounds[1:])]

    def _joined_space(self, run: str, char: str) -> int:
        """How the count changes when ``char`` joins a run of white space."""
        return self._prefixes((run + char).encode())[-1] - self._prefixes(run.encode())[-1]

    def group_deltas(self, texts: list[str]) -> list[np.ndarray]:
        """For each text int8 per character; the running sum is the token count of every prefix.

        Chunks that the cache lacks go through the table together. A cache over its size keeps what this group used.
        """
        cache, new, heads, plans = self.count_cache, set(), set(), []
        for text in texts:
            plan = []
            for plain, special in self.segments(text):
                size = len(plain)
                if special >= 0:  # until it is whole, the special string is ordinary text
                    plain += self.names[special][:-1]
                head, *rest = plain.split(" ")
                own = set(rest).difference(cache)
                if any(not c or c[0] in self.blank for c in own):  # a space that starts no chunk
                    head, *rest = self.cut(plain)
                    own = set(rest).difference(cache)
                new |= own
                heads.add(head)
                plan.append((plain, head, rest, special, size))
            plans.append(plan)
        fresh, heads = list(new), list(heads)
        found = self._chunk_deltas([" " + c for c in fresh], heads)
        cache.update(zip(fresh, found))
        of_head = dict(zip(heads, found[len(fresh) :]))
        out = []
        for plan in plans:
            parts = []
            for plain, head, rest, special, size in plan:
                d = np.frombuffer(of_head[head] + b"".join(map(cache.__getitem__, rest)), np.int8)
                for m in self.runs(plain):
                    d = d if d.flags.writeable else d.copy()
                    run, at = m[1], m.end() - 1
                    more = self._joined_space(run, " ") - 1
                    d[at] += more
                    d[at + 1] -= more
                parts.append(d)
                if special >= 0:
                    parts.append(np.array([1 - int(d[size:].sum(dtype=np.int64))], np.int8))
            out.append(parts[0] if len(parts) == 1 else np.concatenate(parts))
        if len(cache) > self.size:
            self.count_cache = {c: cache[c] for plan in plans for p in plan for c in p[2]}
        return out

    def prefix_deltas(self, text: str) -> np.ndarray:
        return self.group_deltas([text])[0]


_LOADED: dict[tuple[str, int], Bpe] = {}


def loaded(path: str, cache: int = 1 << 18) -> Bpe:
    if (path, cache) not in _LOADED:
        _LOADED[path, cache] = Bpe(path, cache)
    return _LOADED[path, cache]


def prefix_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, deltas): one signed byte per character whose running sum is the exact token count of each prefix.

    The table answers, without encoding again, how many tokens any prefix has (``count_at``) and which prefix fits a
    budget (``fit_budget``). Null texts count as empty and have no bytes; repeated rows give repeated rows.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, 1 << 19)
        for b in slices(batches, GROUP_ROWS, GROUP_BYTES):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([d.tobytes() for d in bpe.group_deltas(strings(b, "text"))], pa.binary())], ["id", "deltas"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, deltas binary").withColumnRenamed("id", id_col)


def levels(deltas: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(deltas, dtype=np.int8), dtype=np.int64)


def fit_budget(prefixes: DataFrame, budget: int, *, id_col: str = "doc_id") -> DataFrame:
    """(id, fits_chars, n_tokens): the longest prefix of at most ``budget`` tokens, from a table of ``prefix_counts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fits, total = [], []
            for d in b.column(1).to_pylist():
                c = levels(d)
                total.append(int(c[-1]) if len(c) else 0)
                fits.append(len(c) if not len(c) or c[-1] <= budget else int(np.flatnonzero(c <= budget)[-1]) + 1 if (c <= budget).any() else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fits, pa.int64()), pa.array(total, pa.int64())], ["id", "fits_chars", "n_tokens"])

    source = prefixes.select(F.col(id_col).alias("id"), "deltas")
    return source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, fits_chars long, n_tokens long").withColumnRenamed("id", id_col)


def count_at(prefixes: DataFrame, questions: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """(id, chars, n_tokens): tokens of the first ``chars`` characters, for each row (id, chars) of ``questions``.

    Questions for unknown ids are dropped; ``chars`` beyond the text count the whole text, below 1 nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n = []
            for k, d in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                c = levels(d)
                n.append(int(c[min(k, len(c)) - 1]) if k and k > 0 and len(c) else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["id", "chars", "n_tokens"])

    source = questions.select(F.col(id_col).alias("id"), F.col("chars").cast("long")).join(prefixes.select(F.col(id_col).alias("id"), "deltas").hint("merge"), "id")
    return source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, chars long, n_tokens long").withColumnRenamed("id", id_col)


def token_counts(docs: DataFrame, *, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, fits_chars) for every row, through the prefix table, in one pass.

    Null texts count as empty: 0 bytes, 0 tokens. ``fits_chars`` is the longest prefix of at most ``limit`` tokens.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, 1 << 19)
        for b in slices(batches, GROUP_ROWS, GROUP_BYTES):
            size, total, fits = [], [], []
            texts = strings(b, "text")
            for t, d in zip(texts, bpe.group_deltas(texts)):
                c = np.cumsum(d, dtype=np.int64)
                n = int(c[-1]) if len(c) else 0
                size.append(len(t.encode()))
                total.append(n)
                fits.append(len(c) if n <= limit else int(np.flatnonzero(c <= limit)[-1]) + 1 if (c <= limit).any() else 0)
            n = pa.array(total, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), n, pa.array([x > limit for x in total], pa.bool_()), pa.array(fits, pa.int64())], ["id", "n_bytes", "n_tokens", "over_limit", "fits_chars"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, n_bytes long, n_tokens long, over_limit boolean, fits_chars long").withColumnRenamed("id", id_col)
