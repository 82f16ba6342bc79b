"""Benchmark decontamination with an FM-index per training shard (operator 6)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import batched, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import WORD_BYTES, cut, raw_bytes, slices, with_texts, words

_WORD = re.compile(rb"[^ ]+")


class WaveletMatrix:
    """Rank of a symbol before a place, for many places at once."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.cums, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.cums.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int64))))
            zero = symbols[bit == 0]
            self.zeros.append(len(zero))
            symbols = np.concatenate((zero, symbols[bit == 1]))

    def _follow(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for level, cum, zeros in zip(range(self.bits - 1, -1, -1), self.cums, self.zeros):
            ones = cum[place]
            place = np.where((symbol >> level) & 1, zeros + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        return self._follow(symbol, place) - self._follow(symbol, np.zeros_like(place))


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """By prefix doubling; zeros are separators, each smaller than every symbol and different from the other zeros."""
    n = len(symbols)
    zeros = symbols == 0
    rank = np.where(zeros, np.cumsum(zeros) - 1, symbols.astype(np.int64) + int(zeros.sum()))
    step = 1
    order = np.argsort(rank, kind="stable")
    while True:
        ordered = rank[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank = new
        if n == 0 or rank.max() == n - 1:
            return order
        second = np.full(n, -1, np.int64)
        second[:-step] = rank[step:]
        rank = rank * (n + 1) + second + 1
        order = np.argsort(rank, kind="stable")
        step *= 2


class FmIndex:
    """Backward search over word numbers; zeros separate stretches and match nothing."""

    def __init__(self, symbols: np.ndarray, top: int, every: int = 8):
        n = len(symbols)
        order = suffix_array(symbols)
        before = symbols[order - 1]  # the character before the first suffix is the last one, a separator
        self.bwt = before
        self.tree = WaveletMatrix(before, top)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=top + 1))))
        # places kept: every few characters, and after each separator, so that no walk crosses one
        self.kept = (order % every == 0) | (before == 0)
        self.kept_before = np.concatenate(([0], np.cumsum(self.kept)))
        self.kept_place = order[self.kept]
        self.n = n

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows (low, high) of the suffixes that start with each pattern; all patterns have the same length."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[:, k]
            low = self.first[c] + self.tree.rank(c, low)
            high = np.maximum(low, self.first[c] + self.tree.rank(c, high))
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of rows: step back until a kept place."""
        place, steps = np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        rows = rows.copy()
        while len(todo):
            done = self.kept[rows[todo]]
            at = todo[done]
            place[at] = self.kept_place[self.kept_before[rows[at]]] + steps[at]
            todo = todo[~done]
            r = rows[todo]
            c = self.bwt[r]
            rows[todo] = self.first[c] + self.tree.rank(c, r)
            steps[todo] += 1
        return place


class Phrases:
    """Windows of the benchmark items: ``width`` consecutive words, or a whole shorter item. Items that repeat an id count
    as one item with the windows of all its rows."""

    def __init__(self, items: list[tuple[object, bytes]], width: int):
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        known: dict[object, int] = {}
        by_size: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for item, text in items:
            ids = np.array([number(w, len(self.vocabulary) + 1) for w in words(text)], np.int32)
            if len(ids):
                size = min(width, len(ids))
                windows = np.lib.stride_tricks.sliding_window_view(ids, size)
                by_size.setdefault(size, []).append((windows, np.full(len(windows), known.setdefault(item, len(known)))))
        self.items = list(known)
        self.groups = []
        for size, own in sorted(by_size.items()):
            windows, of = np.concatenate([w for w, _ in own]), np.concatenate([i for _, i in own])
            patterns, which = np.unique(windows, axis=0, return_inverse=True)
            pairs = np.unique(which.reshape(-1).astype(np.int64) * len(self.items) + of)
            counts = np.bincount(pairs // len(self.items), minlength=len(patterns))
            self.groups.append((size, patterns.astype(np.int64), np.concatenate(([0], np.cumsum(counts))), pairs % len(self.items)))
        self.shortest = min(by_size, default=0)


def shard_hits(texts: list[bytes], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[object]]]:
    """For a shard: words per text, where each text starts among all words, which words are hit, items found per text.

    Words that no item has, and stretches of other words too short for any window, can't be part of an occurrence; they
    become separators before the index is built.
    """
    get = phrases.vocabulary.get
    parts, sizes = [], []
    for t in texts:
        w = words(t)
        sizes.append(len(w))
        parts.append(np.fromiter(map(get, w, repeat(0)), np.int32, len(w)))
    sizes = np.array(sizes, np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    hit = np.zeros(int(starts[-1]), bool)
    items: list[list[object]] = [[] for _ in texts]
    if not phrases.groups or not len(hit):
        return sizes, starts, hit, items
    symbols = np.concatenate(parts)
    # stretches of known words, cut where a text ends
    known = symbols > 0
    owner = np.repeat(np.arange(len(texts)), sizes)
    begins = known & np.concatenate(([True], ~known[:-1] | (owner[1:] != owner[:-1])))
    stretch = np.cumsum(begins)[known] - 1
    length = np.bincount(stretch) if len(stretch) else np.zeros(0, np.int64)
    keep = np.flatnonzero(known)[length[stretch] >= phrases.shortest] if len(stretch) else np.zeros(0, np.int64)
    if not len(keep):
        return sizes, starts, hit, items
    # the text of the index: each stretch kept and a separator after it
    ends = np.concatenate((begins[keep][1:], [True]))
    place = np.arange(len(keep)) + np.concatenate(([0], np.cumsum(ends)[:-1]))
    text = np.zeros(len(keep) + int(ends.sum()), np.int64)
    text[place] = symbols[keep]
    source = np.full(len(text), -1, np.int64)
    source[place] = keep
    index = FmIndex(text, len(phrases.vocabulary))
    cover = np.zeros(len(hit) + 1, np.int32)
    pairs = []
    for size, patterns, at, of_item in phrases.groups:
        low, high = index.search(patterns)
        count = high - low
        which = np.repeat(np.arange(len(patterns)), count)
        if not len(which):
            continue
        rows = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + low[which]
        begin = source[index.locate(rows)]
        np.add.at(cover, begin, 1)
        np.add.at(cover, begin + size, -1)
        text_of = owner[begin]
        seen = np.unique(text_of * len(patterns) + which)  # a text and a window, once
        text_of, which = seen // len(patterns), seen % len(patterns)
        n = at[which + 1] - at[which]
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[which], n)
        pairs.append(np.repeat(text_of, n) * len(phrases.items) + of_item[k])
    hit = np.cumsum(cover[:-1]) > 0
    for key in np.unique(np.concatenate(pairs)) if pairs else []:
        items[key // len(phrases.items)].append(phrases.items[key % len(phrases.items)])
    return sizes, starts, hit, items


def removal_spans(text: bytes, hit: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(start, end, word, past): merged byte spans of neighbouring hit words, and the words they are."""
    out: list[list[int]] = []
    past = -2
    for k, m in enumerate(_WORD.finditer(text.translate(WORD_BYTES))):
        if hit[k]:
            if past == k - 1:
                out[-1][1], out[-1][3] = m.end(), k + 1
            else:
                out.append([m.start(), m.end(), k, k + 1])
            past = k
    return [tuple(x) for x in out]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[object, bytes]]]:
    """The items in blocks of a bounded number of bytes."""
    source = benchmark.select(F.col(item_col).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("item is not null")
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        part = source if n == 1 else source.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k)
        yield [(r["item"], r["text"].encode()) for r in part.collect()]


#: So many blocks go through a task in one pass over the texts; then the rows are written, so that no task holds more.
BLOCKS_A_PASS = 4


def _hits(packed: bytes | None, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool) if packed else np.zeros(n, bool)


Finish = Callable[[pa.RecordBatch, list[bytes], list[bytes | None], list[list[str] | None]], pa.RecordBatch]


def _searched(docs: DataFrame, blocks: Iterator[list[tuple[object, bytes]]], width: int, text_col: str, shard_rows: int, finish: Finish, schema) -> DataFrame:
    """``finish`` of each shard: its rows, their texts, a bit for each word that any block hits, and the items found.

    Each block is searched in the texts as they are, ``BLOCKS_A_PASS`` of them in a pass; between passes the bits and items
    go along with their row in two columns more, whose names ``docs`` lacks. The driver holds two passes' blocks at most.
    """
    names, taken = docs.columns, {c.lower() for c in docs.columns}
    more = [next(x for x in (f"_{name}{k}" for k in range(len(names) + 1)) if x not in taken) for name in ("hits", "items")]
    out = docs.select("*", F.lit(None).cast("binary").alias(more[0]), F.lit(None).cast("array<string>").alias(more[1]))

    def one_pass(group: tuple[Phrases, ...], last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, shard_rows):
                texts, packed, found = raw_bytes(b, text_col), b.column(more[0]).to_pylist(), b.column(more[1]).to_pylist()
                for phrases in group:
                    _, starts, hit, items = shard_hits(texts, phrases)
                    for k in range(b.num_rows):
                        own = hit[starts[k] : starts[k + 1]]
                        if own.any():
                            packed[k] = np.packbits(own | _hits(packed[k], len(own))).tobytes()
                            found[k] = [*(found[k] or []), *map(str, items[k])]
                if last:
                    yield finish(b.select(names), texts, packed, found)
                else:
                    columns = [*(b.column(c) for c in names), pa.array(packed, pa.binary()), pa.array(found, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(columns, [*names, *more])

        return run

    held = None
    for group in batched((Phrases(block, width) for block in blocks), BLOCKS_A_PASS):
        if held is not None:
            out = cut(out.mapInArrow(one_pass(held, False), out.schema), "marked")
        held = group
    return out.mapInArrow(one_pass(held, True), schema)


def contamination(docs: DataFrame, benchmark: DataFrame, *, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 4 << 20, shard_rows: int = 2048) -> DataFrame:
    """(id, n_words, n_hit, items array<string>, spans array<struct<start, end, word, past>>) for every row of ``docs``.

    Each ``shard_rows`` documents of a task, or fewer with 8 MB of text, are a shard with its own index; no shuffle. The
    benchmark goes to the tasks in blocks of about ``block_bytes``, BLOCKS_A_PASS of them in a pass over the texts, and hits
    go along with the row, so the number of blocks changes no result. Between passes the rows are written to the shared
    folder. Spans are the removal spans in code points and the words they hold, neighbours merged. Null texts have no
    words; an empty benchmark hits nothing; items with a null id are left out, items that repeat an id are one; rows that
    repeat an id each get a row.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {dict(source.dtypes)['id']}, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long,word:long,past:long>>"
    span = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "end", "word", "past")]))

    def finish(b: pa.RecordBatch, texts: list[bytes], packed: list[bytes | None], found: list[list[str] | None]) -> pa.RecordBatch:
        sizes, n_hit, spans = [], [], []
        for t, bits in zip(texts, packed):
            own = _hits(bits, n := len(words(t)))
            sizes.append(n)
            n_hit.append(int(own.sum()))
            mine, at, char = [], 0, 0
            for a, e, w, p in removal_spans(t, own) if n_hit[-1] else ():
                start = char + len(t[at:a].decode())
                at, char = e, start + len(t[a:e].decode())
                mine.append({"start": start, "end": char, "word": w, "past": p})
            spans.append(mine)
        items = pa.array([sorted(set(x or [])) for x in found], pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(n_hit, pa.int64()), items, pa.array(spans, span)], ["id", "n_words", "n_hit", "items", "spans"])

    return _searched(source, _blocks(benchmark, item_col, item_text_col, block_bytes), width, "text", shard_rows, finish, schema).withColumnRenamed("id", id_col)


def digest(found: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    return found.select(id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def without_hits(docs: DataFrame, benchmark: DataFrame, *, width: int = 10, text_col: str = "text", length_col: str | None = None, item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 4 << 20, shard_rows: int = 2048) -> DataFrame:
    """``docs`` with the removal spans cut out of their texts; other columns as they are, but for ``length_col``
    (if given), which gets the new number of characters of a text that changes. Null texts stay null.

    The benchmark is searched block by block in the texts as they are; cuts come after the last.
    """
    names = docs.columns

    def finish(b: pa.RecordBatch, texts: list[bytes], packed: list[bytes | None], found: list[list[str] | None]) -> pa.RecordBatch:
        column = b.column(text_col).to_pylist()
        for k, (t, bits) in enumerate(zip(texts, packed)):
            if bits:
                parts, at = [], 0
                for a, e, _, _ in removal_spans(t, _hits(bits, len(words(t)))):
                    parts.append(t[at:a])
                    at = e
                column[k] = (b"".join(parts) + t[at:]).decode()
        return with_texts(b, names, text_col, length_col, column)

    return _searched(docs, _blocks(benchmark, item_col, item_text_col, block_bytes), width, text_col, shard_rows, finish, docs.schema)
