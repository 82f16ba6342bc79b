"""Repeated lines by two Bloom filters, of hashes seen once and of hashes seen twice (operator 13)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import cut, join_counted, lookup, raw_bytes, slices

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BLANK = b" \t\n\x0b\x0c\r"

#: A filter has blocks of four 64-bit lanes, and a hash sets one bit in each lane of its block. This many bits a hash.
BITS_A_HASH = 16
#: Hashes that one group of the filters' construction gets at most, about, and hashes that a task holds before it sends them.
SEGMENT_HASHES, HELD = 1 << 21, 1 << 20


def line_keys(text: bytes) -> list[bytes]:
    """Of each line: A-Z lower-cased, blanks stripped at both ends."""
    return [line.strip(BLANK) for line in text.translate(LOWER).split(b"\n")]


def _chosen(text: bytes, min_chars: int) -> list[bytes]:
    """The different keys of a text that are long enough, in code points."""
    keys = set(line_keys(text))
    if min_chars <= 1:
        return [k for k in keys if len(k) >= min_chars]
    return [k for k in keys if len(k) >= min_chars and len(k.decode("utf-8", "replace")) >= min_chars]


def hashes(keys: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


class Bloom:
    """A Bloom filter of ``blocks`` (a power of two) blocks of four lanes."""

    def __init__(self, blocks: int):
        self.lanes = np.zeros((4, blocks), np.uint64)
        self.mask = np.uint64(blocks - 1)

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        bits = [np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63)) for k in range(4)]
        return ((h >> np.uint64(24)) & self.mask).astype(np.int64), bits

    def has(self, h: np.ndarray) -> np.ndarray:
        block, bits = self._places(h)
        return np.logical_and.reduce([self.lanes[k][block] & bits[k] != 0 for k in range(4)])

    def add(self, h: np.ndarray) -> None:
        block, bits = self._places(h)
        for k in range(4):
            np.bitwise_or.at(self.lanes[k], block, bits[k])


def seen_twice(docs: DataFrame, *, text_col: str = "text", min_chars: int = 1, segment_hashes: int = SEGMENT_HASHES) -> tuple[DataFrame, int, int]:
    """(block, b0, b1, b2, b3): the filter of hashes that two rows have, and how many bits name a segment and a block in it.

    Only 64-bit hashes are shuffled, each once for every HELD that a task gathers, so a frequent line is no hot key. Hashes
    are dealt into segments by their first bits, as many as the count of lines asks for. A segment passes its hashes
    through a filter of those seen once; what is in there already, or was seen twice by one task, goes to the filter of those
    seen twice. Bits are only ever set, so no repeated line is missed; a false one is found out later.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.agg(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)).first()[0] or 1
    segment_bits = min(22, max(6, (lines // segment_hashes).bit_length()))
    block_bits = min(17, max(3, ((lines >> segment_bits) * BITS_A_HASH // 256).bit_length()))
    twice_bits = block_bits - 3

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def packed() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            segment = (values >> np.uint64(64 - segment_bits)).astype(np.int32)
            names, starts = np.unique(segment, return_index=True)
            ends = [*starts[1:], len(values)]
            every = [values[a:b].tobytes() for a, b in zip(starts, ends)]
            again = [values[a:b][counts[a:b] > 1].tobytes() for a, b in zip(starts, ends)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array(every, pa.binary()), pa.array(again, pa.binary())], ["segment", "every", "again"])

        for b in slices(batches):
            held.extend(hashes(_chosen(t, min_chars)) for t in raw_bytes(b, "text"))
            if sum(map(len, held)) >= HELD:
                yield packed()
        if sum(map(len, held)):
            yield packed()

    def build(table: pa.Table) -> pa.Table:
        once, twice = Bloom(1 << block_bits), Bloom(1 << twice_bits)
        for every, again in zip(table.column("every"), table.column("again")):
            h = np.frombuffer(every.as_py(), np.uint64)
            twice.add(h[once.has(h)])
            twice.add(np.frombuffer(again.as_py(), np.uint64))
            once.add(h)
        used = np.flatnonzero(twice.lanes.any(axis=0))
        block = (table.column("segment")[0].as_py() << twice_bits) + used
        return pa.table({"block": block} | {f"b{k}": twice.lanes[k][used].view(np.int64) for k in range(4)})

    sent = docs.select(text.alias("text")).mapInArrow(gather, "segment int, every binary, again binary")
    blocks = sent.groupBy("segment").applyInArrow(build, "block long, b0 long, b1 long, b2 long, b3 long")
    return cut(blocks, "twice"), segment_bits, twice_bits


def without_repeated(
    docs: DataFrame, *, min_documents: int = 2, min_chars: int = 1, keep: str = "first", id_col: str = "doc_id", text_col: str = "text", most_blocks: int = 500_000
) -> DataFrame:
    """(id, n_lines, n_dropped, text): every row without its repeated lines.

    A line's key is the line without blanks at its ends, A-Z lower-cased; keys of at least ``min_chars`` code points in at
    least ``min_documents`` rows (2 or more) are repeated. ``keep="first"`` keeps the first line of a key in the row with the smallest
    (id, hashes of id and text); ``keep="none"`` drops all lines of the key. Null and empty texts are one empty line. Each row counts as a
    document, also where an id is repeated or null; rows equal in id and text get equal results. Empty tables give empty ones.

    The filter of ``seen_twice`` meets the lines where they are read: it is broadcast up to ``most_blocks`` blocks of 40 bytes
    and dealt by block beyond. Only lines in it are shuffled, as keys, and counted exactly; keys of very many rows meet
    their counts by a broadcast. Then each text meets the keys it loses.
    """
    if min_documents < 2 or keep not in ("first", "none"):
        raise ValueError("min_documents must be 2 or more, keep 'first' or 'none'")
    blocks, segment_bits, twice_bits = seen_twice(docs, text_col=text_col, min_chars=min_chars)
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    source = source.withColumns({"r1": F.xxhash64("id", "text"), "r2": F.xxhash64("text", F.lit(1), "id")})
    id_type = dict(source.dtypes)["id"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            chosen = [_chosen(t, min_chars) for t in raw_bytes(b, "text")]
            row = pa.array(np.repeat(np.arange(b.num_rows), [len(c) for c in chosen]))
            keys = [k for c in chosen for k in c]
            h = hashes(keys)
            block = ((h >> np.uint64(64 - segment_bits)) << np.uint64(twice_bits)) + ((h >> np.uint64(24)) & np.uint64((1 << twice_bits) - 1))
            own = [b.column(c).take(row) for c in ("id", "r1", "r2")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(h.view(np.int64)), pa.array(block.view(np.int64)), pa.array(keys, pa.binary())], ["id", "r1", "r2", "h", "block", "key"])

    lines = source.mapInArrow(emit, f"id {id_type}, r1 long, r2 long, h long, block long, key binary")
    in_it = " AND ".join(f"(b{k} & shiftleft(1L, cast(shiftrightunsigned(h, {6 * k}) & 63 AS int))) <> 0" for k in range(4))
    likely = cut(lookup(lines, blocks, "block", "inner", most=most_blocks).where(in_it).select("key", F.struct("id", "r1", "r2").alias("row")), "suspected")
    counted = likely.groupBy("key").agg(F.count("*").alias("_n"), F.min("row").alias("first")).where(F.col("_n") >= min_documents)
    lost = join_counted(likely, cut(counted, "repeated"), ["key"], likely.count())
    is_first = F.col("row").eqNullSafe(F.col("first")) if keep == "first" else F.lit(False)
    lost = lost.groupBy(F.col("row.r1").alias("r1"), F.col("row.r2").alias("r2")).agg(F.collect_set("key").alias("lost"), F.collect_set(F.when(is_first, F.col("key"))).alias("own"))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            total, dropped, texts = [], [], []
            for text, lost, own in zip(raw_bytes(b, "text"), b.column("lost").to_pylist(), b.column("own").to_pylist()):
                lines = text.split(b"\n")
                total.append(len(lines))
                if lost:
                    gone, first = set(lost), set(own)
                    kept = []
                    for line, key in zip(lines, line_keys(text)):
                        if key not in gone:
                            kept.append(line)
                        elif key in first:
                            first.remove(key)
                            kept.append(line)
                    dropped.append(len(lines) - len(kept))
                    text = b"\n".join(kept)
                else:
                    dropped.append(0)
                texts.append(text)
            arrays = [b.column("id"), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n_lines", "n_dropped", "text"])

    met = source.join(lost.hint("merge"), ["r1", "r2"], "left").select("id", "text", "lost", "own")
    result = met.mapInArrow(drop, f"id {id_type}, n_lines long, n_dropped long, text string")
    return result.select(F.col("id").alias(id_col), "n_lines", "n_dropped", F.col("text").alias(text_col))
