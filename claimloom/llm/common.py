"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.sources.scratch import cut as cut
from claimloom.sources.spread import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


def raw_bytes(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """A string column as UTF-8 bytes; null becomes empty."""
    col = batch.column(column)
    if not pa.types.is_binary(col.type):
        col = col.cast(pa.binary())
    return [x or b"" for x in col.to_pylist()]


def strings(batch: pa.RecordBatch, column: str) -> list[str]:
    """A string column; null becomes empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Small slices, so that the Python copies of texts stay bounded: at most ``rows`` rows, and at most ``size`` bytes of
    text unless a single row has more. After the last, memory goes back to the system, since workers live on."""
    for batch in batches:
        ends = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                ends += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(ends)
        start = 0
        while start < batch.num_rows:
            limit = (ends[start - 1] if start else 0) + size
            stop = max(start + 1, min(start + rows, int(np.searchsorted(ends, limit, side="right"))))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def give_back() -> None:
    """Return what this worker has freed to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: A-Z to a-z; everything that isn't a word byte to a space. Non-ASCII characters are word characters.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return text.translate(WORD_BYTES).split()


#: A key of more rows than this, and than one in MOST_HOT of all, is hot; so at most MOST_HOT keys are.
LEAST_HOT, MOST_HOT = 500, 100_000


def join_counted(rows: DataFrame, known: DataFrame, on: list[str], total: int) -> DataFrame:
    """Inner join of ``rows`` with a table of unique keys and ``_n``, the number of rows that each has.

    Rows of hot keys stay where they are and meet a broadcast of those keys (at most MOST_HOT, whatever the size of the
    input); the rest is dealt by key. Both tables should be written ones, since each is read twice where a key is hot.
    """
    hot = known.where(F.col("_n") > max(LEAST_HOT, total // MOST_HOT)).drop("_n")
    known = known.drop("_n")
    if hot.isEmpty():
        return rows.join(known.hint("merge"), on)
    cold = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(known.hint("merge"), on)
    return rows.join(F.broadcast(hot), on).select(cold.columns).unionAll(cold)


def _pulled(edges: DataFrame, around: DataFrame, total: int) -> DataFrame:
    """(u, n, m) for ``edges`` (u, n): m is the smallest of u and its neighbours in ``around`` (u, v)."""
    low = around.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("_n"))
    if total <= LEAST_HOT:
        return edges.join(low.drop("_n").hint("merge"), "u")
    return join_counted(edges, cut(low, "low"), ["u"], total)


def components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b), component being the smallest node reachable.

    Alternates large-star and small-star steps. Minima are taken by a partial aggregation. In each step the edges meet one
    row per node; nodes with very many edges, which the centres of large families become, are met by a broadcast instead of
    in one task. Every round is written to the shared folder. Ends when a round changes nothing. Edges with a null end
    are left out.
    """
    cur = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    nodes = cur.select(F.col("u").alias("node")).union(cur.select("v")).distinct()

    def signature(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003), F.sum(F.xxhash64("v", "u") % 998244353)).first()

    before = signature(cur)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        # large star: every larger neighbour of a node moves to the node's minimum
        both = cur.union(cur.select("v", "u"))
        large = _pulled(cur.select(F.col("v").alias("u"), F.col("u").alias("n")), both, before[0]).select(F.col("n").alias("u"), F.col("m").alias("v")).where("u <> v")
        # small star: a node and its smaller neighbours move to the smallest of them
        large = cut(large.distinct(), "cc")
        small = _pulled(large.select("u", F.col("v").alias("n")), large, before[0])
        small = small.select(F.col("n").alias("u"), F.col("m").alias("v")).where("u <> v").union(large.groupBy("u").agg(F.min("v").alias("v")))
        cur = cut(small.distinct(), "cc")
        now = signature(cur)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    roots = cur.groupBy("u").agg(F.min("v").alias("m"))
    return nodes.join(roots.hint("merge"), nodes.node == roots.u, "left").select("node", F.coalesce("m", "node").alias("component"))


def lookup(df: DataFrame, small: DataFrame, on: str | list[str], how: str = "left", *, most: int = 200_000) -> DataFrame:
    """Join with a table that is usually small: broadcast if it is counted to have at most ``most`` rows, else sort-merge."""
    return df.join(F.broadcast(small) if small.limit(most + 1).count() <= most else small.hint("merge"), on, how)


def with_texts(batch: pa.RecordBatch, names: list[str], text_col: str, length_col: str | None, texts: list[str | None]) -> pa.RecordBatch:
    """``batch`` with new texts, and new lengths where a text changes."""
    if length_col in names:
        old, field = batch.column(text_col).to_pylist(), batch.schema.field(length_col)
        lengths = [n if a == b else len(b) for n, a, b in zip(batch.column(length_col).to_pylist(), old, texts)]
        batch = batch.set_column(names.index(length_col), field, pa.array(lengths, field.type))
    field = batch.schema.field(text_col)
    return batch.set_column(names.index(text_col), field, pa.array(texts, field.type))
