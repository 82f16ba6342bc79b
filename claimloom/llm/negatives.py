"""Hard negatives by slots of scores (operator 12)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.common import cut, give_back, lookup

NONE = np.iinfo(np.int64).min + 1
#: Anchors and rows of one block of scores.
ANCHORS, ROWS = 256, 8192


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows: in floats where their sums are exact, else in 64-bit integers."""
    if not left.size or not right.size:
        return np.zeros((len(left), len(right)), np.int64)
    most = left.shape[1] * int(np.abs(left).max()) * int(np.abs(right).max())
    if most >= 1 << 62:
        raise OverflowError("inner products of these vectors do not fit 64 bits")
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    return (left.astype(kind) @ right.astype(kind).T).astype(np.int64)


def first(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each line of ``scores`` the first ``k`` allowed places: higher scores come first, then smaller places. NONE and -1
    where there are fewer."""
    width = scores.shape[1]
    ranked = scores if np.abs(scores).max(initial=0) < 1 << 40 else np.unique(scores, return_inverse=True)[1].reshape(scores.shape)
    order = np.where(allowed, ranked * width + (width - 1 - np.arange(width)), NONE)
    at = np.argpartition(order, width - k, axis=1)[:, width - k :] if width > k else np.tile(np.arange(width), (len(scores), 1))
    ok = np.take_along_axis(allowed, at, 1)
    return np.where(ok, np.take_along_axis(scores, at, 1), NONE), np.where(ok, at, -1)


def merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` of two such selections with places of the same table."""
    score, at = np.concatenate([a[0], b[0]], axis=1), np.concatenate([a[1], b[1]], axis=1)
    order = np.lexsort((at, -score), axis=1)[:, :k]
    return np.take_along_axis(score, order, 1), np.take_along_axis(at, order, 1)


class Tile:
    """Rows of a tile, in order of (id, row)."""

    def __init__(self, batches: list[pa.RecordBatch], dim: int):
        table = pa.Table.from_batches(batches)
        self.row, self.id, self.label = (table.column(c).to_numpy() for c in ("row", "id", "label"))
        self.v = matrix(table.column("v").combine_chunks(), dim)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def best_positives(tile: Tile, row: np.ndarray, label: np.ndarray, v: np.ndarray, asked: list, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The first ``k`` other rows of each anchor's label."""
    best = (np.full((len(row), 0), NONE), np.full((len(row), 0), -1))
    for at in range(0, len(tile.row), ROWS):
        part = slice(at, at + ROWS)
        score, place = first(products(v, tile.v[part]), (tile.label[part] == label[:, None]) & (tile.row[part] != row[:, None]), k)
        best = merged(best, (score, np.where(place < 0, -1, place + at)), k)
    return [best]


def best_negatives(tile: Tile, row: np.ndarray, label: np.ndarray, v: np.ndarray, asked: list, k: int, high: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Slot by slot the first ``k`` rows of other labels: slot s holds scores up to the limit of positive s and above that of
    the next, and the last one all scores up to its limit. Scores above all limits serve no positive."""
    slots = max(map(len, asked), default=0)
    limits = np.full((len(row), slots + 1), NONE)
    for n, scores in enumerate(asked):
        limits[n, : len(scores)] = [high * s // 100 for s in scores]
    best = [(np.full((len(row), 0), NONE), np.full((len(row), 0), -1)) for _ in range(slots)]
    for at in range(0, len(tile.row), ROWS):
        part = slice(at, at + ROWS)
        scores, other = products(v, tile.v[part]), tile.label[part] != label[:, None]
        for s in range(slots):
            score, place = first(scores, other & (scores <= limits[:, s, None]) & (scores > limits[:, s + 1, None]), k)
            best[s] = merged(best[s], (score, np.where(place < 0, -1, place + at)), k)
    return best


def _met(placed: DataFrame, asking: DataFrame, choose: Callable) -> DataFrame:
    """(anchor, slot, score, id, row): what ``choose`` selects for each anchor in each tile of its dimension.

    Tiles are dealt out and sorted, rows before anchors, so that a task holds one tile and lets the anchors stream by.
    """
    names = ["dim", "tile", "asks", "row", "id", "label", "v", "asked"]
    rows = placed.withColumns({"asks": F.lit(False), "asked": F.lit(None).cast("array<long>")})
    anchors = asking.withColumns({"asks": F.lit(True), "tile": F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))})
    dealt = rows.select(names).unionAll(anchors.select(names)).repartition("dim", "tile").sortWithinPartitions("dim", "tile", "asks", "id", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, waiting, tile = None, [], None
        for batch in batches:
            dim, number, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "tile", "asks"))
            breaks = np.flatnonzero((np.diff(dim) != 0) | (np.diff(number) != 0) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *breaks], [*breaks, batch.num_rows]):
                if a == b:
                    continue
                if (dim[a], number[a]) != of:
                    of, waiting, tile = (dim[a], number[a]), [], None
                if not asks[a]:
                    waiting.append(batch.slice(a, b - a))
                    continue
                if tile is None and waiting:
                    tile, waiting = Tile(waiting, int(dim[a])), []
                for at in range(a, b if tile else a, ANCHORS):
                    part = batch.slice(at, min(ANCHORS, b - at))
                    row, label = part.column("row").to_numpy(), part.column("label").to_numpy()
                    found = choose(tile, row, label, matrix(part.column("v"), int(dim[a])), [x or [] for x in part.column("asked").to_pylist()])
                    for slot, (score, place) in enumerate(found):
                        i, j = np.nonzero(place >= 0)
                        p = place[i, j]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(row[i]), pa.array(np.full(len(i), slot, np.int32)), pa.array(score[i, j]), pa.array(tile.id[p]), pa.array(tile.row[p])], ["anchor", "slot", "score", "id", "row"]
                        )
        give_back()

    return dealt.mapInArrow(run, "anchor long, slot int, score long, id long, row long")


def hard_negatives(
    vectors: DataFrame,
    *,
    anchors: Column,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
    tile_rows: int = 1 << 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(scale * x), scores are their integer inner products; higher ones come first, ties by smaller id.
    An anchor (a row where ``anchors`` holds) has the first ``positives`` other rows of its label as positives. For each of them the
    first ``negatives`` rows of other labels with low% of the positive's score <= score <= high% of it are returned.

    Every anchor meets every row, tile by tile, in two passes: one for positives, one for negatives. The positives' upper limits
    split scores into slots that don't overlap; tiles and then the shuffle's combiners keep the first rows of each slot,
    and a positive's window is the merge of its slot with those below, cut at its lower limit. A task holds one tile
    (``tile_rows`` at most, fewer where there would be fewer tiles than partitions) and sends ``negatives`` rows a slot.

    Rows with a null id, label or vector, or a null or non-finite component take no part. Each row counts, also where an id is
    repeated: it is another row to its like. Vectors meet those of their size only. Labels are integers. Products that do not fit
    64 bits are an error. An empty table gives an empty one.
    """
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    ok = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False))
    codes = F.transform(v, lambda x: F.floor(x.cast("double") * scale))
    rows = vectors.where(ok).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), codes.alias("v"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    rows = cut(rows.withColumns({"dim": F.size("v"), "row": F.monotonically_increasing_id()}), "codes")
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = min(tile_rows, max(512, rows.count() // (2 * partitions)))
    tiles = rows.groupBy("dim").agg(F.ceil(F.count("*") / size).cast("int").alias("tiles"))
    placed = cut(lookup(rows, tiles, "dim", "inner").withColumn("tile", F.pmod(F.xxhash64("row"), F.col("tiles")).cast("int")), "tiles")
    asking = placed.where("asks").drop("asks", "tile")

    order = [F.desc("score"), "id", "row"]
    found = _met(placed, asking.withColumn("asked", F.lit(None).cast("array<long>")), lambda *x: best_positives(*x, positives))
    found = found.withColumn("n", F.row_number().over(Window.partitionBy("anchor").orderBy(*order))).where(F.col("n") <= positives)
    liked = cut(found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("n", "id", "score"))).alias("liked")), "positives")

    asked = asking.join(liked.select(F.col("anchor").alias("row"), F.col("liked.score").alias("asked")).hint("merge"), "row")
    found = _met(placed, asked, lambda *x: best_negatives(*x, negatives, high))
    found = found.withColumn("n", F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(*order))).where(F.col("n") <= negatives)
    below = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("slot", "n", "id", "score"))).alias("below"))

    # slots come in descending order of scores, so those from a positive's own slot on are sorted already
    pairs = below.join(liked.hint("merge"), "anchor").join(asking.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")).hint("merge"), "anchor")
    pairs = pairs.select("anchor_id", "below", F.explode("liked").alias("p"))
    window = F.slice(F.filter("below", lambda c: c["slot"] >= F.col("p.n") - 1), 1, negatives)
    window = F.filter(window, lambda c: c["score"].cast("decimal(20,0)") * 100 >= F.col("p.score").cast("decimal(20,0)") * low)
    pairs = pairs.select("anchor_id", "p", F.posexplode(window).alias("k", "c"))
    return pairs.select(
        "anchor_id", F.col("p.id").alias("positive_id"), (F.col("k") + 1).cast("int").alias("rank"), F.col("c.id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("c.score").alias("negative_score")
    )
