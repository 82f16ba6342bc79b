"""Exact vector search that reads only the clusters which can hold an answer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.sources.scratch import cut, hinted

#: Vectors that centres are fitted on, centres at most (both reach the driver), and rows of a piece of a cluster.
SAMPLE, MOST_CENTRES, PIECE = 32_768, 1024, 16_384
#: Cells of a block of scores.
CELLS = 1 << 21


def usable(v: Column) -> Column:
    """Whether a vector has a direction: not null, no null or non-finite component, not all zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


def rows_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1)[:, None]


def fitted(sample: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """``n`` unit centres by k-means on directions, from evenly taken rows."""
    centres = sample[np.linspace(0, len(sample) - 1, n).astype(int)].copy()
    for _ in range(rounds):
        own = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        norm = np.linalg.norm(sums, axis=1)
        centres[norm > 0] = sums[norm > 0] / norm[norm > 0, None]
    return centres


def rounded(scores: np.ndarray) -> np.ndarray:
    return np.floor(scores * 1e6 + 0.5) / 1e6


@dataclass(frozen=True)
class Clusters:
    """``rows`` (cluster, piece, id, v), written; ``sizes`` (cluster, n, radius, pieces); centres of each vector size, for tasks."""

    rows: DataFrame
    sizes: DataFrame
    centres: Broadcast

    @staticmethod
    def of(vectors: DataFrame, *, id_col: str, vector_col: str = "embedding") -> Clusters:
        """Every usable vector with its nearest centre; vectors of other sizes have clusters of their own.

        Centres are fitted on at most SAMPLE rows, those of the smallest hashes; which they are decides how much a search reads,
        not what it finds. A cluster's radius is the largest distance of a member. Large clusters are cut into pieces.
        """
        spark = vectors.sparkSession
        v = F.col(vector_col)
        source = cut(vectors.where(usable(v)).select(F.col(id_col).alias("id"), v.cast("array<double>").alias("v"), F.size(v).alias("dim")), "vectors")
        total = source.count()
        sample = source.orderBy(F.xxhash64("v"), "id").limit(SAMPLE).select("dim", "v").toArrow()
        n = int(min(MOST_CENTRES, max(1, round(total**0.5))))
        known, first = {}, 0
        for dim in sorted(set(sample.column("dim").to_pylist())):
            own = unit(rows_of(sample.filter(pa.compute.equal(sample.column("dim"), dim)).column("v").combine_chunks()))
            known[dim] = (first, fitted(own, min(n, len(own))))
            first += len(known[dim][1])
        centres = spark.sparkContext.broadcast(known)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                dims = b.column("dim").to_numpy()
                for dim in np.unique(dims):
                    part = b.filter(pa.array(dims == dim))
                    # a size that the sample lacks is one cluster, so far from everything that it is always read
                    at, middle = centres.value.get(int(dim), (-1 - int(dim), np.zeros((1, int(dim)))))
                    close = unit(rows_of(part.column("v"))) @ middle.T
                    best = close.argmax(1)
                    gap = np.sqrt(np.maximum(0, 2 - 2 * close[np.arange(len(best)), best]))
                    yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), pa.array(best + at), pa.array(gap)], ["id", "v", "cluster", "gap"])

        kind = dict(source.dtypes)["id"]
        rows = cut(source.mapInArrow(assign, f"id {kind}, v array<double>, cluster long, gap double"), "assigned")
        sizes = cut(rows.groupBy("cluster").agg(F.count("*").alias("n"), F.max("gap").alias("radius")).withColumn("pieces", F.ceil(F.col("n") / PIECE).cast("int")), "clusters")
        placed = rows.join(hinted(sizes.select("cluster", "pieces")), "cluster").withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
        return Clusters(cut(placed.select("cluster", "piece", "id", "v"), "pieces"), sizes, centres)

    def bounds(self, queries: DataFrame) -> DataFrame:
        """(q, cluster, n, pieces, nearest): for each query (q, v) and cluster of its size the least distance that a member can have."""
        centres = self.centres

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for b in (whole.slice(at, 256) for at in range(0, whole.num_rows, 256)):
                    for q, v in zip(b.column("q"), b.column("v")):
                        vector = np.array(v.as_py(), np.float64)
                        at, middle = centres.value.get(len(vector), (-1 - len(vector), np.zeros((1, len(vector)))))
                        away = np.sqrt(np.maximum(0, 2 - 2 * (middle @ (vector / np.linalg.norm(vector)))))
                        if at < 0:
                            away[:] = 0
                        yield pa.RecordBatch.from_arrays([pa.array([q.as_py()] * len(away), b.schema.field("q").type), pa.array(np.arange(len(away)) + at), pa.array(away)], ["q", "cluster", "away"])

        kind = dict(queries.dtypes)["q"]
        met = queries.mapInArrow(measure, f"q {kind}, cluster long, away double").join(F.broadcast(self.sizes), "cluster")
        return met.select("q", "cluster", "n", "pieces", F.greatest(F.lit(0.0), F.col("away") - F.col("radius") - 1e-6).alias("nearest"), "away")

    def compared(self, queries: DataFrame, visits: DataFrame, k: int) -> DataFrame:
        """(q, id, score): the first ``k`` of each piece that a query visits (q, cluster, pieces).

        Pieces are dealt out and sorted, rows before queries, so that a task holds one piece while the queries stream by.
        """
        asking = visits.join(hinted(queries), "q").select("cluster", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), "q", "v")
        visited = cut(asking, "visits")
        rows = self.rows.join(hinted(visited.select("cluster", "piece").distinct()), ["cluster", "piece"], "left_semi")
        ids, qs = dict(self.rows.dtypes)["id"], dict(queries.dtypes)["q"]
        both = rows.select("cluster", "piece", F.lit(False).alias("asks"), "id", F.lit(None).cast(qs).alias("q"), "v")
        both = both.unionAll(visited.select("cluster", "piece", F.lit(True).alias("asks"), F.lit(None).cast(ids).alias("id"), "q", "v"))
        dealt = both.repartition("cluster", "piece").sortWithinPartitions("cluster", "piece", "asks", "id", "q")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of, held, own = None, [], None
            for batch in batches:
                cluster, piece, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "piece", "asks"))
                breaks = np.flatnonzero((np.diff(cluster) != 0) | (np.diff(piece) != 0) | (asks[1:] != asks[:-1])) + 1
                for a, z in zip([0, *breaks], [*breaks, batch.num_rows]):
                    if a == z:
                        continue
                    if (cluster[a], piece[a]) != of:
                        of, held, own = (cluster[a], piece[a]), [], None
                    if not asks[a]:
                        held.append(batch.slice(a, z - a))
                        continue
                    if own is None:
                        own = pa.Table.from_batches(held)
                        matrix, held = unit(rows_of(own.column("v").combine_chunks())), []
                    step = max(1, CELLS // len(matrix))
                    for at in range(a, z, step):
                        part = batch.slice(at, min(step, z - at))
                        scores = rounded(unit(rows_of(part.column("v"))) @ matrix.T)
                        # rows are in order of id, so a stable sort settles equal scores
                        best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                        i = np.repeat(np.arange(len(best)), best.shape[1])
                        yield pa.RecordBatch.from_arrays(
                            [part.column("q").take(pa.array(i)), own.column("id").combine_chunks().take(pa.array(best.ravel())), pa.array(np.take_along_axis(scores, best, 1).ravel()), pa.array(np.full(len(i), len(matrix)))], ["q", "id", "score", "against"]
                        )

        return dealt.mapInArrow(run, f"q {qs}, id {ids}, score double, against long")

    def search(self, queries: DataFrame, *, k: int, query_id: str, vector_col: str = "embedding", visits: list | None = None) -> DataFrame:
        """(query, id, score, place): exact cosine top ``k``, rounded to six places; equal scores by id.

        First a query meets its nearest clusters, as many as hold ``k`` vectors; its k-th best there is a score to beat. Of the others it
        meets only those whose nearest point, by the triangle inequality, can. ``visits`` gets both tables of visits.
        """
        asked = queries.where(usable(F.col(vector_col))).select(F.col(query_id).alias("q"), F.col(vector_col).cast("array<double>").alias("v"))
        asked = cut(asked, "queries")
        near = cut(self.bounds(asked), "near")
        before = F.sum("n").over(Window.partitionBy("q").orderBy("away", "cluster")) - F.col("n")
        first = cut(near.withColumn("before", before).where(F.col("before") < k).select("q", "cluster", "pieces", "n"), "first")
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
        found = cut(self.compared(asked, first, k), "found")
        least = found.select("q", "score", place.alias("place")).where(F.col("place") == k).select("q", (F.col("score") - 2e-6).alias("beat"))
        beats = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.coalesce("beat", F.lit(-1.0))))
        rest = near.join(first.select("q", "cluster").hint("merge"), ["q", "cluster"], "left_anti").join(hinted(least), "q", "left")
        rest = cut(rest.where(F.col("nearest") <= beats).select("q", "cluster", "pieces", "n"), "rest")
        if visits is not None:
            visits += [first, rest]
        found = found.unionAll(self.compared(asked, rest, k))
        return found.select(F.col("q").alias(query_id), "id", "score", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id")).alias("place")).where(F.col("place") <= k)
