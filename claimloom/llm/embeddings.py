"""Near-duplicate vectors by int8 tile products with error bounds (operator 7)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

from claimloom.llm.common import components, cut, join_counted, lookup


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes (as float32, for exact products of small integers), scales, norms of the decoded vectors and of the errors."""
    scale = np.abs(unit).max(1) / 127
    code = np.rint(unit / scale[:, None])
    decoded = code * scale[:, None]
    return code.astype(np.float32), scale, np.linalg.norm(decoded, axis=1), np.linalg.norm(unit - decoded, axis=1)


Coded = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def may_reach(left: Coded, other: Coded, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose cosine may be >= threshold, by codes alone; all others are below it for certain.

    With u = u' + e: |u.v - u'.v'| <= |u'||f| + |e||v'| + |e||f|.
    """
    (cl, sl, hl, el), (co, so, ho, eo) = left, other
    exact = np.float32 if cl.shape[1] * 127 * 127 < 1 << 24 else np.float64  # beyond, float32 would not add the codes exactly
    upper = (cl.astype(exact) @ co.astype(exact).T).astype(np.float64)
    upper *= sl[:, None] * so[None]
    upper += hl[:, None] * eo[None] + el[:, None] * (ho + eo)[None] + 1e-9
    return np.nonzero(upper >= threshold)


def sure_pairs(left: np.ndarray, other: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs have cosine >= threshold in double precision."""
    norm_l, norm_o = np.linalg.norm(left, axis=1), np.linalg.norm(other, axis=1)
    sure = np.zeros(len(i), bool)
    for k in range(0, len(i), 1 << 16):
        a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
        sure[k : k + (1 << 16)] = np.einsum("nd,nd->n", left[a], other[b]) / (norm_l[a] * norm_o[b]) >= threshold
    return sure


def tile_pairs(left: np.ndarray, right: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with cosine >= threshold, within ``left`` (i < j) or between two tiles."""
    coded = [quantised(x / np.linalg.norm(x, axis=1)[:, None]) for x in ([left] if right is None else [left, right])]
    i, j = may_reach(coded[0], coded[-1], threshold)
    if right is None:
        i, j = i[i < j], j[i < j]
    sure = sure_pairs(left, left if right is None else right, i, j, threshold)
    return i[sure], j[sure]


def joined_places(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """A place for each of ``n`` places that is the same for all that the pairs connect."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        for at in (root[i], root[j], i, j):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def tiles_of(table: pa.Table, tile: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of tiles (places in the table) of the block pair a, b that the table holds: all of a with all of b, each once."""
    block = table.column("block").to_numpy()
    a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
    cut_up = lambda own: [own[k : k + tile] for k in range(0, len(own), tile)]
    left = cut_up(np.flatnonzero(block == a))
    if a == b:
        return [(x, y) for k, x in enumerate(left) for y in left[k:]]
    return [(x, y) for y in cut_up(np.flatnonzero(block == b)) for x in left]


def codes_of(table: pa.Table) -> Coded:
    flat = np.frombuffer(b"".join(table.column("code").to_pylist()), np.int8)
    return flat.reshape(table.num_rows, -1), *(table.column(c).to_numpy() for c in ("scale", "size", "error"))


def _taken(coded: Coded, places: np.ndarray) -> Coded:
    return tuple(x[places] for x in coded)


def near_vectors(vectors: DataFrame, *, threshold: float = 0.98, tile: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) for every row: links are pairs of equal label with cosine >= ``threshold``.

    Equal vectors of a label become one representative with a count, so no group of copies is expanded. Each is quantised once.
    Representatives of a label fall into blocks, and blocks into tiles of ``tile`` rows; a pair of blocks is one group. First
    only codes and error bounds are dealt to the pairs, which name the vectors that may have a link there; then these
    are dealt with their full vectors, and pairs that may reach the threshold are computed in double precision. A group sends back a number
    of links and a root for each vector, never pairs. A block has at most 32 tiles and 16 MB of full vectors; labels of
    many vectors have as many blocks as give each task of a shuffle a pair. So n vectors of a label make n / block copies of each code, and
    the work grows with the square of the distinct vectors of a label, which is exact and spread evenly over tasks.
    Vectors that are null, zero, or hold null or non-finite components, and rows with a null label or id, link with nothing and are kept; vectors of
    different sizes do not compare. Each row counts as a vector, also where an id is repeated; an empty table gives an empty one.
    """
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    ok = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector_col, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.when(ok, F.col(vector_col).cast("array<double>")).alias("v"))
    rows = rows.withColumns({"h1": F.when(F.col("v").isNotNull(), F.xxhash64("v")), "h2": F.when(F.col("v").isNotNull(), F.hash("v"))})
    key = ["label", "h1", "h2"]
    reps = rows.where("v is not null").groupBy(*key).agg(F.min("id").cast("long").alias("rep"), F.count("*").alias("times"), F.first("v").alias("v")).withColumn("dim", F.size("v"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                own = batch.filter(pa.array(dims == dim))
                x = np.asarray(own.column("v").flatten()).reshape(own.num_rows, dim)
                code, scale, size, error = quantised(x / np.linalg.norm(x, axis=1)[:, None])
                new = {"code": pa.array([c.tobytes() for c in code.astype(np.int8)], pa.binary()), "scale": pa.array(scale), "size": pa.array(size), "error": pa.array(error)}
                yield pa.RecordBatch.from_arrays([*own.columns, *new.values()], names=[*own.schema.names, *new])

    coded_schema = StructType([*reps.schema.fields, StructField("code", BinaryType()), *(StructField(c, DoubleType()) for c in ("scale", "size", "error"))])
    coded = cut(reps.mapInArrow(encode, coded_schema), "vectors")
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n, rows_a_block = F.col("n"), F.least(F.lit(32 * tile), F.greatest(F.lit(tile), F.floor(F.lit(16 << 20) / (8 * F.col("dim")))))
    blocks = F.greatest(F.ceil(n / rows_a_block), F.least(F.ceil(n / tile), F.lit(math.ceil(math.sqrt(2 * tasks)))))
    blocks = coded.groupBy("label", "dim").agg(F.count("*").alias("n")).select("label", "dim", blocks.cast("int").alias("blocks"))
    placed = lookup(coded, blocks, ["label", "dim"], "inner").withColumn("block", F.pmod(F.xxhash64(*key), F.col("blocks")).cast("int"))
    pair = ["label", "dim", "a", "b"]
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("label", "dim", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "h1", "h2", "block", "code", "scale", "size", "error")

    def find(table: pa.Table) -> pa.Table:
        coded, found = codes_of(table), np.zeros(table.num_rows, bool)
        for x, y in tiles_of(table, tile):
            i, j = may_reach(_taken(coded, x), _taken(coded, y), threshold)
            apart = x[i] != y[j]
            found[x[i[apart]]] = found[y[j[apart]]] = True
        return table.select([*pair, "h1", "h2", "block"]).filter(pa.array(found))

    possible = cut(dealt.groupBy(*pair).applyInArrow(find, dealt.select(*pair, "h1", "h2", "block").schema), "possible")
    whole = possible.join(coded.drop("dim").hint("merge"), key)

    def settle(table: pa.Table) -> pa.Table:
        coded, times, ids = codes_of(table), table.column("times").to_numpy(), table.column("rep").to_numpy()
        matrix = np.asarray(table.column("v").combine_chunks().flatten()).reshape(table.num_rows, -1)
        links, edges = np.zeros(len(ids), np.int64), [np.zeros((2, 0), np.int64)]
        for x, y in tiles_of(table, tile):
            i, j = may_reach(_taken(coded, x), _taken(coded, y), threshold)
            if x is y:
                i, j = i[i < j], j[i < j]
            sure = sure_pairs(matrix[x], matrix[y], i, j, threshold)
            i, j = x[i[sure]], y[j[sure]]
            np.add.at(links, i, times[j])
            np.add.at(links, j, times[i])
            near, at = np.unique(np.concatenate([i, j]), return_inverse=True)
            root = joined_places(len(near), at[: len(i)], at[len(i) :])
            edges.append(np.stack([near, near[root]]))
        i, j = np.concatenate(edges, axis=1)
        place = joined_places(len(ids), i, j)
        low = ids.copy()
        np.minimum.at(low, place, ids)
        own = table.select([*key, "rep"]).append_column("links", pa.array(links)).append_column("root", pa.array(low[place]))
        return own.filter(pa.array(links > 0))

    settled = StructType([*whole.select(*key, "rep").schema.fields, StructField("links", LongType()), StructField("root", LongType())])
    found = cut(whole.groupBy(*pair).applyInArrow(settle, settled), "links")
    links = found.groupBy(*key).agg(F.sum("links").alias("links"))
    groups = components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    known = coded.select(*key, "rep", "times").join(links.hint("merge"), key, "left").join(groups.hint("merge"), "rep", "left")
    known = known.select(*key, "times", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    known = cut(known, "known")
    keyed = cut(rows.drop("v"), "keyed")
    joined = join_counted(keyed.where("h1 is not null"), known.withColumn("_n", F.col("times")), key, keyed.count()).select("id", "n_links", "component_id")
    alone = keyed.where("h1 is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return joined.unionAll(alone).select(F.col("id").alias(id_col), F.col("n_links").cast("long"), F.col("component_id").cast("long"), F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
