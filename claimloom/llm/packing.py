"""Best-fit packing by a configuration linear program over the length histogram (operator 4)."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.common import cut, slices, strings
from claimloom.llm.tokens import default_path, loaded

Config = tuple[tuple[int, int], ...]  # (length, how often), longest first


def pieces(docs: DataFrame, *, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): each document's ids and the end id, cut where longer than ``capacity``.

    Pieces of a cut document are full, but for the first. Null and empty texts give one piece, the end id alone.
    """
    path = path or default_path()
    tail = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, 1 << 18)
        for b in slices(batches):
            rows, number, start, length, crc, kept = [], [], [], [], [], []
            for row, text in enumerate(strings(b, "text")):
                ids = bpe.ids(text) + tail
                total = len(ids) // 4
                first = (total - 1) % capacity + 1
                for k, end in enumerate(range(first, total + 1, capacity)):
                    at = max(0, end - capacity) if k else 0
                    part = ids[4 * at : 4 * end]
                    rows.append(row)
                    number.append(k)
                    start.append(at)
                    length.append(end - at)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        kept.append(np.frombuffer(part, "<u4").astype(np.int32))
            columns = [b.column(0).take(pa.array(rows, pa.int32())), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {dict(source.dtypes)['id']}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def best_config(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> Counter:
    """The dearest multiset of lengths of at most ``capacity`` in all: unbounded knapsack by dynamic programming."""
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        value[c] = value[c - 1]
        if k := fits[c]:
            with_one = value[c - lengths[:k]] + prices[:k]
            j = int(with_one.argmax())
            if with_one[j] > value[c] + 1e-12:
                value[c], choice[c] = with_one[j], j
    out: Counter = Counter()
    c = capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            out[int(lengths[choice[c]])] += 1
            c -= int(lengths[choice[c]])
    return out


def solve(histogram: dict[int, int], capacity: int, **options) -> list[tuple[Config, int]]:
    """Configurations and how many sequences use each, covering the histogram exactly."""
    return optimised(histogram, capacity, **options)[0]


def optimised(histogram: dict[int, int], capacity: int, *, rounds: int = 400, share: float = 0.5, eta: float = 2.0, least: int = 16) -> tuple[list[tuple[Config, int]], float]:
    """The plan of ``solve``, and a number of sequences that no packing can do without.

    The covering program "fewest configurations that hold every length as often as it occurs" is solved by multiplicative
    weights: each length has a weight, which starts at its size and falls by a factor of exp(-eta * share covered) with
    every step that covers it; the pricing step is the knapsack over the weights, and each step covers at most ``share`` of
    what is left of any length (all of it after ``rounds`` steps, so that at most as many steps as there are lengths
    follow). Lengths of which fewer than ``least`` are left drop out. Fractions are rounded down; what is left then (a
    number bounded by the capacity and the configurations, not by the input) is packed by best fit decreasing.

    Each step's prices are a feasible point of the dual program once divided by the value of the best configuration, so
    their total over all pieces is a lower bound; the largest of the steps is returned.
    """
    need = {int(k): int(v) for k, v in histogram.items() if v}
    if not need:
        return [], 0.0
    lengths = np.array(sorted(need))
    total = np.array([need[k] for k in lengths], float)
    left, weight = total.copy(), lengths / capacity
    index = {int(k): i for i, k in enumerate(lengths)}
    used: Counter = Counter()
    steps, bound = 0, float(lengths @ total) / capacity
    while (live := left >= least).any() and steps < rounds + 2 * len(lengths):
        prices = weight[live] / weight[live].max()
        config = best_config(lengths[live], prices, capacity)
        # lengths that dropped out have no price here, which is feasible too
        worth = sum(n * weight[index[k]] for k, n in config.items()) / weight[live].max()
        bound = max(bound, float(prices @ total[live]) / (worth * (1 + 1e-9)))
        limit = min(left[index[k]] / n for k, n in config.items())
        x = limit if steps >= rounds else limit * share
        for k, n in config.items():
            i = index[k]
            left[i] = max(0.0, left[i] - n * x)
            weight[i] *= np.exp(-eta * n * x / total[i])
        used[tuple(sorted(config.items(), reverse=True))] += x
        steps += 1
    plan: Counter = Counter()
    rest = Counter(need)
    for config, x in used.items():
        whole = min([int(x + 1e-9), *(rest[k] // n for k, n in config)])
        if whole > 0:
            plan[config] += whole
            for k, n in config:
                rest[k] -= n * whole
    open_bins: dict[int, list[list[int]]] = {}
    for k in sorted(rest, reverse=True):
        for _ in range(rest[k]):
            space = next((s for s in range(k, capacity + 1) if open_bins.get(s)), None)
            own = open_bins[space].pop() if space is not None else []
            own.append(k)
            open_bins.setdefault((capacity if space is None else space) - k, []).append(own)
    for bins in open_bins.values():
        for own in bins:
            plan[tuple(sorted(Counter(own).items(), reverse=True))] += 1
    return sorted(plan.items()), bound


def places(plan: list[tuple[Config, int]]) -> dict[str, np.ndarray]:
    """For each length, which ranks go to which sequences and offsets: one row per configuration and length."""
    rank: Counter = Counter()
    rows, base = [], 0
    for config, times in plan:
        offset = 0
        for k, n in config:
            rows.append((k, rank[k], n, base, offset))
            rank[k] += n * times
            offset += k * n
        base += times
    rows.sort()
    names = ("length", "rank", "each", "base", "offset")
    return {name: np.array([r[i] for r in rows], np.int64) for i, name in enumerate(names)}


def pack(table: DataFrame, *, capacity: int = 1024, rows_per_salt: int | None = None) -> DataFrame:
    """``table`` (pieces) with sequence_id and offset: gapless sequences of at most ``capacity`` tokens.

    Only the histogram (at most ``capacity`` rows) reaches the driver. A piece's place follows from its rank among pieces
    of its length; ranks are counted in salted groups of about ``rows_per_salt`` rows (by default half of what a shuffle
    partition gets, 500 at least) and shifted by the sizes of the groups before, so that no length, however frequent, is
    ranked in one task. An empty table gives an empty one; repeated rows get a place each.
    """
    histogram = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}
    where = places(solve(histogram, capacity))
    if rows_per_salt is None:
        partitions = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows_per_salt = max(500, sum(histogram.values()) // (2 * partitions))
    salts = {k: -(-n // rows_per_salt) for k, n in histogram.items() if n > rows_per_salt}
    many = F.coalesce(F.try_element_at(F.split(F.lit(",".join(str(salts.get(k, 1)) for k in range(1, capacity + 1))), ","), F.col("length").cast("int")).cast("int"), F.lit(1))
    salted = table.withColumn("_salt", F.pmod(F.xxhash64(table.columns[0], "piece", "ids_crc32"), many).cast("int"))
    local = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(table.columns[0], "piece", "ids_crc32")) - 1)
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")
    starts = sizes.select(F.col("length").alias("_l"), F.col("_salt").alias("_s"), before.alias("_before"))
    ranked = local.join(starts.hint("merge"), (F.col("length") == F.col("_l")) & (F.col("_salt") == F.col("_s")))
    ranked = ranked.select(*table.columns, (F.col("_rank") + F.col("_before")).alias("_rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = 1 << 44
        keys = where["length"] * shift + where["rank"]
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            at = np.searchsorted(keys, length * shift + rank, side="right") - 1
            turn = rank - where["rank"][at]
            sequence = where["base"][at] + turn // where["each"][at]
            offset = where["offset"][at] + turn % where["each"][at] * length
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence), pa.array(offset)], [*b.schema.names[:-1], "sequence_id", "offset"])

    schema = ", ".join(f"`{k}` {v}" for k, v in table.dtypes) + ", sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)


def packed(docs: DataFrame, *, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack ``docs``; the pieces are written to the shared folder once, for both passes over them."""
    table = cut(pieces(docs, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col, path=path, with_ids=with_ids), "pieces")
    return pack(table, capacity=capacity)
