"""Near-duplicate texts by consistent weighted sampling over TF-IDF shingles (operator 9)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import WORD_BYTES, components, cut, join_counted, lookup, raw_bytes, slices

_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWER = _RNG.integers(1, 1 << 63, 1024, dtype=np.uint64) | np.uint64(1)
_PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one after the other, and the number of words of each text."""
    joined = np.frombuffer(b" ".join(texts).translate(WORD_BYTES) + b" ", np.uint8)
    inside = joined != 32
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    starts = np.flatnonzero(begins)
    edges = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    counts = np.diff(np.searchsorted(starts, edges)) if len(texts) else np.zeros(0, np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    data = joined[inside]
    first = (np.cumsum(inside) - 1)[starts]
    lengths = np.diff(np.append(first, len(data)))
    place = np.arange(len(data)) - np.repeat(first, lengths)
    return mixed(np.add.reduceat(_BYTE[data] * _POWER[place & 1023], first) + lengths.astype(np.uint64)), counts


def shingles(texts: list[bytes], width: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, weight, bounds): the distinct shingles of each text, sorted, with TF-IDF weights; text k has bounds[k]:bounds[k+1].

    A shingle is ``width`` words in a row; a text of fewer words, but not none, is one shingle. Its weight is how often it
    occurs times the mean inverse document frequency of its words.
    """
    h, counts = word_hashes(texts)
    n = len(h)
    starts = np.concatenate(([0], np.cumsum(counts)))
    rarity = idf[(h & np.uint64(len(idf) - 1)).astype(np.int64)]
    sizes = np.where(counts == 0, 0, np.maximum(1, counts - width + 1))
    owner = np.repeat(np.arange(len(texts)), sizes)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = starts[owner] + offset
    span = np.minimum(width, counts[owner])
    key, weight = np.zeros(len(at), np.uint64), np.zeros(len(at))
    for k in range(width):
        use = span > k
        p = np.minimum(at + k, n - 1)
        key += np.where(use, h[p] * _PLACE[k], np.uint64(0)) if n else 0
        weight += np.where(use, rarity[p], 0.0) if n else 0
    key, weight = mixed(key), weight / np.maximum(span, 1)
    order = np.lexsort((key, owner))
    key, weight, owner = key[order], weight[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(key)))
    bounds = np.searchsorted(owner[first], np.arange(len(texts) + 1))
    return key[first], weight[first] * times, bounds


class Sampler:
    """Improved consistent weighted sampling: k samples of a weighted set; two sets agree in a sample with the probability
    of their weighted Jaccard similarity.

    The Gamma(2, 1) variables r and c and the uniform one, b, of an element come from three tables by different bits of
    its hash, so that 2^39 combinations stand for the elements.
    """

    ROWS = 8192

    def __init__(self, k: int, seed: int = 17):
        rng = np.random.Generator(np.random.PCG64(seed))
        gamma = lambda: -np.log(rng.random((self.ROWS, k)) * rng.random((self.ROWS, k)) + 1e-300)
        r = np.maximum(gamma(), 1e-3)
        self.r, self.per_r = r.astype(np.float32), (1 / r).astype(np.float32)
        self.b = rng.random((self.ROWS, k)).astype(np.float32)
        self.log_c = np.log(np.maximum(gamma(), 1e-30)).astype(np.float32)
        self.k = k

    def samples(self, key: np.ndarray, weight: np.ndarray, bounds: np.ndarray, block: int = 4096) -> np.ndarray:
        """uint32 (texts x k); texts without shingles have all ones."""
        out = np.full((len(bounds) - 1, self.k), np.iinfo(np.uint64).max, np.uint64)
        log_w = np.log(weight).astype(np.float32)
        mask = np.uint64(self.ROWS - 1)
        i1, i2, i3 = ((key >> np.uint64(s) & mask).astype(np.int64) for s in (0, 13, 26))
        low = (key >> np.uint64(32)).astype(np.uint32)
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        for at in range(0, len(key), block):
            s = slice(at, at + block)
            r, b = self.r[i1[s]], self.b[i2[s]]
            t = np.floor(log_w[s, None] * self.per_r[i1[s]] + b)
            log_a = self.log_c[i3[s]] - r * (t - b + np.float32(1))
            bits = log_a.view(np.int32)
            bits = (bits ^ ((bits >> 31) & np.int32(0x7FFFFFFF))).view(np.uint32) ^ np.uint32(1 << 31)
            name = low[s, None] + t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1)
            packed = (bits.astype(np.uint64) << np.uint64(32)) | name
            texts, first = np.unique(owner[s], return_index=True)
            out[texts] = np.minimum(out[texts], np.minimum.reduceat(packed, first, axis=0))
        return (out & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def band_keys(samples: np.ndarray, rows: int) -> np.ndarray:
    """int64 (texts x bands): a hash of each ``rows`` samples and of the band's number."""
    n, k = samples.shape
    grouped = samples.reshape(n, k // rows, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(k // rows, dtype=np.uint64) + np.uint64(1), grouped.shape[:2]) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(rows):
        key = mixed(key ^ grouped[:, :, i]) + np.uint64(i)
    return key.view(np.int64)


def inverse_frequencies(docs: DataFrame, *, buckets: int = 1 << 18) -> np.ndarray:
    """Inverse document frequency by hash bucket of words, over all rows of (id, text).

    Each task adds up its documents in one array of ``buckets`` counts; at most ``buckets`` rows reach the driver, at any
    size of input. Words that share a bucket share a count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(buckets, np.int64), 0
        for b in slices(batches, 256):
            h, counts = word_hashes(raw_bytes(b, "text"))
            own = np.repeat(np.arange(len(counts)), counts) * buckets + (h & np.uint64(buckets - 1)).astype(np.int64)
            total += np.bincount(np.unique(own) % buckets, minlength=buckets)
            n += b.num_rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], n))], ["bucket", "n"])

    counted = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    where, n = counted.column("bucket").to_numpy(), counted.column("n").to_numpy()
    frequency = np.zeros(buckets)
    frequency[where[where >= 0]] = n[where >= 0]
    return np.log((1 + n[where < 0].sum()) / (1 + frequency)) + 1


def _grouped(df: DataFrame, keys: list[str], work: Callable[[pa.Table], list[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """Run ``work`` on each group of equal ``keys``, many groups a call: rows are brought together and sorted, and groups
    that end in a batch are handled with it. ``work`` gets a table of whole groups and returns (a, b) edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def give(table: pa.Table) -> pa.RecordBatch:
            a, b = work(table)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                same = np.ones(batch.num_rows - 1, bool)
                for k in keys:
                    x = batch.column(k).to_numpy()
                    same &= x[1:] == x[:-1]
                if held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys):
                    yield give(pa.Table.from_batches(held))
                    held = []
                last = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
                if last:
                    yield give(pa.Table.from_batches([*held, batch.slice(0, last)]))
                    held = []
                held.append(batch.slice(last))
        if held:
            yield give(pa.Table.from_batches(held))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def _group_bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.ones(len(table), bool)
    new[1:] = False
    for k in keys:
        x = table.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(new), len(table))


def _fixed(column: pa.ChunkedArray, dtype: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), width)


def _forest(ids: np.ndarray, i: list[np.ndarray], j: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest: each id that has a link, and the smallest id it reaches."""
    if not i:
        return ids[:0], ids[:0]
    i, j = np.concatenate(i), np.concatenate(j)
    root = ids.copy()
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == root).all():
            own = root != ids
            return ids[own], root[own]
        root = new


def likely_pairs(table: pa.Table, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Within each bucket (or pair of its tiles), links of rows that agree in at least ``least`` of ``k`` samples."""
    table = table.combine_chunks()
    ids, samples = table.column("rep").to_numpy(), _fixed(table.column("samples"), "<u4", k)
    tile, a, b = (table.column(c).to_numpy() for c in ("tile", "ta", "tb"))
    bounds = _group_bounds(table, ["key", "ta", "tb"])
    size = np.diff(bounds)
    out_a, out_b = [], []
    pairs = bounds[:-1][size == 2]
    alike = (samples[pairs] == samples[pairs + 1]).sum(1) >= least
    x, y = ids[pairs[alike]], ids[pairs[alike] + 1]
    out_a.append(np.maximum(x, y))
    out_b.append(np.minimum(x, y))
    for s, n in zip(bounds[:-1][size > 2], size[size > 2]):
        own, i, j = samples[s : s + n], [], []
        left, right = np.flatnonzero(tile[s : s + n] == a[s]), np.flatnonzero(tile[s : s + n] == b[s])
        for p, row in enumerate(left):
            others = left[p + 1 :] if a[s] == b[s] else right
            near = others[(own[others] == own[row]).sum(1) >= least]
            i.append(np.full(len(near), row))
            j.append(near)
        x, y = _forest(ids[s : s + n], i, j)
        out_a.append(x)
        out_b.append(y)
    return np.concatenate(out_a), np.concatenate(out_b)


def verified_pairs(table: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Within each candidate group (or pair of its tiles), links of weighted Jaccard similarity >= ``threshold``.

    Each text in turn is held against all texts that its links so far don't reach; pairs inside a component already found
    say nothing new and are left out.
    """
    bounds = _group_bounds(table, ["component", "ta", "tb"])
    out_a, out_b = [], []
    ids, tile, a, b = (table.column(c).to_numpy() for c in ("rep", "tile", "ta", "tb"))
    keys_of, weights_of = table.column("keys"), table.column("weights")
    for s, e in zip(bounds[:-1], bounds[1:]):
        if e - s < 2:
            continue
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in keys_of.slice(s, e - s)]
        weights = [np.frombuffer(x.as_py(), np.float64) for x in weights_of.slice(s, e - s)]
        size = np.array([len(x) for x in sets])
        every, heavy = np.concatenate(sets), np.concatenate(weights)
        begin = np.concatenate(([0], np.cumsum(size)))
        total = np.add.reduceat(heavy, begin[:-1])
        own, of = ids[s:e], tile[s:e]
        root = np.arange(e - s)
        order = np.argsort(-total, kind="stable")
        links = []
        for turn, p in enumerate(order):
            rest, some = order[turn + 1 :], 32
            rest = rest[(root[rest] != root[p]) & (total[rest] >= threshold * total[p])]
            if a[s] != b[s]:
                rest = rest[of[rest] != of[p]]
            while len(rest):  # a link found early leaves out what it reaches
                others, rest, some = rest[:some], rest[some:], some * 4
                if len(others) * 4 > e - s:
                    which, chosen, edge = every, heavy, begin
                    pick = others
                else:
                    which = np.concatenate([sets[o] for o in others])
                    chosen = np.concatenate([weights[o] for o in others])
                    edge = np.concatenate(([0], np.cumsum(size[others])))
                    pick = np.arange(len(others))
                at = np.minimum(np.searchsorted(sets[p], which), len(sets[p]) - 1)
                shared = np.where(sets[p][at] == which, np.minimum(weights[p][at], chosen), 0.0)
                shared = np.add.reduceat(shared, edge[:-1])[pick]
                near = others[shared / (total[p] + total[others] - shared) >= threshold]
                if len(near):
                    links += [(p, o) for o in near.tolist()]
                    root[np.isin(root, root[near])] = root[p]
                    rest = rest[root[rest] != root[p]]
        if links:
            i, j = np.array(links).T
            x, y = _forest(own, [i], [j])
            out_a.append(x)
            out_b.append(y)
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(out_a or empty), np.concatenate(out_b or empty)


def near_texts(
    docs: DataFrame, *, width: int = 5, threshold: float = 0.8, bands: int = 16, rows: int = 4, buckets: int = 1 << 18, tile: int = 1024, tile_shingles: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, class_id, kept): near-duplicate classes of texts, the class id being the smallest id in it.

    1. Inverse document frequencies by word bucket over all texts. 2. ``bands * rows`` consistent weighted samples of each
    text's TF-IDF shingles; texts with the same words in the same order become one representative. 3. Representatives
    that share a band's key are compared by their samples; those that agree often enough to be possibly above the
    threshold (six standard deviations of slack) form candidate groups. 4. The weighted Jaccard similarity of pairs in a
    group is computed from the whole texts; links of at least ``threshold`` make the classes. A pair at 0.8 is missed by
    all bands with a chance of 2e-4, at 0.9 of 7e-8. Large buckets and groups are cut into tiles and pairs of tiles, and
    send back spanning forests, never pairs.

    Texts without words, null ones included, link with nothing. Rows that repeat an id share a class. Ids are integers;
    rows with a null id link with nothing: their class is null, and they are kept.
    """
    every = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    idf = inverse_frequencies(every, buckets=buckets)
    source = every.where("id is not null")
    k = bands * rows

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        sampler = Sampler(k)
        for b in slices(batches, 256):
            texts = raw_bytes(b, "text")
            key, weight, bounds = shingles(texts, width, idf)
            samples = sampler.samples(key, weight, bounds)
            h, counts = word_hashes(texts)
            at = np.concatenate(([0], np.cumsum(counts)))
            content = [xxhash.xxh3_128_digest(h[at[i] : at[i + 1]].tobytes()) if counts[i] else None for i in range(len(texts))]
            keys = band_keys(samples, rows)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(content, pa.binary()), pa.array([x.tobytes() for x in samples], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands), pa.int32()), pa.array(keys.ravel()))], ["id", "content", "samples", "keys"]
            )

    signed = cut(source.mapInArrow(sign, "id long, content binary, samples binary, keys array<long>"), "signed")
    reps = cut(signed.where("content is not null").groupBy("content").agg(F.min("id").alias("rep"), F.count("*").alias("_n"), F.first("samples").alias("samples"), F.first("keys").alias("keys")), "reps")

    # candidate groups
    banded = reps.select("rep", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    members = banded.join(shared.hint("merge"), "key").join(reps.select("rep", "samples").hint("merge"), "rep")
    likely = cut(_grouped(_tiled(members, "key", ["samples"]), ["key", "ta", "tb"], lambda t: likely_pairs(t, k, _least(k, threshold))), "likely")
    groups = cut(components(likely.distinct()).select(F.col("node").alias("rep"), "component"), "groups")

    # verification from whole texts
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            key, weight, bounds = shingles(raw_bytes(b, "text"), width, idf)
            keys = [key[x:y].tobytes() for x, y in zip(bounds, bounds[1:])]
            weights = [weight[x:y].tobytes() for x, y in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([b.column("component"), b.column("id"), pa.array(np.diff(bounds)), pa.array(keys, pa.binary()), pa.array(weights, pa.binary())], ["component", "rep", "n", "keys", "weights"])

    chosen = lookup(source, groups.select(F.col("rep").alias("id"), "component"), "id", "inner").select("id", "component", "text")
    weighed = cut(chosen.mapInArrow(weigh, "component long, rep long, n long, keys binary, weights binary"), "weighed")
    sizes = weighed.groupBy("component").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / tile_shingles)).cast("int").alias("tiles"))
    placed = lookup(weighed, sizes, "component", "inner")
    links = cut(_grouped(_tiled(placed, "component", ["keys", "weights"]), ["component", "ta", "tb"], lambda t: verified_pairs(t, threshold)), "linked")
    classes = components(links.distinct()).withColumnRenamed("node", "rep")

    found = cut(reps.select("content", "rep", "_n").join(classes.hint("merge"), "rep", "left").select("content", "_n", F.coalesce("component", "rep").alias("class_id")), "classes")
    out = join_counted(signed.where("content is not null").select("id", "content"), found, ["content"], signed.count()).select("id", "class_id")
    out = out.unionAll(signed.where("content is null").select("id", F.col("id").alias("class_id")))
    none = every.where("id is null").select("id", F.col("id").alias("class_id"))
    return out.unionAll(none).select(F.col("id").alias(id_col), "class_id", F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)).alias("kept"))


def _least(k: int, threshold: float) -> int:
    """Samples in which a pair at the threshold agrees, less six standard deviations."""
    return max(1, int(k * threshold - 6 * (k * threshold * (1 - threshold)) ** 0.5))


def _tiled(rows: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """A row for each pair of tiles that its tile is in; a group of one tile has the pair (0, 0)."""
    tile = rows.withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    dealt = tile.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return dealt.select(key, F.least("tile", "other").alias("ta"), F.greatest("tile", "other").alias("tb"), "rep", "tile", *payload)
