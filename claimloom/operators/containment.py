"""Which strings contain which: an inverted index of character grams over the strings that are looked for."""

from __future__ import annotations

from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.sources.scratch import cut, hinted

#: Characters of a gram; shorter strings are their own gram.
GRAM = 4


#: Bytes of text that are hashed at once.
CHUNK = 1 << 20
#: Bytes of all strings looked for, up to which every task is given them.
FEW = 1 << 20
_P = 0x9E3779B97F4A7C15
_INVERSE = pow(_P, -1, 1 << 64)


@lru_cache(2)
def _powers(p: int, n: int = CHUNK) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, p, np.uint64))])


def _hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges, from sums of bytes times powers modulo 2^64; equal ranges have equal ones."""
    power = lambda p: _powers(p)[: len(text) + 1] if len(text) <= CHUNK else _powers.__wrapped__(p, len(text))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((text.astype(np.uint64) + np.uint64(1)) * power(_P)[:-1])])
    h = (sums[ends] - sums[starts]) * power(_INVERSE)[starts]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def _runs(text: np.ndarray, edges: np.ndarray, words: int | None, chars: list[int]):
    """(row, start, end) of the runs of so many words, or of characters, in rows of UTF-8 text that lie between ``edges``."""
    full = np.flatnonzero(np.diff(edges))
    first, last = edges[:-1][full], edges[1:][full]
    if words is not None:
        blank = np.flatnonzero(text == 32)
        starts, ends = np.sort(np.concatenate([first, blank + 1])), np.sort(np.concatenate([blank, last]))
        spans = [(starts, ends, words)]
    else:
        starts = np.flatnonzero((text & 0xC0) != 0x80)
        spans = [(starts, np.append(starts[1:], len(text)), n) for n in chars]
    for starts, ends, n in spans:
        row = np.searchsorted(first, starts, side="right") - 1
        here = np.arange(max(0, len(starts) - n + 1))
        here = here[row[here] == row[here + n - 1]]
        yield full[row[here]], starts[here], ends[here + n - 1]


def _pieces(hay):
    """(place of the first row, bytes, edges of the rows) of a column of strings, about ``CHUNK`` bytes at a time."""
    hay = pc.fill_null(hay, "").cast(pa.large_string())
    offsets = np.frombuffer(hay.buffers()[1], np.int64)[hay.offset : hay.offset + len(hay) + 1]
    data = np.frombuffer(hay.buffers()[2] or b"", np.uint8)
    low = 0
    while low < len(hay):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + CHUNK, side="right")) - 1)
        yield low, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def runs_of(hays: DataFrame, *, words: int | None = None, chars: list[int] = (), wanted: DataFrame | None = None, most: int = 1_000_000) -> DataFrame:
    """(d, run), each once: hashes of all runs of ``words`` words (between single blanks) or ``chars`` characters of ``hays`` (d, hay).

    Of runs only those ``wanted`` (run) are kept: where the text is read, if they are counted to be at most ``most``, else by a join.
    """
    small = wanted is not None and wanted.limit(most + 1).count() <= most
    keep = np.sort(np.array([r[0] for r in wanted.collect()], np.int64)) if small else None  # at most ``most`` numbers
    kind = dict(hays.dtypes)["d"]

    def find(batches):
        if keep is not None:
            likely = np.zeros(1 << 22, bool)
            likely[keep & 0x3FFFFF] = True
        for batch in batches:
            for low, text, edges in _pieces(batch.column(1)):
                for row, starts, ends in _runs(text, edges, words, list(chars)):
                    run = _hashes(text, starts, ends)
                    if keep is not None:
                        near = np.flatnonzero(likely[run & 0x3FFFFF])
                        near = near[np.isin(run[near], keep)]
                        row, run = row[near], run[near]
                    order = np.lexsort((run, row))
                    row, run = row[order], run[order]
                    new = np.ones(len(row), bool)
                    new[1:] = (row[1:] != row[:-1]) | (run[1:] != run[:-1])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[new] + low)), pa.array(run[new])], ["d", "run"])

    out = hays.select("d", "hay").mapInArrow(find, f"d {kind}, run bigint")
    return out if wanted is None or small else out.join(wanted.hint("merge"), "run", "left_semi").select("d", "run")


def in_one_pass(asked: DataFrame, hays: DataFrame, *, words: int | None = None, gram: int = GRAM) -> DataFrame | None:
    """(n, d), each once, for ``asked`` (n, needle, inner) and ``hays`` (d, hay) where hay contains needle; None if the needles have more than ``FEW`` bytes.

    Every task is given the needles and reads each text once. A hay that contains a needle has all runs of ``words`` words of its
    ``inner``, or, where that is null, all of its grams; in each piece of text a needle is looked up by the one that the
    fewest hays of the piece have, and these are checked for the whole needle. Only what is found leaves the scan.
    """
    if (asked.agg(F.sum(F.octet_length("needle"))).first()[0] or 0) > FEW:
        return None
    known = [(r["n"], r["needle"], r["inner"]) for r in asked.where(F.length("needle") > 0).select("n", "needle", "inner").collect()]  # at most ``FEW`` bytes
    sizes = sorted({min(len(needle), gram) for _, needle, inner in known if inner is None})
    hays = hays.select("d", "hay") if known else hays.select("d", "hay").limit(0)
    kind = dict(hays.dtypes)["d"]

    def prepared():
        """Distinct needles, the numbers of each, and of each needle the places of its runs in the sorted array of all."""
        numbers: dict[bytes, list[int]] = {}
        inner_of: dict[bytes, str | None] = {}
        for n, needle, inner in known:
            numbers.setdefault(needle.encode(), []).append(n)
            inner_of[needle.encode()] = inner
        needles = list(numbers)
        of, runs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size in [None, *sizes]:  # runs of words, then grams of each size
            here = [i for i, x in enumerate(needles) if (None if inner_of[x] is not None else min(len(x.decode()), gram)) == size]
            for low, text, edges in _pieces(pa.array([inner_of[needles[i]] or needles[i].decode() for i in here], pa.large_string())):
                for row, starts, ends in _runs(text, edges, words if size is None else None, [size]):
                    of.append(np.array(here, np.int64)[row + low])
                    runs.append(_hashes(text, starts, ends))
        keep, place = np.unique(np.concatenate(runs), return_inverse=True)
        pairs = np.unique(np.concatenate(of) * max(1, len(keep)) + place)
        return needles, [np.array(numbers[x], np.int64) for x in needles], keep, np.divmod(pairs, max(1, len(keep)))

    def find(batches):
        needles, numbers, keep, (of, place) = prepared()
        if not len(keep):
            return
        likely = np.zeros(1 << 22, bool)
        likely[keep & 0x3FFFFF] = True
        first = np.flatnonzero(np.diff(of, prepend=-1))
        last = np.append(first[1:], len(of))
        for batch in batches:
            for low, text, edges in _pieces(batch.column(1)):
                hits = [np.zeros(0, np.int64)]
                for row, starts, ends in chain(_runs(text, edges, words, []) if words is not None else [], _runs(text, edges, None, sizes)):
                    run = _hashes(text, starts, ends)
                    near = np.flatnonzero(likely[run & 0x3FFFFF])
                    at = np.minimum(np.searchsorted(keep, run[near]), len(keep) - 1)
                    same = keep[at] == run[near]
                    hits.append(at[same] * len(edges) + row[near][same])
                at, row = np.divmod(np.unique(np.concatenate(hits)), len(edges))
                n = np.bincount(at, minlength=len(keep))
                to = np.cumsum(n)
                found_n, found_row = [], []
                for i in np.flatnonzero(np.minimum.reduceat(n[place], first)):
                    own = place[first[i] : last[i]]
                    run = own[np.argmin(n[own])]
                    for r in row[to[run] - n[run] : to[run]]:
                        if needles[of[first[i]]] in text[edges[r] : edges[r + 1]].tobytes():
                            found_n.append(numbers[of[first[i]]])
                            found_row.append(r)
                if found_n:
                    rows = np.repeat(np.array(found_row), [len(x) for x in found_n])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found_n)), batch.column(0).take(pa.array(rows + low))], ["n", "d"])

    return hays.mapInArrow(find, f"n bigint, d {kind}")


def checked(hays: DataFrame, likely: DataFrame) -> DataFrame:
    """Rows of ``likely`` (d, needle, ...) whose hay contains the needle; texts that it does not name are dropped first."""
    named = hays.join(hinted(likely.select("d").distinct()), "d", "left_semi")
    return named.join(hinted(likely), "d").where(F.col("hay").contains(F.col("needle"))).drop("hay")


def containing(needles: DataFrame, hays: DataFrame, *, gram: int = GRAM) -> DataFrame:
    """(q, d), each once, for ``needles`` (q, needle) and ``hays`` (d, hay) where hay contains needle; empty needles are in none.

    Few needles are found in one pass over the texts. Else, of the grams of a text only those leave its scan that a needle
    has; they are written once and counted. A needle is looked up by the one that the fewest texts have, and the hits are
    checked. A gram that very many texts have meets the needles that have no rarer one by a broadcast, if these are counted
    to be few.
    """
    asked = cut(needles.select("q", "needle").where(F.length("needle") > 0).distinct().withColumn("n", F.monotonically_increasing_id()), "needles")
    found = in_one_pass(asked.withColumn("inner", F.lit(None).cast("string")), hays, gram=gram)
    if found is not None:
        return found.join(hinted(asked), "n").select("q", "d").distinct()
    n = asked.select("needle").distinct().withColumn("size", F.least(F.length("needle"), F.lit(gram)))
    sizes = sorted(r["size"] for r in n.select("size").distinct().collect())  # at most ``gram`` values
    if not sizes:
        return asked.select("q", F.lit(None).cast(dict(hays.dtypes)["d"]).alias("d"))  # no rows
    own = reduce(DataFrame.unionByName, (runs_of(n.where(F.col("size") == s).select(F.col("needle").alias("d"), F.col("needle").alias("hay")), chars=[s]) for s in sizes))
    parts = cut(own.select(F.col("d").alias("needle"), F.col("run").alias("gram")), "needle-grams")
    have = cut(runs_of(hays, chars=sizes, wanted=parts.select(F.col("gram").alias("run")).distinct()).withColumnRenamed("run", "gram"), "grams")
    often = have.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = cut(parts.join(often.hint("merge"), "gram").groupBy("needle").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram")), "rarest")
    likely = cut(have.join(hinted(rarest), "gram").select("d", "needle"), "likely")
    found = checked(hays, likely).select("d", "needle")
    return found.join(hinted(asked), "needle").select("q", "d").distinct()
