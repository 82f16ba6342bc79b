"""Collocations by Rabin-Karp fingerprints of n-grams (operator 11)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.common import cut, join_counted, raw_bytes, slices

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BLANKS, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
CLASS = np.zeros(256, np.uint8)
CLASS[list(BLANKS)] = 1
CLASS[list(BREAKS)] = 2
TO_BLANK = bytes(32 if CLASS[b] else b for b in range(256))

#: Odd bases of the polynomials over bytes and over words, modulo 2^64.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Bytes of a window, fingerprints that a task holds before it sends them, phrases before it merges them, and different words.
WINDOW, HELD, HELD_PHRASES, HELD_WORDS = 1 << 20, 1 << 21, 1 << 20, 1 << 19
#: Bits of a filter of frequent fingerprints: so many for each, and so many at most (16 MB), whatever the corpus.
BITS_EACH, MOST_BITS = 16, 1 << 27
#: Phrases that all tasks are told (some 30 MB), and the share of the rows, those of the smallest ids, from which they are read.
MOST_TOLD, TOLD_SHARE = 1 << 20, 1 / 8


@cache
def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0 ... base^(n-1) and their inverses, modulo 2^64."""
    both = []
    for b in (base, pow(base, -1, 1 << 64)):
        row = np.full(n, b, np.uint64)
        row[0] = 1
        both.append(np.cumprod(row))
    return both[0], both[1]


def polynomials(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """sum(values[start + j] * base^j) of each stretch, from prefix sums."""
    up, down = powers(base, 1 << max(16, len(values).bit_length()))
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=prefix[1:])
    return (prefix[ends] - prefix[starts]) * down[starts]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of hashes, so that any of them can be taken."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """Words of a window: their hashes, whether each begins a piece, and where they lie. The first ``carried`` ones ended the
    window before, so that n-grams across both are seen; an n-gram belongs to the window of its last word."""

    def __init__(self, data: bytes, offset: int, before: Words | None, keep: int):
        raw = np.frombuffer(data, np.uint8)
        kind = CLASS[raw]
        inside = np.concatenate([[False], kind == 0, [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[::2], edge[1::2]
        broken = np.concatenate([[0], np.cumsum(kind == 2)])
        number = broken[start]  # of the piece within the window
        self.hash = mixed(polynomials(raw.astype(np.uint64) + np.uint64(1), start, end, BYTE_BASE))
        self.first = np.ones(len(start), bool)
        self.first[1:] = number[1:] != number[:-1]
        if len(start) and before is not None and not number[0] and not before.open_break:
            self.first[0] = False
        self.open_break = bool(len(raw)) and (broken[-1] > (number[-1] if len(start) else 0))
        if not len(start) and before is not None:
            self.open_break = self.open_break or before.open_break
        self.start, self.end, self.carried = start + offset, end + offset, 0
        if before is not None:
            self.carried = min(keep, len(before.hash))
            for name in ("hash", "first", "start", "end"):
                old = getattr(before, name)
                setattr(self, name, np.concatenate([old[len(old) - self.carried :], getattr(self, name)]))

    def within(self, k: int) -> np.ndarray:
        """First words of the n-grams of ``k`` words that lie in one piece and end in this window."""
        at = np.arange(max(0, self.carried - k + 1), len(self.hash) - k + 1)
        for j in range(1, k):
            at = at[~self.first[at + j]]
        return at


def windows(data: bytes, keep: int, size: int = WINDOW) -> Iterator[Words]:
    """Windows of lower-cased bytes, cut after a blank or break; longer ones only where a word is longer."""
    at, before = 0, None
    while at < len(data):
        end = min(len(data), at + size)
        if end < len(data):
            reach = size
            while True:
                found = np.flatnonzero(CLASS[np.frombuffer(data, np.uint8, min(reach, len(data) - at), at)])
                if len(found) or at + reach >= len(data):
                    end = at + int(found[-1]) + 1 if len(found) else len(data)
                    break
                reach *= 2
        before = Words(data[at:end], at, before, keep)
        yield before
        at = end


class Batch:
    """Texts of a batch as one string of bytes, with the language of each place. Breaks stand between texts."""

    def __init__(self, batch: pa.RecordBatch):
        texts = [t.translate(LOWER) for t in raw_bytes(batch, "text")]
        self.data = b"\n".join(texts)
        self.begins = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        langs = raw_bytes(batch, "lang")
        self.langs = list(dict.fromkeys(langs))
        number = {lang: k for k, lang in enumerate(self.langs)}
        self.of_text = np.array([number[lang] for lang in langs], np.int64)
        sizes = np.array([len(x) for x in self.langs])
        ends = np.cumsum(sizes)
        joined = np.frombuffer(b"".join(self.langs), np.uint8).astype(np.uint64) + np.uint64(1)
        self.salt = mixed(polynomials(joined, ends - sizes, ends, BYTE_BASE)) if len(joined) else np.zeros(len(sizes), np.uint64)

    def text_at(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, place, side="right") - 1

    def fingerprints(self, words: Words, at: np.ndarray, k: int, bits: int) -> np.ndarray:
        """Of the n-grams of ``k`` words at ``at``, with their language and length in it."""
        h = polynomials(words.hash, at, at + k, WORD_BASE) + self.salt[self.of_text[self.text_at(words.start[at])]] * np.uint64(2 * k + 1)
        return mixed(h) >> np.uint64(64 - bits)


class Frequent:
    """A filter of bounded size that holds frequent fingerprints; it may hold others too, which costs time, not rows."""

    def __init__(self, spark, table: DataFrame):
        size = BITS_EACH * table.count()
        self.size = min(MOST_BITS, 1 << max(10, size.bit_length()))
        place = F.explode(F.array(F.col("fp").bitwiseAND(self.size - 1), F.shiftrightunsigned("fp", 32).bitwiseAND(self.size - 1))).alias("bit")
        lanes = table.select(place).groupBy(F.expr("shiftright(bit, 6)").alias("lane")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits")).toArrow()
        bits = np.zeros(self.size // 64, np.uint64)
        bits[lanes.column("lane").to_numpy()] = lanes.column("bits").to_numpy().view(np.uint64)
        self.bits: Broadcast = spark.sparkContext.broadcast(bits)

    def has(self, fp: np.ndarray) -> np.ndarray:
        bits, mask = self.bits.value, np.uint64(self.size - 1)
        low, high = fp & mask, (fp >> np.uint64(32)) & mask
        return ((bits[low >> np.uint64(6)] >> (low & np.uint64(63))) & (bits[high >> np.uint64(6)] >> (high & np.uint64(63))) & np.uint64(1)).astype(bool)


def _candidates(batch: Batch, words: Words, k: int, known: list[Frequent], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of ``k`` words that may be frequent, since both shorter ones by a word are in the filter of theirs, and their fingerprints."""
    at = words.within(k)
    if k > 1:
        every = np.arange(len(words.hash) - k + 2)
        fine = known[k - 2].has(batch.fingerprints(words, every, k - 1, bits))
        at = at[fine[at] & fine[at + 1]]
    return at, batch.fingerprints(words, at, k, bits)


def _chosen(batch: Batch, words: Words, known: list[Frequent], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length the candidates that are in its filter, their fingerprints, and of all n-grams whether they are in it. These are
    just the n-grams that were counted, of all fingerprints that were found to be frequent."""
    fine = np.zeros(0, bool)
    for k, filter_ in enumerate(known, 1):
        at = words.within(k)
        if k > 1:
            at = at[fine[at] & fine[at + 1]]
        if k < len(known):
            fps = batch.fingerprints(words, np.arange(max(0, len(words.hash) - k + 1)), k, bits)
            fine = filter_.has(fps)
            fp, own = fps[at], fine[at]
        else:
            fp = batch.fingerprints(words, at, k, bits)
            own = filter_.has(fp)
        yield at[own], fp[own], fine


def _counted(source: DataFrame, k: int, known: list[Frequent], least: int, bits: int) -> DataFrame:
    """(fp, n): fingerprints of n-grams of ``k`` words that occur ``least`` times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def packed() -> pa.RecordBatch:
            values, inverse = np.unique(np.concatenate([v for v, _ in held]), return_inverse=True)
            n = np.bincount(inverse, np.concatenate([n for _, n in held])).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], ["fp", "n"])

        for b in slices(batches):
            batch = Batch(b)
            for words in windows(batch.data, k - 1):
                held.append(np.unique(_candidates(batch, words, k, known, bits)[1], return_counts=True))
                size += len(held[-1][0])
                if size >= HELD:
                    yield packed()
                    held, size = [], 0
        if size:
            yield packed()

    found = source.mapInArrow(run, "fp long, n long")
    return cut(found.groupBy("fp").agg(F.sum("n").alias("n")).where(F.col("n") >= least), f"grams{k}")


def numbered(data: bytes, words: Words, at: np.ndarray, number: dict[bytes, int]) -> np.ndarray:
    """The number in ``number``, which gets new words, of each of the words ``at``; -1 for others. Words of equal hash are held
    against the first of them, byte by byte."""
    raw, start, end = np.frombuffer(data, np.uint8), words.start[at], words.end[at]
    _, one, inverse = np.unique(words.hash[at], return_index=True, return_inverse=True)
    first, size = one[inverse], end - start
    same = size == size[first]
    check = np.flatnonzero(same & (first != np.arange(len(first))))
    step = np.arange(size[check].sum()) - np.repeat(np.cumsum(size[check]) - size[check], size[check])
    differ = raw[np.repeat(start[check], size[check]) + step] != raw[np.repeat(start[first[check]], size[check]) + step]
    same[np.repeat(check, size[check])[differ]] = False
    ids = np.array([number.setdefault(data[start[i] : end[i]], len(number)) for i in one], np.int64)[inverse]
    for i in np.flatnonzero(~same):
        ids[i] = number.setdefault(data[start[i] : end[i]], len(number))
    result = np.full(len(words.hash), -1, np.int32)
    result[at] = ids
    return result


ROW = ["lang", "k", "phrase", "n", "first_id", "first_at", "fp"]


class Told:
    """Frequent phrases that all tasks know, one for a fingerprint: by length sorted fingerprints, words by number and languages."""

    def __init__(self, phrases: pa.Table, most: int):
        cells = [pc.split_pattern(phrases.filter(pc.equal(phrases["k"], k)).column("phrase").cast(pa.binary()), b" ").combine_chunks().flatten() for k in range(1, most + 1)]
        numbers = pa.concat_arrays(cells).dictionary_encode()
        langs = phrases["lang"].combine_chunks().cast(pa.binary()).dictionary_encode()
        self.words, self.langs = numbers.dictionary.to_pylist(), langs.dictionary.to_pylist()
        number, lang, length = numbers.indices.to_numpy(), langs.indices.to_numpy(), phrases["k"].to_numpy()
        ends = np.cumsum([0, *(len(c) for c in cells)])
        self.of = []
        for k in range(1, most + 1):
            fp = phrases["fp"].to_numpy()[length == k].view(np.uint64)
            order = np.argsort(fp)
            self.of.append((fp[order], number[ends[k - 1] : ends[k]].reshape(-1, k)[order], lang[length == k][order]))

    def place(self, k: int, fp: np.ndarray) -> np.ndarray:
        """Which phrase has the fingerprint; -1 where none has."""
        fps = self.of[k - 1][0]
        if not len(fps):
            return np.full(len(fp), -1)
        place = np.minimum(np.searchsorted(fps, fp), len(fps) - 1)
        return np.where(fps[place] == fp, place, -1)


class Found:
    """Phrases of ``k`` words that a task has found: fingerprints, words by number, languages, counts and first places."""

    NAMES = ("fp", "lang", "n", "none", "row", "at")

    def __init__(self, k: int):
        self.k, self.parts, self.size = k, [], 0

    def add(self, words: np.ndarray, **columns: np.ndarray) -> None:
        """Phrases in order of their places."""
        self.parts.append(({name: columns[name] for name in self.NAMES}, words))
        self._merge(np.argsort(columns["fp"], kind="stable"))

    def _merge(self, order: np.ndarray) -> None:
        """Equal phrases of the last part, in order of fingerprint and place, become one. All are held against the first place of
        their fingerprint, word by word; others with that fingerprint stay by themselves."""
        of, words = self.parts.pop()
        of, words = {name: of[name][order] for name in self.NAMES}, words[order]
        new = np.ones(len(order), bool)
        new[1:] = of["fp"][1:] != of["fp"][:-1]
        head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        same = (of["lang"] == of["lang"][head]) & (words == words[head]).all(axis=1)
        n = np.zeros(len(order), np.int64)
        np.add.at(n, np.where(same, head, np.arange(len(order))), of["n"])
        left = n > 0
        of["n"] = n
        self.parts.append(({name: of[name][left] for name in self.NAMES}, words[left]))
        self.size = sum(len(w) for _, w in self.parts)

    def shrink(self) -> int:
        """Merge all parts; returns how many phrases are left."""
        if len(self.parts) > 1:
            self.parts = [({name: np.concatenate([of[name] for of, _ in self.parts]) for name in self.NAMES}, np.concatenate([w for _, w in self.parts]))]
            of = self.parts[0][0]
            self._merge(np.lexsort((of["at"], of["row"], of["none"], of["fp"])))
        return self.size

    def rows(self, texts: pa.Array, langs: list[bytes]) -> pa.RecordBatch:
        """What was found, as (lang, k, phrase, n, first_id, first_at, fp)."""
        self.shrink()
        of, words = self.parts[0]
        phrase = pc.binary_join_element_wise(*(texts.take(pa.array(words[:, j])) for j in range(self.k)), b" ")
        lang = pa.array(langs, pa.binary()).take(pa.array(of["lang"])).cast(pa.string())
        place = [pa.array(of[name], pa.int64(), mask=of["none"]) for name in ("row", "at")]
        self.parts, self.size = [], 0
        return pa.RecordBatch.from_arrays([lang, pa.array(np.full(len(words), self.k, np.int32)), phrase.cast(pa.string()), pa.array(of["n"]), *place, pa.array(of["fp"].view(np.int64))], ROW)


def _texts(source: DataFrame, most: int, known: list[Frequent], bits: int, told: Broadcast | None = None) -> DataFrame:
    """(lang, k, phrase, fp, n, first): phrases that may be frequent as texts, counted by text, with the place (id, byte) where each
    first occurs; and (lang, 0, "") with the number of all words.

    Occurrences of ``told`` phrases are held against them and not sent. Where others have the fingerprint of one, their number is sent too,
    as (-k, fp): so much less than the fingerprint's count is the phrase's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tell = told.value if told is not None else None
        number: dict[bytes, int] = {}
        langs: dict[bytes, int] = {}
        if tell is not None:
            number.update(zip(tell.words, range(len(tell.words))))
            langs.update(zip(tell.langs, range(len(tell.langs))))
            others = [np.zeros(len(fps), np.int64) for fps, _, _ in tell.of]
        base = len(number)
        totals: Counter = Counter()
        found = [Found(k) for k in range(1, most + 1)]

        def packed() -> Iterator[pa.RecordBatch]:
            texts = pa.array(list(number), pa.binary())
            for f in found:
                if f.parts:
                    yield f.rows(texts, list(langs))
            number.clear()
            if tell is not None:
                number.update(zip(tell.words, range(base)))

        def counts(lang: pa.Array, k: np.ndarray, n: np.ndarray, fp: pa.Array) -> pa.RecordBatch:
            none = pa.nulls(len(n), pa.int64())
            return pa.RecordBatch.from_arrays([lang, pa.array(k, pa.int32()), pa.array([""] * len(n), pa.string()), pa.array(n, pa.int64()), none, none, fp], ROW)

        for b in slices(batches):
            b = b.take(pc.sort_indices(b.column("id")))  # nulls last
            batch = Batch(b)
            none = b.column("id").is_null().to_numpy(zero_copy_only=False)
            ids = pc.fill_null(b.column("id"), 0).to_numpy()
            task_lang = np.array([langs.setdefault(x, len(langs)) for x in batch.langs], np.int32)[batch.of_text]
            for words in windows(batch.data, most - 1):
                text = batch.text_at(words.start)
                totals.update(dict(zip(*(x.tolist() for x in np.unique(task_lang[text[words.carried :]], return_counts=True)))))
                word = None
                for f, (at, fp, fine) in zip(found, _chosen(batch, words, known, bits)):
                    if word is None:  # most == 1 has no filter of all words
                        word = numbered(batch.data, words, np.flatnonzero(fine) if most > 1 else at, number)
                    cells = word[at[:, None] + np.arange(f.k)]
                    if tell is not None:
                        place = tell.place(f.k, fp)
                        hit = np.flatnonzero(place >= 0)
                        _, theirs, lang = tell.of[f.k - 1]
                        same = (cells[hit] == theirs[place[hit]]).all(axis=1) & (task_lang[text[at[hit]]] == lang[place[hit]])
                        np.add.at(others[f.k - 1], place[hit[~same]], 1)
                        left = np.ones(len(at), bool)
                        left[hit[same]] = False
                        at, fp, cells = at[left], fp[left], cells[left]
                    likely = (cells >= 0).all(axis=1)
                    at, fp, cells = at[likely], fp[likely], cells[likely]
                    of = text[at]
                    f.add(cells, fp=fp, lang=task_lang[of], n=np.ones(len(at), np.int64), none=none[of], row=ids[of], at=words.start[at] - batch.begins[of])
                if len(number) - base >= HELD_WORDS or sum(f.size for f in found) >= HELD_PHRASES and sum(f.shrink() for f in found) >= HELD_PHRASES * 3 // 4:
                    yield from packed()
        yield from packed()
        if totals:
            names = list(langs)
            yield counts(pa.array([names[g] for g in totals], pa.binary()).cast(pa.string()), np.zeros(len(totals)), np.array(list(totals.values())), pa.nulls(len(totals), pa.int64()))
        for k, n in enumerate(others if tell is not None else [], 1):
            met = np.flatnonzero(n)
            if len(met):
                yield counts(pa.array([""] * len(met), pa.string()), np.full(len(met), -k), n[met], pa.array(tell.of[k - 1][0][met].view(np.int64)))

    found = source.mapInArrow(run, "lang string, k int, phrase string, n long, first_id long, first_at long, fp long")
    place = F.min(F.when(F.col("first_id").isNotNull(), F.struct("first_id", "first_at"))).alias("first")
    return found.groupBy("lang", "k", "phrase", "fp").agg(F.sum("n").alias("n"), place)


def _told(source: DataFrame, most: int, grams: list[DataFrame], known: list[Frequent], bits: int) -> DataFrame | None:
    """(lang, k, phrase, fp, total, first): one phrase for each frequent fingerprint, the MOST_TOLD most frequent ones, of those that the rows
    of the smallest ids have, with the count of the fingerprint. As all rows of smaller ids are among these, so is the first place."""
    last = source.agg(F.percentile_approx("id", F.lit(TOLD_SHARE), F.lit(10_000))).first()[0]
    if last is None:
        return None
    seen = _texts(source.where(F.col("id") <= last), most, known, bits).where("k > 0")
    one = seen.groupBy("k", "fp").agg(F.max_by(F.struct("lang", "phrase", "first"), F.struct("n", "lang", "phrase")).alias("one"))
    counts = [g.select(F.lit(k).alias("k"), "fp", F.col("n").alias("total")) for k, g in enumerate(grams, 1)]
    whole = cut(one.join(reduce(DataFrame.unionAll, counts).hint("merge"), ["k", "fp"]).select("one.lang", "k", "one.phrase", "fp", "total", "one.first"), "told")
    return cut(whole.orderBy(F.desc("total"), "k", "fp").limit(MOST_TOLD), "told") if whole.count() > MOST_TOLD else whole


def frequent_phrases(docs: DataFrame, *, most_words: int = 4, least: int = 30, fingerprint_bits: int = 64, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", no_lang: str = "und") -> DataFrame:
    """(lang, k, phrase, n, first): all phrases of one to ``most_words`` words that occur ``least`` times or more, and a row of
    ``k = 0`` with the number of words of each language.

    A-Z are lower-cased; texts are cut into pieces at ``.,;:!?`` and line breaks, pieces into words at blanks and tabs; null texts have no
    words, a null language is ``no_lang``. Occurrences may overlap and repeated rows count each time. ``first`` is the
    smallest (id, byte in the lower-cased text), null where all ids are.

    Length by length, prefix polynomials give every n-gram a fingerprint in numpy, tasks add up equal ones, and the shuffle counts fingerprints only.
    n-grams that hold an infrequent shorter one are left out by a filter of bounded size. A last pass reads the phrases behind
    frequent fingerprints from the texts, holds every occurrence against the first one of its window, and counts by text, so
    that phrases of equal fingerprint come apart. It runs over the rows of the smallest ids first; all tasks are told the phrases found there
    (MOST_TOLD at most, through the driver) and then send only others, and how many others had the fingerprint of a told one.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col), F.lit(no_lang)).cast("string").alias("lang"))
    known: list[Frequent] = []
    grams: list[DataFrame] = []
    for k in range(1, most_words + 1):
        grams.append(_counted(source.select("text", "lang"), k, known, least, fingerprint_bits))
        known.append(Frequent(spark, grams[-1]))
    kept = _told(source, most_words, grams, known, fingerprint_bits)
    if kept is None:
        return _texts(source, most_words, known, fingerprint_bits).where((F.col("n") >= least) | (F.col("k") == 0)).drop("fp")
    told = spark.sparkContext.broadcast(Told(kept.select("lang", "k", "phrase", "fp").toArrow(), most_words))
    found = cut(_texts(source, most_words, known, fingerprint_bits, told), "texts")
    others = found.where("k < 0").select((-F.col("k")).alias("k"), "fp", F.col("n").alias("others"))
    names = ["lang", "k", "phrase", "n", "first"]
    exact = kept.join(others.hint("merge"), ["k", "fp"], "left").withColumn("n", F.col("total") - F.coalesce("others", F.lit(0)))
    return found.where("k >= 0").select(names).unionAll(exact.select(names)).where((F.col("n") >= least) | (F.col("k") == 0))


def _part(start, length):
    return F.array_join(F.slice("words", start, length), " ")


def collocations(docs: DataFrame, *, most_words: int = 4, least: int = 30, scale: int = 2_000_000, covered_percent: int = 80, top: int | None = 2000, **columns) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, first_id, first_at): phrases of two or more words by score.

    Cutting a phrase after its first words gives l and r, the frequencies of both parts, and floor(scale * a / (l + r)); the cut of
    the lowest score counts, the earliest of equal ones. A phrase whose words lie inside a longer frequent one with at least
    ``covered_percent`` of its frequency is dropped. Each language's first ``top`` by score, frequency and phrase (in order of
    bytes) are ranked from 1; None ranks all. ``columns`` go to ``frequent_phrases``, which says what counts.
    """
    known = cut(frequent_phrases(docs, most_words=most_words, least=least, **columns), "phrases")
    words = known.where("k > 1").select("lang", "phrase", F.col("n").alias("a"), "k", F.split("phrase", " ").alias("words"))
    parts = words.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at"), "k", "words")
    sides = F.explode(F.array(F.struct(F.lit(True).alias("left"), _part(F.lit(1), F.col("at")).alias("part")), F.struct(F.lit(False).alias("left"), _part(F.col("at") + 1, F.col("k") - F.col("at")).alias("part"))))
    parts = cut(parts.select("lang", "phrase", "a", "at", sides.alias("side")).select("lang", "phrase", "a", "at", "side.left", "side.part"), "parts")
    sizes = parts.groupBy("lang", "part").agg(F.count("*").alias("_n"))
    sizes = cut(known.where("k > 0").select("lang", F.col("phrase").alias("part"), F.col("n").alias("f")).join(sizes.hint("merge"), ["lang", "part"]), "sizes")
    met = join_counted(parts, sizes, ["lang", "part"], parts.count())
    cuts = met.groupBy("lang", "phrase", "a", "at").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    both = F.col("l").cast("decimal(20,0)") + F.col("r").cast("decimal(20,0)")
    cuts = cuts.withColumns({"_both": both, "_scaled": F.col("a").cast("decimal(20,0)") * F.lit(scale).cast("decimal(10,0)")}).withColumn("score", F.expr("_scaled div _both"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "at", "l", "r")).alias("cut"))

    longer = words.where("k > 2").select("lang", "a", "k", "words", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"))
    longer = longer.select("lang", "a", "words", "size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("start"))
    longer = longer.groupBy("lang", _part(F.col("start"), F.col("size")).alias("phrase")).agg(F.max("a").alias("longest"))
    kept = best.join(longer.hint("merge"), ["lang", "phrase"], "left")
    kept = kept.where(F.col("longest").isNull() | (F.col("longest").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * covered_percent))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    totals = known.where("k = 0").select("lang", F.col("n"))
    places = known.where("k > 1").select("lang", "phrase", "first")
    found = ranked.join(totals.hint("merge"), "lang").join(places.hint("merge"), ["lang", "phrase"])
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "first.first_id", "first.first_at")
