"""Toxicity by a weighted finite-state grammar over clauses (operator 1)."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import cut, slices, strings

_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"[^.!?;:,\n]+")

#: Classes of words that the transducers read.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)

#: Closed classes of words in English, German, French and Spanish. Insults are learned.
CLOSED = {
    THREAT: "kill hurt destroy shoot stab beat murder töten umbringen erschießen schlagen tuer frapper massacrer matar golpear destruir",
    TARGET: "you your yours they them he him she her these those dich dir ihr euch sie er toi vous ils elles eux lui tú ti usted ustedes ellos ellas",
    NEGATION: "not no never isn't aren't don't nicht kein keine nie niemals pas jamais aucun ne nunca jamás tampoco",
    REPORT: "said says wrote writes called claimed quoted sagte schrieb nannte behauptete dit écrit déclare dijo escribe llamó",
}

#: What a clause can give: an insult, one near a target, a threat against a target; doubled for negated or reported ones.
PLAIN, DIRECTED, THREATENED = 1, 2, 3
GAIN = {PLAIN: 1.0, DIRECTED: 1.25, THREATENED: 1.5}


@dataclass
class Transducer:
    """A Mealy machine over word classes: step[state][class] = (next state, output)."""

    step: list[list[tuple[int, object]]]

    def compose(self, other: Transducer, join) -> Transducer:
        """Both machines in step; ``join`` makes one output of two. States are pairs, numbered from (0, 0)."""
        n = len(other.step)
        table = [[((a_next * n + b_next), join(a_out, b_out)) for (a_next, a_out), (b_next, b_out) in zip(a, b)] for a in self.step for b in other.step]
        return Transducer(table)


def countdown(trigger: set[int], reach: int, mark: object) -> Transducer:
    """Puts out ``mark`` for each word within ``reach`` words after a trigger."""
    return Transducer([[(reach if c in trigger else max(0, left - 1), mark if left else None) for c in range(6)] for left in range(reach + 1)])


def emits(cls: int, mark: object) -> Transducer:
    return Transducer([[(0, mark if c == cls else None) for c in range(6)]])


def grammar(reach: int = 3) -> Transducer:
    """Insult, threat, target, negation and reported-speech transducers composed into one.

    Its output for a word is 0 or what happens there: PLAIN, DIRECTED (a target stood within ``reach`` words before) or
    THREATENED (a threat within ``reach`` words before a target, or after it); 3 more where a negation within ``reach``
    words before or a reporting verb anywhere before holds the clause off.
    """
    insult = emits(INSULT, "insult")
    target = countdown({TARGET}, reach, "near target")
    before = countdown({THREAT}, reach, "near threat")
    word = Transducer([[(0, c) for c in range(6)]])
    negation = countdown({NEGATION}, reach, "held off")
    report = Transducer([[(1 if c == REPORT or said else 0, "held off" if said else None) for c in range(6)] for said in (0, 1)])
    both = lambda a, b: (a, b)
    machine = insult.compose(target, both).compose(before, both).compose(word, both).compose(negation.compose(report, lambda a, b: a or b), both)

    def kind(out) -> int:
        (((hit, near_target), near_threat), cls), off = out
        what = DIRECTED if hit and near_target else PLAIN if hit else THREATENED if (cls == TARGET and near_threat) or (cls == THREAT and near_target) else 0
        return what + 3 * bool(off) if what else 0

    return Transducer([[(nxt, kind(out)) for nxt, out in row] for row in machine.step])


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def __post_init__(self) -> None:
        self.closed = {w: c for c, ws in CLOSED.items() for w in ws.split()}
        self.machine = grammar().step

    def prefilter(self):
        """An automaton over whatever must occur in a text for the grammar to find anything; None if nothing can."""
        import ahocorasick

        keys = [*self.words, *self.stems, *CLOSED[THREAT].split()]
        a = ahocorasick.Automaton()
        for k in keys:
            a.add_word(k, 1)
        a.make_automaton()
        return a

    def read(self, word: str) -> tuple[int, float]:
        w = self.words.get(word, 0.0)
        for n in STEMS:
            if len(word) > n and (s := self.stems.get(word[:n], 0.0)) > w:
                w = s
        return (INSULT, w) if w else (self.closed.get(word, OTHER), 1.0)

    def clauses(self, text: str, ready) -> list[tuple[int, int, float, bool]]:
        """(start, end, score, held off) of each clause in which the grammar finds something."""
        low = text.lower()
        if next(ready.iter(low), None) is None:
            return []
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        out = []
        for m in _CLAUSE.finditer(low):
            state, plain, off = 0, 0.0, 0.0
            read = [self.read(w) for w in _WORD.findall(m[0])]
            if not any(c in (INSULT, THREAT) for c, _ in read):
                continue
            for cls, weight in read:
                state, what = self.machine[state][cls]
                if what > 3:
                    off += weight * GAIN[what - 3]
                elif what:
                    plain += weight * GAIN[what]
            if plain or off:
                out.append((m.start(), m.end(), plain or off, not plain))
        return out

    @staticmethod
    def features(clauses: list[tuple[int, int, float, bool]]) -> list[float]:
        """Of a text: 1, sum and maximum of its clauses' scores, sum of those held off; sums on a logarithmic scale."""
        plain = [s for _, _, s, off in clauses if not off]
        return [1.0, math.log1p(sum(plain)), math.log1p(max(plain, default=0.0)), math.log1p(sum(s for _, _, s, off in clauses if off))]

    def score(self, clauses) -> float:
        z = float(np.dot(self.weights, self.features(clauses)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


#: Lengths of the word beginnings that may be learned as stems.
STEMS = (4, 5, 6, 7, 8)


def _names(text: str) -> set[str]:
    words = set(_WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def _lexicon(counts: list[tuple[str, int, int]], positive: int, negative: int) -> tuple[dict[str, float], dict[str, float]]:
    """Arcs of the insult transducer: words and stems whose log-odds are above 1.5 with 95 % confidence."""
    words, stems = {}, {}
    for name, pos, neg in counts:
        odds = math.log((pos + 0.5) / (positive + 1)) - math.log((neg + 0.5) / (negative + 1))
        if odds - 1.64 * math.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5)) > 1.5:
            (stems if name.endswith("*") else words)[name.rstrip("*")] = odds
    return words, stems


def held_out(id_col: str = "doc_id") -> F.Column:
    """The fold that is never learned from: crc32 of the id as text, modulo 3, is 1. A null id is not in it."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 20_000, support: int = 4, support_share: float = 0.01, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn the insult arcs and the weights of a text's features from labelled rows outside the held-out fold.

    At most ``sample_rows`` labelled rows are used, those of the smallest hash of their id (the bound of this fit); equal
    texts count once. Arcs come from two thirds of them while the feature weights are fitted on the rest, and then from
    all. Without labels of both kinds the model has no arcs and scores the share of positives.
    """
    own = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    chosen = own.where(~held_out("id")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample = source.join(F.broadcast(chosen), "id").groupBy(F.md5("text").alias("part")).agg(F.first("text").alias("text"), F.max("y").alias("y"))
    sample = cut(sample.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(3))), "toxic-sample")
    totals: dict[tuple[bool, int], int] = {}
    for r in sample.groupBy("part", "y").count().collect():
        totals[r["part"] == 0, r["y"]] = totals.get((r["part"] == 0, r["y"]), 0) + r["count"]
    positive, negative = (totals.get((False, y), 0) + totals.get((True, y), 0) for y in (1, 0))
    model = Model()
    model.weights = np.array([math.log((positive + 0.5) / (negative + 0.5)) if positive + negative else 0.0, 0.0, 0.0, 0.0])
    if not positive or not negative:
        return model

    def count(only: set[str] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: Counter = Counter()
            for b in slices(batches):
                for text, y, part in zip(strings(b, "text"), b.column("y").to_pylist(), b.column("part").to_pylist()):
                    names = _names(text)
                    for name in names if only is None else names & only:
                        found[name, y, part == 0] += 1
            rows = list(found.items())
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.int32()), pa.array([k[2] for k, _ in rows], pa.bool_()), pa.array([n for _, n in rows], pa.int64())], ["name", "y", "fit_part", "n"])

        return run

    schema = "name string, y int, fit_part boolean, n long"
    least = max(support, math.ceil(support_share * positive))
    frequent = sample.where("y = 1").mapInArrow(count(None), schema).groupBy("name").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    only = {r["name"] for r in frequent.select("name").collect()}
    sums = {}
    for r in sample.mapInArrow(count(only), schema).groupBy("name", "y", "fit_part").agg(F.sum("n").alias("n")).collect():
        sums[r["name"], r["y"], r["fit_part"]] = r["n"]
    get = sums.get
    model.words, model.stems = _lexicon([(n, get((n, 1, False), 0), get((n, 0, False), 0)) for n in sorted(only) if get((n, 1, False), 0) >= 0.6 * least], totals.get((False, 1), 0), totals.get((False, 0), 0))
    trial = model

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = trial.prefilter()
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([trial.features(trial.clauses(t, ready)) for t in strings(b, "text")], pa.list_(pa.float64())), b.column("y")], ["x", "y"])

    rows = sample.where("part = 0").select("text", "y").mapInArrow(measure, "x array<double>, y int").collect()
    if len({r["y"] for r in rows}) == 2:
        x, y = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], float)
        w = np.zeros(x.shape[1])
        for _ in range(30):  # Newton steps with a small ridge
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (y - p) - 0.05 * w
            w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w)), grad)
        model = Model(weights=w)
    model.words, model.stems = _lexicon([(n, get((n, 1, False), 0) + get((n, 1, True), 0), get((n, 0, False), 0) + get((n, 0, True), 0)) for n in sorted(only)], positive, negative)
    return model


def scored(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, clauses array<struct<start, end, score, held_off>>) for every row: whole texts, one pass, no shuffle.

    Null and empty texts have no clause and the score of such texts; repeated rows give repeated rows.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("held_off", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = model.prefilter()
        for b in slices(batches):
            found = [model.clauses(t, ready) for t in strings(b, "text")]
            rows = [[dict(zip(("start", "end", "score", "held_off"), c)) for c in f] for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(f) for f in found], pa.float64()), pa.array(rows, kind)], ["id", "score", "clauses"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, score double, clauses array<struct<start:bigint,end:bigint,score:double,held_off:boolean>>")
    return out.withColumnRenamed("id", id_col)


def without_toxic(docs: DataFrame, model: Model, *, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = model.prefilter()
        for b in slices(batches):
            yield b.filter(pa.array([model.score(model.clauses(t, ready)) < threshold for t in strings(b, text_col)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
