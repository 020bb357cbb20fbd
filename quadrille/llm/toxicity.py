"""Toxicity by a weighted finite-state pattern grammar.

Words are read as symbols: insult, threat, target, negation, report, or other. Four small
transducers mark the insults and threats of a clause: `speakers` tells who reports from who is
meant, `negations` marks what a negation reaches, `targets` and `reports` mark a clause that
names a target or reports speech, before or after the word. The last two guess at the start
and accept only clauses that bear them out, so exactly one path survives. A fifth gives each
marked word its weight. They are composed into one machine, which is run over each clause;
the weight of its path is the clause's score. So clauses are scored, not isolated words;
clauses without an insult or a threat score nothing.

The insult words and word beginnings are learnt from labelled rows, with a log-odds weight
each; a short list of plain words starts the grammar. The weights of the marks are learnt
from the same rows, by how much more or less often marked words stand in toxic ones. A
logistic curve over the clause scores, fitted on the same rows, gives the document's score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import held_out, lean_batches, materialize
from quadrille.llm.quality import train_ids

#: Labelled rows that the lexicon and the curve are fitted on, at most.
TRAIN_ROWS = 20_000
#: Entries of the lexicon, at most: those in the most toxic rows.
LEXICON = 5_000
#: A learnt entry is in at least so many toxic rows, and so many times likelier there.
LEAST_ROWS, LEAST_ODDS = 6, 60.0
PREFIXES = range(3, 8)
THRESHOLD = 0.5

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)

#: Starting lexicon, in the four languages of the documents.
SEEDS = {
    INSULT: "idiot idiots stupid moron morons imbecile worthless pathetic disgusting scum trash loser losers clown dumb filth vermin "
    "dumm blöd trottel abschaum imbécile crétin connard ordure estúpido imbécil basura escoria",
    THREAT: "kill hurt destroy beat punish töten vernichten tuer détruire matar destruir",
    TARGET: "you your they them he she his her him du dich ihr euch sie tu te vous ils elles usted ustedes ellos ellas él",
    NEGATION: "not never don't isn't aren't wasn't won't nicht nie kein keine pas jamais nunca jamás",
    REPORT: "said says wrote quoted claimed reported according sagte schrieb laut dit écrit selon dijo escribió según",
}
SEED_WEIGHT = 2.0

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_TOKEN = re.compile(r"([^\W\d_]+(?:'[^\W\d_]+)?)|([.!?;\n])")

#: Marks on an insult or a threat; a marked symbol is the symbol plus 8 times its marks.
NEGATED, AIMED, REPORTED = 1, 2, 4
#: Words between a negation and what it reaches, at most.
NEGATION_REACH = 3
#: Weight factors of the marks and of threats that aim at nobody, to start with; how far learning may move them;
#: and so many words' worth of evidence that the start counts for.
FACTORS = {"negated": 0.5, "reported": 0.6, "aimed": 1.25, "vague threat": 0.3}
BOUNDS = {"negated": (0.1, 0.95), "reported": (0.2, 0.95), "aimed": (1.05, 2.0), "vague threat": (0.1, 0.9)}
PRIOR_WORDS = 50


@dataclass
class Transducer:
    """arcs[state, symbol read] lists (symbol written, weight factor, next state)."""

    starts: list
    finals: set
    arcs: dict

    def compose(self, other: Transducer) -> Transducer:
        """The transducer that feeds what this one writes to the other; only states on a path from a
        start to an end remain."""
        starts = [(p, q) for p in self.starts for q in other.starts]
        arcs, seen, todo = {}, set(starts), list(starts)
        mine: dict = {}
        for (p, x), out in self.arcs.items():
            mine.setdefault(p, []).append((x, out))
        while todo:
            p, q = state = todo.pop()
            for x, out in mine.get(p, ()):
                both = [(z, v * w, (p2, q2)) for y, v, p2 in out for z, w, q2 in other.arcs.get((q, y), ())]
                if both:
                    arcs[state, x] = both
                    new = {n for _, _, n in both} - seen
                    seen |= new
                    todo += new
        alive = {(p, q) for p, q in seen if p in self.finals and q in other.finals}
        finals, grown = set(alive), True
        while grown:
            more = {s for (s, _), out in arcs.items() if s not in alive and any(n in alive for _, _, n in out)}
            alive, grown = alive | more, bool(more)
        arcs = {(s, x): [a for a in out if a[2] in alive] for (s, x), out in arcs.items() if s in alive}
        return Transducer([s for s in starts if s in alive], finals, {k: v for k, v in arcs.items() if v})


def _marked(symbol: int, mark: int) -> int:
    return symbol + 8 * mark if symbol % 8 in (INSULT, THREAT) else symbol


#: All symbols that a stage may be fed.
_SYMBOLS = [*range(6), *(k + 8 * m for k in (INSULT, THREAT) for m in range(1, 8))]


def speakers() -> Transducer:
    """A pronoun right before a word of reporting is the speaker, not a target."""
    arcs = {}
    for state in ("any", "target"):
        for x in _SYMBOLS:
            if x == TARGET:
                arcs[state, x] = [(TARGET, 1.0, "target"), (OTHER, 1.0, "speaker")]
            elif x != REPORT or state == "any":
                arcs[state, x] = [(x, 1.0, "any")]
    arcs["speaker", REPORT] = [(REPORT, 1.0, "any")]
    return Transducer(["any"], {"any", "target"}, arcs)


def negations() -> Transducer:
    """Marks the next insult or threat within a few words of a negation, unless a target stands between."""
    arcs = {}
    for left in range(NEGATION_REACH + 2):
        for x in _SYMBOLS:
            rest = NEGATION_REACH + 1 if x == NEGATION else max(0, left - 1) if x == OTHER else left if x == REPORT else 0
            arcs[left, x] = [(_marked(x, NEGATED) if left else x, 1.0, rest)]
    return Transducer([0], set(range(NEGATION_REACH + 2)), arcs)


def anywhere(symbol: int, mark: int) -> Transducer:
    """Marks all insults and threats of a clause that has the symbol anywhere, and none of one without."""
    arcs = {}
    for x in _SYMBOLS:
        if x != symbol:
            arcs["none", x] = [(x, 1.0, "none")]
        arcs["awaited", x] = [(_marked(x, mark), 1.0, "met" if x == symbol else "awaited")]
        arcs["met", x] = [(_marked(x, mark), 1.0, "met")]
    return Transducer(["none", "awaited"], {"none", "met"}, arcs)


def weights(factors: dict[str, float]) -> Transducer:
    """Gives each marked insult or threat its factor, and everything else none."""
    arcs = {}
    for x in _SYMBOLS:
        kind, marks = x % 8, x // 8
        factor = 1.0 if kind == INSULT else 0.0
        if kind == THREAT:
            factor = 1.0 / factors["aimed"] if marks & AIMED else factors["vague threat"]
        for mark, name in ((NEGATED, "negated"), (REPORTED, "reported"), (AIMED, "aimed")):
            factor *= factors[name] if marks & mark else 1.0
        arcs[0, x] = [(x, factor, 0)]
    return Transducer([0], {0}, arcs)


def marking() -> Transducer:
    return speakers().compose(negations()).compose(anywhere(TARGET, AIMED)).compose(anywhere(REPORT, REPORTED))


class Machine:
    """A composed transducer by numbers: step[state][symbol] lists (symbol written, factor, next state)."""

    def __init__(self, grammar: Transducer):
        states = {s: i for i, s in enumerate(dict.fromkeys([*grammar.starts, *(s for s, _ in grammar.arcs), *grammar.finals]))}
        self.starts, self.finals = [states[s] for s in grammar.starts], {states[s] for s in grammar.finals}
        self.step: list[list[list]] = [[[] for _ in range(6)] for _ in states]
        for (s, x), out in grammar.arcs.items():
            if x < 6:
                self.step[states[s]][x] = [(y, w, states[n]) for y, w, n in out]

    def weight(self, clause: list[tuple[int, float]]) -> float:
        """Of the path that reads the clause, the sum of each word's weight times the arc's factor."""
        live = dict.fromkeys(self.starts, 0.0)
        for symbol, weight in clause:
            new: dict[int, float] = {}
            for state, v in live.items():
                for _, f, n in self.step[state][symbol]:
                    if (u := v + weight * f) >= new.get(n, 0.0):
                        new[n] = u
            live = new
        return max(v for s, v in live.items() if s in self.finals)

    def marks(self, clause: list[tuple[int, float]]) -> list[int]:
        """The symbols that the path writes."""
        live: dict[int, list[int]] = {s: [] for s in self.starts}
        for symbol, _ in clause:
            live = {n: [*out, y] for state, out in live.items() for y, _, n in self.step[state][symbol]}
        return next(out for s, out in live.items() if s in self.finals)


@dataclass
class Lexicon:
    words: dict[str, float]
    prefixes: dict[str, float]
    factors: dict[str, float] = field(default_factory=lambda: dict(FACTORS))

    def machine(self) -> Machine:
        return Machine(marking().compose(weights(self.factors)))

    def symbols(self) -> dict:
        """word -> (symbol, weight), filled as words are met; bounded, as it starts anew when large."""
        known = {w: (k, SEED_WEIGHT) for k, v in SEEDS.items() for w in v.split()}
        known |= {w: (INSULT, v) for w, v in self.words.items()}
        prefixes = self.prefixes

        class Symbols(dict):
            def __missing__(self, word: str):
                best = max((prefixes.get(word[:n], 0.0) for n in PREFIXES), default=0.0)
                if len(self) > 100_000:
                    self.clear()
                    self.update(known)
                self[word] = out = (INSULT, best) if best else (OTHER, 0.0)
                return out

        return Symbols(known)


def clauses(text: str, symbols: dict) -> Iterator[list[tuple[int, float]]]:
    """The clauses with an insult or a threat, as (symbol, weight); of longer runs of other words, as
    many as a negation can reach over stand for all."""
    clause, hit, others = [], False, 0
    for word, _ in _TOKEN.findall(text):
        if word:
            known = symbols[word]
            others = 0 if known[0] else others + 1
            if others <= NEGATION_REACH + 1:
                clause.append(known)
                hit = hit or known[0] in (INSULT, THREAT)
        else:
            if hit:
                yield clause
            clause, hit, others = [], False, 0
    if hit:
        yield clause


def clause_scores(text: str, symbols: dict, machine: Machine | None = None) -> list[float]:
    """The weight that the machine gives each clause with an insult or a threat."""
    machine = machine or Lexicon({}, {}).machine()
    return [machine.weight(c) for c in clauses(text, symbols)]


def features(text: str | None, symbols: dict, machine: Machine) -> tuple[float, float, float, float]:
    """(sum, largest, number of clauses, sum for each hundred words), damped by logarithms."""
    text = (text or "").lower()
    words = _WORD.findall(text)
    if not any(s in (INSULT, THREAT) for s, _ in map(symbols.__getitem__, words)):
        return 0.0, 0.0, 0.0, 0.0
    scores = clause_scores(text, symbols, machine)
    total = sum(scores)
    return float(np.log1p(total)), float(np.log1p(max(scores, default=0.0))), float(np.log1p(len(scores))), float(np.log1p(100 * total / len(words)))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and other rows of the partition hold each word and each beginning."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for b in batches:
        for y, text in zip(b.column(0).to_pylist(), b.column(1)):
            words = set(_WORD.findall((text.as_py() or "").lower()))
            terms = set(words)
            terms.update(w[:n] + "*" for w in words for n in PREFIXES if len(w) > n)
            counts[int(y > 0.5)].update(terms)
    toxic = counts[1]
    other = counts[0]
    terms = list(toxic.keys() | other.keys())
    for lo in range(0, len(terms), 100_000):
        part = terms[lo : lo + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([toxic[t] for t in part], pa.int64()), pa.array([other[t] for t in part], pa.int64())], ["term", "toxic", "other"])


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """sample: (y, text), a bounded written table."""
    totals = sample.agg(F.sum("y"), F.count("*")).first()
    toxic = float(totals[0] or 0)
    other = float(totals[1] or 0) - toxic
    if not toxic or not other:
        return Lexicon({}, {})
    odds = ((F.col("toxic") + 0.5) / (toxic + 1)) / ((F.col("other") + 0.5) / (other + 1))
    found = (
        sample.select("y", "text")
        .mapInArrow(_terms, "term string, toxic long, other long")
        .groupBy("term")
        .agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
        .withColumn("odds", odds)
        .where((F.col("toxic") >= LEAST_ROWS) & (F.col("odds") >= LEAST_ODDS))
        .orderBy(F.desc("toxic"), "term")
        .limit(LEXICON)
        .collect()
    )
    words, prefixes = {}, {}
    for r in found:
        weight = min(5.0, float(np.log(r["odds"])))
        if r["term"].endswith("*"):
            prefixes[r["term"][:-1]] = weight
        else:
            words[r["term"]] = weight
    return Lexicon(words, prefixes)


def learn_factors(sample: DataFrame, lexicon: Lexicon) -> dict[str, float]:
    """The factor of each mark: how much likelier a word with it stands in a toxic row than one
    without, between its bounds; little evidence leaves it near where it starts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, machine, seen = lexicon.symbols(), Machine(marking()), Counter()
        for b in batches:
            for y, text in zip(b.column(0).to_pylist(), b.column(1)):
                for clause in clauses((text.as_py() or "").lower(), symbols):
                    seen.update((y > 0.5, x) for x in machine.marks(clause) if x % 8 in (INSULT, THREAT))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.bool_()), pa.array([k[1] for k in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())], ["toxic", "symbol", "n"])

    found = sample.mapInArrow(counted, "toxic boolean, symbol long, n long").groupBy("toxic", "symbol").agg(F.sum("n").alias("n")).collect()
    counts = {(r["toxic"], r["symbol"]): r["n"] for r in found}

    def rate(which) -> tuple[float, int]:
        toxic, other = (sum(n for (t, x), n in counts.items() if t is is_toxic and which(x)) for is_toxic in (True, False))
        return (toxic + 1) / (toxic + other + 2), toxic + other

    has = lambda mark: lambda x: x // 8 & mark
    lacks = lambda mark: lambda x: not x // 8 & mark
    vague, aimed = (lambda x: x % 8 == THREAT and not x // 8 & AIMED), (lambda x: x % 8 == THREAT and x // 8 & AIMED)
    asked = {"negated": (has(NEGATED), lacks(NEGATED)), "reported": (has(REPORTED), lacks(REPORTED)), "aimed": (has(AIMED), lacks(AIMED)), "vague threat": (vague, aimed)}
    out = {}
    for name, (with_, without) in asked.items():
        (a, n), (b, m) = rate(with_), rate(without)
        n = min(n, m)
        out[name] = float(np.clip((PRIOR_WORDS * FACTORS[name] + n * a / b) / (PRIOR_WORDS + n), *BOUNDS[name]))
    return out


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with an intercept, by damped Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    if not len(y) or y.min() == y.max():
        w[:-1], w[-1] = 1.0, -3.0
        return w
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + 0.05 * w
        h = (a * (p * (1 - p))[:, None]).T @ a + 0.05 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text"):
    """A function that scores the texts of an Arrow column, fitted on labelled rows that aren't held out."""
    lean_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ids = F.broadcast(train_ids(labels, "toxic", train_rows))
    sample = materialize(own.join(ids, "doc_id").select("y", "text"), "labelled")
    lexicon = learn_lexicon(sample)
    lexicon.factors = learn_factors(sample, lexicon)

    def measure(texts: pa.Array, symbols: dict, machine: Machine) -> np.ndarray:
        return np.array([features(t.as_py(), symbols, machine) for t in texts], np.float64).reshape(len(texts), 4)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, machine = lexicon.symbols(), lexicon.machine()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, measure(b.column(1), symbols, machine).T.copy())], ["y", "f0", "f1", "f2", "f3"])

    names = ["y", "f0", "f1", "f2", "f3"]
    rows = sample.mapInArrow(measured, ", ".join(f"{c} double" for c in names)).orderBy(F.xxhash64(*names), *names).limit(2 * train_rows).toPandas().to_numpy(np.float64)
    curve = fit_curve(rows[:, 1:], rows[:, 0])

    def scorer():
        symbols, machine = lexicon.symbols(), lexicon.machine()
        return lambda texts: 1 / (1 + np.exp(-np.clip(measure(texts, symbols, machine) @ curve[:-1] + curve[-1], -30, 30)))

    return scorer


def score_toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    labels: (doc_id, toxic 0/1). Only the text is an input. Null and empty texts have no
    clauses and the least score; without usable labels the starting words alone decide. Rows
    that repeat an id, or have none, are scored each by its own text. A null id is never held out.
    """
    scorer = fit(docs, labels, train_rows, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score(b.column(1)))], ["doc_id", "score"])

    scored = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those predicted toxic, all columns kept. Every row goes or stays by its own text,
    also those that share an id or have none."""
    scorer, at = fit(docs, labels, id_col=id_col, text_col=text_col), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer()
        for b in batches:
            yield b.filter(pa.array(score(b.column(at)) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
