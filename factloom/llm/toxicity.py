"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer, an Aho-Corasick automaton over stems, words and phrases, rewrites a text to a
tape of symbols: insults, violent verbs, targets, subjects, agents, negations, reports, what cancels a negation, commas, colons and
clause ends; runs of other words are cut to as many as any transducer looks back on. Four transducers read the tape one after the other:

* negation marks insults and verbs among the ``SCOPE`` words after a negation, up to a comma or contrast; "not only" negates nothing;
* reported speech marks what follows a report, over a colon too, to the end of the clause; a report close behind a comma (", he said") marks its whole clause;
* agents mark verbs that someone who speaks means to do, or that begin their clause as orders do;
* aim matches what the others have marked: a verb with a target among its next ``VICTIM`` words (before it in languages that put it there), an insult with a target
  at most ``REACH`` words before or ``VICTIM`` after it. It emits the matched patterns with their weights, in the clause they stand in.

``GRAMMAR`` is their composition, derived on the fly: states of the product and symbols to states and actions. So a word counts
through what stands around it, in order: "they beat the record" and "you can kill the process" match nothing.

A document's score is a logistic function of what its clauses emit. The weight of
a pattern is learned around a prior, in proportion to the learned constant: one clause of a pattern that the labelled rows
don't show, such as threats, decides as it would without labels. Insult stems and their weights are learned from labelled documents, those that
are toxic far more often than not; the other word classes are fixed lists. Only
a bounded sample of labelled rows is used for learning, and its words bound the lexicon; scoring covers every
whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Hashable, Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches, table

#: Labelled rows that learning uses, at most: those with the smallest hashes of their ids.
MAX_LABELLED = 20_000
#: Lengths of stems; documents that a term of the lexicon must mark, and its least weight.
STEM_LENGTHS = (4, 5, 6, 7)
MIN_TOXIC_DOCS = 5
MIN_WEIGHT = 3.0
#: Terms that a task counts before it hands its counts on.
MAX_TERMS = 100_000
#: Characters of a text that one step of the automaton reads, and those up to the next clause end.
PIECE = 1 << 20
FOLDS, HELD_OUT = 5, 0

#: Words and phrases (without apostrophes) of the other classes, in the corpus' languages. Victims follow ``THREATS``, may precede ``INFINITIVES``,
#: and are part of ``AIMED``; subjects can be insulted, but aren't a verb's victim. Idioms are ordinary words.
THREATS = "kill hurt destroy crush beat stab shoot".split()
INFINITIVES = "töten schlagen zerstören tuer frapper détruire matar golpear destruir".split()
AIMED = "matarte golpearte destruirte".split()
TARGETS = "you your yourself u ya them dich dein euch te toi vous vos usted ustedes".split()
SUBJECTS = "they du tu tú".split()
AGENTS = "i we gonna go ich wir je nous yo voy vamos".split()
NEGATIONS = "not never no neither nor nicht kein keine nie pas jamais aucun nunca jamás tampoco".split() + ["don t", "isn t", "aren t", "won t", "doesn t", "didn t", "wouldn t"]
ONLY = "only just merely nur seulement solo sólo".split()
CONTRASTS = "but aber sondern mais pero sino".split()
REPORTS = "said says say told wrote claimed quoted called sagte sagt schrieb dit disait écrit dijo dice escribió".split()
IDIOMS = ["beat you to it", "beat yourself up", "kill your darlings", "crush your goals", "shoot you a", "shoot you an", "shoot them a", "shoot them an"]
CLASSES: dict[str, tuple[str, ...]] = {
    word: symbols
    for words, symbols in (
        (THREATS, ("threat",)), (INFINITIVES, ("infinitive",)), (AIMED, ("infinitive", "target")), (TARGETS, ("target",)), (SUBJECTS, ("subject",)), (AGENTS, ("agent",)),
        (NEGATIONS, ("negation",)), (ONLY, ("only",)), (CONTRASTS, ("contrast",)), (REPORTS, ("report",)), (IDIOMS, ("word",)),
    )
    for word in words
}
VERBS = ("threat", "infinitive")
MARKED = ("insult", *VERBS)

WORD = re.compile(r"[^\W\d_]+")
#: Marks on the tape of letters: clause ends; commas, brackets and quotation marks; colons.
END, COMMA, COLON = "\x00", "\x01", "\x02"
CLAUSE_ENDS = re.compile(r"[.!?;\n]")
COMMAS = re.compile(r"[,()\"«»„“”]")

#: Words that a negation reaches, that a target reaches ahead, that a verb or an insult waits for its target, and that a report may stand behind a comma.
SCOPE, REACH, VICTIM, BEHIND = 5, 5, 2, 2
#: As many words as change any state.
WINDOW = max(SCOPE, REACH, VICTIM, BEHIND)


class Symbol(NamedTuple):
    kind: str
    marks: frozenset[str] = frozenset()

    def marked(self, mark: str) -> Symbol:
        return Symbol(self.kind, self.marks | {mark})


def negation(left: int, s: Symbol) -> tuple[int, Symbol]:
    """The state is the number of words that a negation still reaches."""
    if s.kind == "negation":
        return SCOPE, s
    if s.kind in ("end", "colon", "comma", "contrast") or s.kind == "only" and left == SCOPE:
        return 0, s
    return max(0, left - 1), s.marked("negated") if left and s.kind in MARKED else s


def reported(state: tuple[bool, int], s: Symbol) -> tuple[tuple[bool, int], Symbol]:
    """The state is whether a report came before, and how many words one may still stand behind a comma."""
    inside, near = state
    if s.kind == "report":
        return (True, 0), s.marked("behind") if near else s
    if s.kind == "end":
        return (False, 0), s
    if s.kind in ("colon", "target"):
        return (inside, 0), s
    if s.kind == "comma":
        return (inside, BEHIND), s
    return (inside, max(0, near - 1)), s.marked("reported") if inside and s.kind in MARKED else s


def agent(state: str, s: Symbol) -> tuple[str, Symbol]:
    """The state is ``first`` before the clause's first word, ``agent`` after someone who speaks, else ``other``."""
    if s.kind in ("end", "colon"):
        return "first", s
    if s.kind == "agent":
        return "agent", s
    if s.kind == "subject" or state == "first" and s.kind != "comma":
        return "other", s.marked("meant") if s.kind in VERBS else s
    return state, s.marked("meant") if s.kind in VERBS and state == "agent" else s


class Aim(NamedTuple):
    near: int = 0  # words that the last target or subject still reaches
    victim: bool = False  # whether it was a target
    verb: str | None = None  # what a verb that waits for its victim makes, and for how many words
    wait: int = 0
    held: int = 0  # words that an insult still waits for its target


def pattern(s: Symbol, otherwise: str) -> str:
    return "reported" if "reported" in s.marks else "negated" if "negated" in s.marks else otherwise


def aim(at: Aim, s: Symbol) -> tuple[Aim, tuple[str, ...]]:
    """Emits actions: a pattern takes the weight at hand, ``hold`` keeps an insult's weight until ``aim`` or ``settle`` makes it
    aimed or plain, ``behind`` makes the whole clause reported, ``end`` ends it."""
    drop = ("settle",) if at.held else ()
    if s.kind in ("end", "colon"):
        return Aim(), (*drop, "end")
    if s.kind in ("comma", "contrast"):
        return Aim(max(0, at.near - (s.kind == "contrast")), at.victim), drop
    wait = max(0, at.wait - 1)
    verb = at.verb if wait else None
    if s.kind == "subject":
        return Aim(REACH, False, verb, wait), ("aim",) if at.held else ()
    if s.kind == "target":
        return Aim(REACH, True), ((at.verb,) if at.verb else ()) + (("aim",) if at.held else ())
    near, held = max(0, at.near - 1), max(0, at.held - 1)
    late = drop if not held else ()
    if s.kind == "insult":
        found = pattern(s, "aimed" if at.near else "hold")
        return Aim(near, at.victim, verb, wait, VICTIM if found == "hold" else 0), (*drop, found)
    if s.kind in VERBS:
        made = pattern(s, "threat" if "meant" in s.marks else "harm")
        if s.kind == "infinitive" and at.victim and at.near >= REACH - VICTIM:
            return Aim(near, True, None, 0, held), (*late, made)
        return Aim(near, at.victim, made, VICTIM, held), late
    return Aim(near, at.victim, verb, wait, held), late + (("behind",) if "behind" in s.marks else ())


class Composition:
    """The product of the transducers, whose states are numbered as they are first reached."""

    def __init__(self):
        self.states: list[tuple[Hashable, ...]] = [(0, (False, 0), "first", Aim())]
        self.numbers = {self.states[0]: 0}
        self.rows: list[dict[str, tuple[int, tuple[str, ...]]]] = [{}]

    def derive(self, number: int, kind: str) -> tuple[int, tuple[str, ...]]:
        s, to = Symbol(kind), []
        for step, state in zip((negation, reported, agent), self.states[number], strict=False):
            state, s = step(state, s)
            to.append(state)
        last, does = aim(self.states[number][-1], s)
        state = (*to, last)
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.rows.append({})
        self.rows[number][kind] = self.numbers[state], does
        return self.rows[number][kind]


GRAMMAR = Composition()
#: Patterns and their prior weights; what a threat, or harm without someone who means it, weighs.
PATTERNS = {"plain": 1.0, "aimed": 1.5, "negated": 0.25, "reported": 0.25, "threat": 1.5, "harm": 0.25}
VERB_WEIGHT = 4.0
#: Prior of the constant, and features: for each pattern its weight and its number of clauses, both as logarithms.
BIAS = -2.0
N_FEATURES = 2 * len(PATTERNS)
PRIOR = np.array([BIAS] + [x for w in PATTERNS.values() for x in (w, w)])


def lexical(stems: dict[str, float]) -> ahocorasick.Automaton:
    """The automaton of word beginnings: " stem" hits any word with that
    beginning, " word " a whole word or phrase. A hit has its fixed symbols or none, its weight as an insult, and its length."""
    found = {f" {w} ": (c, 0.0) for w, c in CLASSES.items()}
    for s, weight in stems.items():  # a whole word of the lexicon ends in a space
        found[f" {s}"] = (found.get(f" {s}", ((),))[0], weight)
    a = ahocorasick.Automaton()
    for key, (symbols, weight) in found.items():
        a.add_word(key, (symbols, weight, len(key)))
    a.make_automaton()
    return a


#: Everything but letters becomes a space, or a mark between spaces. Single spaces, the most of it, stay as they are.
NOT_WORD = re.compile(r"[\W\d_]{2,}|[^\w ]|[\d_]")


def _spaced(m: re.Match) -> str:
    between = m[0]
    if CLAUSE_ENDS.search(between):
        return f" {END} "
    return f" {COLON} " if ":" in between else f" {COMMA} " if COMMAS.search(between) else " "


def _words(part: str) -> list[str]:
    return ["word"] * min(WINDOW, len(part.split()))


def _soft(part: str) -> list[str]:
    """What stands between commas; of the middle only the number of words matters."""
    first, *rest = part.split(COMMA)
    if not rest:
        return _words(first)
    return [*_words(first), "comma", *_words(" ".join(rest[:-1])), "comma", *_words(rest[-1])]


def gap(part: str) -> list[str]:
    """The symbols of a stretch without hits: of clauses that lie wholly in it, nothing is left but their end."""
    for mark, symbol in ((END, "end"), (COLON, "colon")):
        first, *rest = part.split(mark)
        if rest:
            return [*gap(first), symbol, *gap(rest[-1])]
    return _soft(part)


def tape(text: str, automaton: ahocorasick.Automaton) -> Iterator[tuple[str, float]]:
    """The symbols of a text, in order, with weights. A word gives its fixed symbols, then the lexicon's hit of the
    largest weight; of phrases that begin at one place the longest counts, and hides what begins inside it. Pieces end where clauses do, and those without an insult or a verb give none."""
    low = text.lower()
    at = 0
    while at < len(low):
        stop = CLAUSE_ENDS.search(low, at + PIECE)
        end = stop.end() if stop else len(low)
        piece = f" {NOT_WORD.sub(_spaced, low[at:end])} "
        at = end
        classes: dict[int, tuple[int, tuple[str, ...]]] = {}
        insults: dict[int, float] = {}
        matter = False
        for last, (symbols, weight, n) in automaton.iter(piece):
            start = last - n + 1
            if symbols and n > classes.get(start, (0,))[0]:
                classes[start] = n, symbols
                matter |= symbols[0] in VERBS
            if weight > insults.get(start, 0.0):
                insults[start] = weight
        if not matter and not insults:
            continue
        done = 0
        for start in sorted({*classes, *insults}):
            if start < done - 1:
                continue
            for symbol in gap(piece[done:start]):
                yield symbol, 0.0
            n, symbols = classes.get(start, (0, ()))
            for symbol in symbols:
                yield symbol, 0.0
            if start in insults and symbols != ("word",):
                yield "insult", insults[start]
            done = start + n if n else piece.index(" ", start + 1)
        for symbol in gap(piece[done:]):
            yield symbol, 0.0
        yield "end", 0.0


def clauses(text: str | None, automaton: ahocorasick.Automaton) -> Iterator[tuple[str, float]]:
    """(pattern, weight) of what each clause matches, one of each pattern a clause."""
    rows, derive = GRAMMAR.rows, GRAMMAR.derive
    state, held, behind = 0, 0.0, False
    sums: dict[str, float] = {}
    for symbol, weight in tape(text or "", automaton):
        state, does = rows[state].get(symbol) or derive(state, symbol)
        for what in does:
            if what == "hold":
                held = weight
            elif what == "end":
                if behind and sums:
                    sums = {"reported": sum(sums.values())}
                yield from sums.items()
                sums, behind = {}, False
            elif what == "behind":
                behind = True
            elif what in ("settle", "aim"):
                kind = "plain" if what == "settle" else "aimed"
                sums[kind] = sums.get(kind, 0.0) + held
            else:
                sums[what] = sums.get(what, 0.0) + (weight if symbol == "insult" else VERB_WEIGHT)


def features(text: str | None, automaton: ahocorasick.Automaton) -> list[float]:
    """For each pattern, the weight that its clauses emit and their number, as log(1 + x)."""
    sums = {p: [0.0, 0] for p in PATTERNS}
    for found, weight in clauses(text, automaton):
        sums[found][0] += weight
        sums[found][1] += 1
    return [math.log1p(x) for p in PATTERNS for x in sums[p]]


def terms_of(text: str | None) -> set[str]:
    """The words (closed by a space) and stems of a text."""
    words = {w for w in WORD.findall((text or "").lower()) if len(w) > 2}
    return {w + " " for w in words} | {w[:n] for w in words for n in STEM_LENGTHS if len(w) >= n}


class Model:
    def __init__(self, stems: dict[str, float], weights: np.ndarray):
        self.stems, self.weights, self._automaton = stems, weights, None

    def __getstate__(self):
        return self.stems, self.weights

    def __setstate__(self, state):
        self.stems, self.weights = state
        self._automaton = None

    @property
    def automaton(self):
        if self._automaton is None:
            self._automaton = lexical(self.stems)
        return self._automaton

    def score(self, text: str | None) -> float:
        z = float(self.weights[0] + np.dot(self.weights[1:], features(text, self.automaton)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def weigh(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Log-odds weights of the terms that mark toxic documents."""
    out = {}
    for t, k in toxic.items():
        if k >= MIN_TOXIC_DOCS:
            w = math.log((k + 0.5) / (n_toxic + 1)) - math.log((clean.get(t, 0) + 0.5) / (n_clean + 1))
            if w >= MIN_WEIGHT:
                out[t] = w
    return dict(sorted(out.items()))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 100, prior: np.ndarray | None = None) -> np.ndarray:
    """Weights, the constant first, of a logistic regression that is penalised for leaving ``prior`` (else 0). Newton steps
    are halved until they lower the loss, so classes that part cleanly don't throw them off."""
    x = np.hstack([np.ones((len(x), 1)), x])
    penalty = np.array([1e-6] + [ridge] * (x.shape[1] - 1))
    centre = np.zeros(x.shape[1]) if prior is None else prior
    loss = lambda w: np.logaddexp(0, x @ w).sum() - y @ (x @ w) + 0.5 * (penalty * (w - centre)) @ (w - centre)
    w = centre.copy()
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * (w - centre))
        scale = 1.0
        while scale > 1e-6 and not loss(w + scale * step) < now:
            scale /= 2
        if scale <= 1e-6:
            break
        w = w + scale * step
        now = loss(w)
        if np.abs(scale * step).max() < 1e-8:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the patterns. Their priors were made for the constant ``BIAS``: where the one that is learned lies lower, they grow in
    proportion, so a clause of a pattern that no row shows still decides."""
    constant = logistic(x, y, prior=PRIOR)[0]
    prior = PRIOR * max(1.0, constant / BIAS)
    weights = logistic(x, y, prior=prior)
    unseen = np.concatenate([[False], ~x.any(axis=0)])
    return np.where(unseen, PRIOR * max(1.0, weights[0] / BIAS), weights)


def held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from rows of ``labels`` (doc_id, toxic) that aren't held out.

    Rows with a null id or label are left out; an id that is labelled more than once
    counts with each of its labels, and of documents that repeat an id the one with the first text in order counts.
    Without a labelled row of either class the lexicon is empty and all patterns keep their priors.
    """
    spark = docs.sparkSession
    small_batches(spark)
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    some = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(MAX_LABELLED)
    # bounded by MAX_LABELLED rows of two numbers
    found = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sample = Scratch(spark, "toxicity").write(found.select("text", "toxic").repartition(4 * int(spark.sparkContext.defaultParallelism)), "sample")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, Counter] = {0: Counter(), 1: Counter()}
        seen = [0, 0]

        def flush() -> pd.DataFrame:
            terms = [*found[0], *(t for t in found[1] if t not in found[0])]
            out = pd.DataFrame({"term": ["", *terms], "toxic": [seen[1], *(found[1].get(t, 0) for t in terms)], "clean": [seen[0], *(found[0].get(t, 0) for t in terms)]})
            found[0].clear()
            found[1].clear()
            seen[:] = [0, 0]
            return out

        for b in batches:
            for text, y in zip(b["text"], b["toxic"], strict=True):
                found[int(y > 0)].update(terms_of(text))
                seen[int(y > 0)] += 1
                if len(found[0]) + len(found[1]) >= MAX_TERMS:
                    yield flush()
        yield flush()

    counted = sample.mapInPandas(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counted = Scratch(spark, "toxicity").write(counted.where((F.col("term") == "") | (F.col("toxic") >= MIN_TOXIC_DOCS)), "terms")
    n_toxic, n_clean = next(((r["toxic"], r["clean"]) for r in counted.where(F.col("term") == "").collect()), (0, 0))
    odds = F.log((F.col("toxic") + 0.5) / (F.col("clean") + 0.5))
    least = MIN_WEIGHT + math.log((n_toxic + 1) / (n_clean + 1)) - 1e-6
    # terms that MIN_TOXIC_DOCS of the toxic rows hold and hardly any clean ones: the sample bounds them, not the corpus
    marks = counted.where((F.col("term") != "") & (odds >= least)).collect()
    stems = weigh({r["term"]: r["toxic"] for r in marks}, {r["term"]: r["clean"] for r in marks}, n_toxic, n_clean)
    model = Model(stems, PRIOR.copy())
    if not n_toxic or not n_clean:
        return model
    shared = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [features(t, shared.value.automaton) for t in b["text"]]
            yield pd.DataFrame({"x": rows, "y": (b["toxic"] > 0).astype("int64")})

    seen = sample.mapInPandas(measure, "x array<double>, y long").groupBy("x", "y").count().collect()  # at most MAX_LABELLED rows
    x = np.array([r["x"] for r in seen])
    y = np.array([r["y"] for r in seen], float)
    n = np.array([r["count"] for r in seen])
    order = np.lexsort([*x.T, y])
    model.weights = fit(np.repeat(x[order], n[order], axis=0), np.repeat(y[order], n[order]))
    return model


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row's whole text; null and empty texts get the score of no match."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [shared.value.score(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values, pa.float64())], names=["id", "score"])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(each, f"id {kind}, score double")


def apply(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose texts score below ``threshold``. The model is
    learned from the rows of ``docs`` that are labelled."""
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([shared.value.score(t.as_py()) < threshold for t in b.column("text")], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op5(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return scores(docs, model).select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
