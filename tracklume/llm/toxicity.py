"""Toxicity by a weighted finite-state pattern grammar.

The tokens of a clause are read as marks: insult, threat, target, negation,
report, or other.  Four transducers read the marks, each a table of weighted
arcs: an insult counts more where the clause has a target, a threat counts
only where a target follows it, and both count less shortly after a negation
or in reported speech.  Where a weight depends on what is still to come, a
transducer starts in a state for either case and accepts in the right one
only.  Their composition is one table; a clause's score is the largest sum of
weights over its accepting paths.  The unit that is scored is the matched
clause; a text's score is a logistic of the sum over its clauses.

Insults are marked by a further transducer over characters, an automaton of
weighted stems.  ``learn`` finds them, and the logistic's two numbers, in a
bounded sample of labelled texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklume.llm import text as T
from tracklume.llm.scratch import Scratch

#: Labelled texts that a grammar is learned from, at most: those of the least hashes of their ids.
MAX_TRAIN = 20_000
STEM_CHARS = range(4, 13)
#: Log odds that a stem must have to count as an insult.
LEAST_ODDS = 3.5
#: Slope, and bias below zero, from which on a fitted logistic replaces the default one.
LEAST_FIT = 1e-6

# Words of the transducers, in English, German, French and Spanish.
THREATS = frozenset("kill murder destroy hurt beat burn stab shoot hang töten umbringen verletzen tuer frapper brûler matar golpear quemar".split())
TARGETS = frozenset("you your yours he him she her they them these those people du dich dir ihr euch er sie tu toi te vous il elle ils elles tú usted ustedes él ella ellos ellas".split())
NEGATIONS = frozenset("not never no isn't aren't wasn't don't nicht kein keine nie pas jamais nunca jamás".split())
REPORTS = frozenset("said says say told called calls wrote quoted quote reported claimed sagte sagt schrieb dit disait écrit dijo dice escribió".split())
NEGATION_REACH = 3
TARGETED, UNTARGETED, NEGATED, REPORTED = 1.5, 1.0, 0.4, 0.5

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CLAUSE_END = re.compile(r"[.!?;:\n]")


@dataclass
class Grammar:
    """stems: word beginnings and their weights; bias, slope: of the logistic over log1p of a text's sum."""

    stems: dict[str, float] = field(default_factory=dict)
    bias: float = -2.0
    slope: float = 2.0

    def automaton(self):
        """The insult and threat words as one Aho-Corasick automaton, with which clauses that can match are found."""
        import ahocorasick

        found = ahocorasick.Automaton()
        for word in THREATS:
            found.add_word(word, ("threat", len(word), 1.0))
        for stem, weight in self.stems.items():
            found.add_word(stem, ("insult", len(stem), weight))
        found.make_automaton()
        return found


MARKS = ("insult", "threat", "target", "negation", "report", "other")


class Transducer(NamedTuple):
    """starts and accepting states; arcs: of (state, mark) the next states, each with the factor of the mark's weight."""

    starts: tuple
    accepts: frozenset
    arcs: dict[tuple, tuple[tuple[object, float], ...]]


def _table(states: Iterable, step: Callable) -> dict:
    return {(state, mark): arcs for state in states for mark in MARKS if (arcs := step(state, mark))}


def targeted() -> Transducer:
    """Insults weigh more where a target is in the clause: states for one to come, for one seen, and for none."""

    def step(state: str, mark: str):
        if mark == "target":
            return (("seen", 1.0),) if state != "none" else ()
        return ((state, (UNTARGETED if state == "none" else TARGETED) if mark == "insult" else 1.0),)

    return Transducer(("coming", "none"), frozenset({"seen", "none"}), _table(("coming", "seen", "none"), step))


def threatening() -> Transducer:
    """Threats weigh nothing unless a target follows: states for one that follows, and for none any more."""

    def step(state: str, mark: str):
        if mark == "target":
            return (("follows", 1.0), ("ended", 1.0)) if state == "follows" else ()
        return ((state, 0.0 if mark == "threat" and state == "ended" else 1.0),)

    return Transducer(("follows", "ended"), frozenset({"ended"}), _table(("follows", "ended"), step))


def negated() -> Transducer:
    """What stands within NEGATION_REACH words after a negation weighs less: the state is how many of them are left."""
    reach = range(NEGATION_REACH + 1)
    return Transducer((0,), frozenset(reach), _table(reach, lambda left, mark: ((NEGATION_REACH if mark == "negation" else max(0, left - 1), NEGATED if left else 1.0),)))


def reported() -> Transducer:
    """What stands after a verb of speech weighs less."""
    states = (False, True)
    return Transducer((False,), frozenset(states), _table(states, lambda said, mark: ((said or mark == "report", REPORTED if said else 1.0),)))


def compose(a: Transducer, b: Transducer) -> Transducer:
    """Both over the same marks: pairs of states, products of factors."""
    arcs = {}
    for (s, mark), ours in a.arcs.items():
        for (t, other), theirs in b.arcs.items():
            if mark == other:
                arcs[(s, t), mark] = tuple(((x, y), f * g) for x, f in ours for y, g in theirs)
    return Transducer(tuple(product(a.starts, b.starts)), frozenset(product(a.accepts, b.accepts)), arcs)


GRAMMAR = reduce(compose, (targeted(), threatening(), negated(), reported()))


def clause_score(tokens: list[str], insults: dict[int, float], threats: set[int]) -> float:
    """The weight of a clause under the composed transducers; insults and threats hold the places of marked tokens."""
    paths = dict.fromkeys(GRAMMAR.starts, 0.0)
    for i, token in enumerate(tokens):
        weight = insults.get(i, float(i in threats))
        if weight:
            mark = "insult" if i in insults else "threat"
        else:
            mark = "negation" if token in NEGATIONS else "report" if token in REPORTS else "target" if token in TARGETS else "other"
        after: dict[tuple, float] = {}
        for state, total in paths.items():
            for to, factor in GRAMMAR.arcs.get((state, mark), ()):
                after[to] = max(after.get(to, 0.0), total + factor * weight)
        paths = after
    return max(total for state, total in paths.items() if state in GRAMMAR.accepts)


def text_score(text: str, automaton) -> float:
    """The sum of the scores of a text's clauses; only clauses with an insult or a threat are walked."""
    low = text.lower()
    hits: dict[int, tuple[str, float]] = {}
    for end, (kind, size, weight) in automaton.iter(low):
        start = end - size + 1
        if start and low[start - 1].isalpha() or kind == "threat" and end + 1 < len(low) and low[end + 1].isalpha():
            continue
        if kind == "insult" and weight > hits.get(start, ("", 0.0))[1]:
            hits[start] = kind, weight
        elif kind == "threat":
            hits.setdefault(start, (kind, weight))
    total, done = 0.0, -1
    for start in sorted(hits):
        if start < done:
            continue
        begin = done if done > 0 else 0
        for m in _CLAUSE_END.finditer(low, begin, start):
            begin = m.end()
        stop = m.start() if (m := _CLAUSE_END.search(low, start)) else len(low)
        spans = list(_WORD.finditer(low, begin, stop))
        insults = {i: hits[m.start()][1] for i, m in enumerate(spans) if hits.get(m.start(), ("",))[0] == "insult"}
        threats = {i for i, m in enumerate(spans) if hits.get(m.start(), ("",))[0] == "threat"}
        total += clause_score([m[0] for m in spans], insults, threats)
        done = max(stop, start + 1)
    return total


def scores(texts: DataFrame, grammar: Grammar, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``texts``, without the text column unless ``keep_text``, with ``score`` in [0, 1]: the higher, the likelier toxic.  Null and empty texts have the score of no match; a ``score`` of its own is replaced."""
    kept = [x for x in texts.columns if x not in ("score", *(() if keep_text else (text,)))]
    place = kept.index(text) if keep_text else len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = grammar.automaton()
        for batch in batches:
            sums = np.array([text_score(x.as_py() or "", automaton) for x in batch.column(place)], float)
            values = 1 / (1 + np.exp(-(grammar.bias + grammar.slope * np.log1p(sums))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(values)], names=[*kept, "score"])

    narrow = texts.select(*kept) if keep_text else texts.select(*kept, text)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*kept).schema.fields), "score double"])
    return narrow.mapInArrow(run, schema)


def _stems(text: str) -> set[str]:
    found = set()
    for word in set(_WORD.findall(text.lower())):
        found.update(word[:k] for k in STEM_CHARS if k <= len(word))
    return found


def _stem_counts(texts: DataFrame, only: frozenset[str] | None) -> DataFrame:
    """(stem, n): texts that have a stem, counted batch by batch and then over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[str] = Counter()
            for value in batch.column(0):
                found = _stems(value.as_py() or "")
                counts.update(found if only is None else found & only)
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["stem", "n"])

    return texts.select("text").mapInArrow(run, "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n"))


def choose_stems(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Stems that mark toxic texts, frequent there and all but absent elsewhere; of nested ones that of most evidence."""
    share = n_toxic / (n_toxic + n_clean)
    sure = {}
    for stem, a in toxic.items():
        b = clean.get(stem, 0)
        odds = math.log((a + 0.5) / (n_toxic + 1)) - math.log((b + 0.5) / (n_clean + 1))
        # The log-likelihood ratio against a stem that doesn't care about labels must beat as many tries as there are stems.
        evidence = a * math.log(a / (a + b) / share) + (b * math.log(b / (a + b) / (1 - share)) if b else 0.0)
        if odds >= LEAST_ODDS and evidence >= math.log(len(toxic)) + 3:
            sure[stem] = odds, evidence
    chosen: dict[str, float] = {}
    taken: set[str] = set()  # chosen stems and all that begin one
    for stem in sorted(sure, key=lambda x: (-sure[x][1], -len(x), x)):
        begins = [stem[:k] for k in range(STEM_CHARS[0], len(stem) + 1)]
        if stem not in taken and not any(x in chosen for x in begins):
            chosen[stem] = sure[stem][0]
            taken.update(begins)
    return chosen


def learn(texts: DataFrame, labels: DataFrame, key: str, label: str, allowed) -> Grammar:
    """A grammar from at most MAX_TRAIN labelled texts that ``allowed`` (a condition on ``labels``) lets in.

    The sample is written once and read three times: the stems of its toxic
    texts, the counts of those in the others, and the sums that the logistic is
    fitted to.  Without toxic or without clean texts the default grammar stays; where
    matches don't tell the labels apart, the default logistic.  A text that any
    of its labels calls toxic is; repeated texts count once.
    """
    spark = texts.sparkSession
    scratch = Scratch(spark, "toxicity")
    usable = labels.where(allowed & F.col(label).isNotNull() & F.col(key).isNotNull())
    sample = usable.groupBy(key).agg(F.max(label).alias("_y")).orderBy(F.xxhash64(key), key).limit(MAX_TRAIN)
    train = scratch.write(texts.select(key, "text").join(F.broadcast(sample), key).groupBy("text").agg(F.max("_y").alias("_y")).select("_y", "text"), "train")
    sizes = {int(r["_y"] > 0): r["n"] for r in train.groupBy("_y").count().withColumnRenamed("count", "n").collect()}
    if len(sizes) < 2:
        scratch.drop()
        return Grammar()
    least = max(3, round(0.002 * sizes[1]))  # fewer can't be told from chance
    toxic = {r["stem"]: r["n"] for r in _stem_counts(train.where("_y > 0"), None).where(F.col("n") >= least).collect()}
    clean = {r["stem"]: r["n"] for r in _stem_counts(train.where("_y <= 0"), frozenset(toxic)).collect()}
    grammar = Grammar(choose_stems(toxic, clean, sizes[1], sizes[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = grammar.automaton()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([text_score(x.as_py() or "", automaton) for x in batch.column(1)], pa.float64())], names=["y", "total"])

    seen = train.select(F.col("_y").cast("double").alias("y"), "text").mapInArrow(run, "y double, total double").toPandas()
    bias, slope = fit(np.log1p(seen["total"].to_numpy()), (seen["y"] > 0).to_numpy(float))
    if slope > LEAST_FIT and bias < -LEAST_FIT:  # else matches say nothing here, and a text without any must not be found toxic
        grammar.bias, grammar.slope = bias, slope
    scratch.drop()
    return grammar


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Bias and slope of a logistic regression, by Newton steps; both classes weigh the same."""
    design = np.stack([np.ones_like(x), x], 1)
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
    beta = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (weight * (y - p)) - ridge * np.array([0, 1]) * beta
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge * np.diag([1e-3, 1])
        step = np.linalg.solve(curve, slope)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])
