"""Toxicity by a weighted finite-state pattern grammar.

Small transducers over word classes (insult, threat, target, negation, reported speech) are composed into one
deterministic machine that rewrites a clause into outcomes: an asserted insult, one aimed at somebody, a negated or
reported one, a threat with or without a target. Outcome counts of the whole text enter a logistic weighting. The word
classes hold a few fixed English words; further insults (words, and stems that many words begin with) and the
weights are learned from a bounded sample of labelled rows.

Defined results: null and empty texts match nothing and get the score of a text without matches; a null label or a
label without its document teaches nothing; repeated documents get their score each; several labels of one document
count as its largest. Without labels of both kinds the fixed words and prior weights are used.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm.common import carried, ddl, narrow, released
from vitalgrid.session import stage

# English seed words of the classes.
SEEDS = {
    "insult": "idiot moron stupid loser scum trash worthless pathetic disgusting clown imbecile cretin vermin filth".split(),
    "threat": "kill hurt destroy punch stab shoot strangle beat".split(),
    "target": "you your yourself u he she him her they them these those".split(),
    "negation": "not no never isn't aren't wasn't don't doesn't didn't nobody without".split(),
    "report": "said says say called calls claimed claims quoted wrote reported according".split(),
}
# Labelled rows of each kind that are learned from at most.
SAMPLE = 4000
# Learned insults kept at most (the model is broadcast with the task).
TERMS = 4000
STEMS = range(4, 9)
OUTCOMES = ("insult", "aimed", "denied", "told", "threat", "threat_aimed", "threat_off")
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;\n]")
# Words between two classes after which they no longer belong together.
REACH = 6


@dataclass
class Transducer:
    """Deterministic: (state, symbol) -> (state, symbol); what has no rule passes and keeps the state."""

    rules: dict[tuple[str, str], tuple[str, str]] = field(default_factory=dict)

    def step(self, state: str, symbol: str) -> tuple[str, str]:
        return self.rules.get((state, symbol), (state, symbol))


def _flagger(trigger: str, kinds: list[str], flag: str, ends: tuple[str, ...]) -> Transducer:
    """After ``trigger`` and until one of ``ends``, the given kinds get a flag."""
    rules = {("", trigger): ("on", trigger), ("on", trigger): ("on", trigger)}
    rules |= {("on", end): ("", end) for end in ends}
    rules |= {("on", kind): ("on", f"{kind}+{flag}") for kind in kinds}
    return Transducer(rules)


def grammar() -> tuple[list[Transducer], list[str]]:
    """The cascade and its input alphabet; each transducer reads what the one before writes."""
    kinds = ["insult", "threat"]
    report = _flagger("report", kinds, "told", ("stop",))
    told = kinds + [f"{k}+told" for k in kinds]
    negate = _flagger("negation", told, "denied", ("stop", "far"))
    denied = told + [f"{k}+denied" for k in told]
    aim = _flagger("target", denied, "aimed", ("stop", "far"))
    return [report, negate, aim], ["insult", "threat", "target", "negation", "report", "stop", "far"]


def compose(cascade: list[Transducer], alphabet: list[str]) -> dict[tuple[int, str], tuple[int, str | None]]:
    """One machine over numbered states whose output is an outcome or nothing."""
    states = list(product(("", "on"), repeat=len(cascade)))
    number = {s: k for k, s in enumerate(states)}
    out = {}
    for state in states:
        for symbol in alphabet:
            after, written = [], symbol
            for machine, s in zip(cascade, state, strict=True):
                s, written = machine.step(s, written)
                after.append(s)
            kind, *flags = written.split("+")
            outcome = None
            if kind in ("insult", "threat"):
                off = "told" if "told" in flags else "denied" if "denied" in flags else ""
                aimed = "aimed" in flags
                if kind == "insult":
                    outcome = off or ("aimed" if aimed else "insult")
                else:
                    outcome = "threat_off" if off else "threat_aimed" if aimed else "threat"
            out[number[state], symbol] = (number[tuple(after)], outcome)
    return out


@dataclass
class Model:
    words: dict[str, str]
    stems: list[str]
    weights: list[float]

    def prepare(self) -> Scorer:
        return Scorer(self)


class _Classes(dict):
    """Word -> class, worked out once per word; bounded."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.words, self.stems = model.words, set(model.stems)

    def __missing__(self, word: str) -> str | None:
        kind = "stop" if word in ".!?;\n" else self.words.get(word)
        if kind is None and any(word[:k] in self.stems for k in STEMS if k < len(word)):
            kind = "insult"
        if len(self) > 500_000:
            self.clear()
        self[word] = kind
        return kind


class Scorer:
    """Applies a model to texts (one per task)."""

    def __init__(self, model: Model) -> None:
        self.classes = _Classes(model)
        self.machine = compose(*grammar())
        self.weights = np.array(model.weights)

    def outcomes(self, text: str) -> Counter:
        """Outcome counts of a whole text."""
        found: Counter = Counter()
        state, before = 0, 0
        kinds = list(map(self.classes.__getitem__, _TOKEN.findall(text.lower())))
        for k in [k for k, kind in enumerate(kinds) if kind]:
            if k - before > REACH:
                state, _ = self.machine[state, "far"]
            state, outcome = self.machine[state, kinds[k]]
            if outcome:
                found[outcome] += 1
            before = k
        return found

    def features(self, text: str) -> list[float]:
        return features(self.outcomes(text))

    def score(self, text: str) -> float:
        z = float(np.dot(self.weights, self.features(text)))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def features(found: Counter) -> list[float]:
    """Constant, unary counts of asserted matches (one, two, three, more), and counts of each outcome."""
    asserted = found["insult"] + found["aimed"] + found["threat"] + found["threat_aimed"]
    steps = [float(asserted >= k) for k in (1, 2, 3)] + [math.log1p(asserted)]
    return [1.0, *steps, *(math.log1p(found[o]) for o in OUTCOMES if o != "insult")]


_PRIOR = [-4.0, 2.0, 3.0, 1.0, 0.5, 0.5, -0.5, -0.5, 0.0, 1.0, -0.5]


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weighted logistic regression by Newton steps, drawn towards the prior weights."""
    prior = np.array(_PRIOR)
    beta = prior.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (w * (y - p)) - ridge * (beta - prior)
        curve = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(curve, slope)
        beta = beta + step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def _terms(text: str) -> set[str]:
    words = set(_TOKEN.findall(text.lower()))
    return words | {w[:k] + "*" for w in words for k in STEMS if k < len(w)}


def held_out(doc_id: str | Column) -> Column:
    """Rows that are never learned from."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample: int = SAMPLE, terms: int = TERMS,
) -> Model:
    """Fit classes and weights on at most ``sample`` labelled rows of each kind, chosen by a hash of their id."""
    y = F.col(label_col).cast("int")
    usable = labels.where(y.isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    usable = usable.groupBy(F.col(id_col).alias("lid")).agg(F.max(y).alias("y"))
    totals = {r["y"]: r["count"] for r in usable.groupBy("y").count().collect()}
    words = {w: kind for kind, own in SEEDS.items() for w in own}
    if len(totals) < 2:
        return Model(words, [], _PRIOR)
    # The sample is bounded by its parameter, so it may be broadcast.
    picked = None
    for kind in (0, 1):
        own = usable.where(F.col("y") == kind).orderBy(F.xxhash64("lid"), "lid").limit(sample)
        picked = own if picked is None else picked.union(own)
    rows = narrow(docs, id_col, text_col)
    chosen = stage(
        rows.join(F.broadcast(picked), F.col("id") == F.col("lid")).where("text is not null")
        .dropDuplicates(["text", "y"]).select("text", "y")
    )
    sizes = {r["y"]: r["count"] for r in chosen.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return Model(words, [], _PRIOR)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(seen)), *(pa.array([v[k] for v in seen.values()], pa.int64()) for k in (0, 1))],
                ["term", "neg", "pos"],
            )

        for batch in batches:
            for text, kind in zip(batch.column("text"), batch.column("y"), strict=True):
                kind = kind.as_py()
                for term in _terms(text.as_py()):
                    seen.setdefault(term, [0, 0])[kind] += 1
                if len(seen) > 300_000:
                    yield out()
                    seen = {}
        if seen:
            yield out()

    # A term counts if its share of toxic rows would be a one-in-ten-million accident at the sample's rate.
    rate = sizes[1] / (sizes[0] + sizes[1])
    share = (F.col("pos") + 1e-9) / (F.col("pos") + F.col("neg") + 2e-9)
    surprise = (F.col("pos") + F.col("neg")) * (
        share * F.log(share / rate) + (1 - share) * F.log((1 - share) / (1 - rate))
    )
    odds = F.log((F.col("pos") + 0.5) / (sizes[1] + 1)) - F.log((F.col("neg") + 0.5) / (sizes[0] + 1))
    learned = (
        chosen.mapInArrow(released(count), "term string, neg long, pos long").groupBy("term")
        .agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).withColumn("odds", odds)
        .where((surprise > 16) & (F.col("odds") > 3)).orderBy(F.desc("pos"), "term").limit(terms).collect()
    )
    stems = [r["term"][:-1] for r in learned if r["term"].endswith("*")]
    words = {r["term"]: "insult" for r in learned if not r["term"].endswith("*") and r["term"].strip(".!?;\n")} | words
    model = Model(words, stems, _PRIOR)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.prepare()
        for batch in batches:
            x = [scorer.features(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("y")], ["x", "y"])

    found = chosen.mapInArrow(released(describe), "x array<double>, y int").collect()  # at most 2 * sample short rows
    x, y_ = np.array([r["x"] for r in found]), np.array([r["y"] for r in found], float)
    weight = np.where(y_ == 1, totals[1] / sizes[1], totals[0] / sizes[0])
    weight = weight / weight.mean()
    return Model(words, stems, fit_logistic(x, y_, weight).tolist())


def score(
    df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()
) -> DataFrame:
    """(id, score, outcome counts, carried row) per row, from the whole text alone."""
    docs = narrow(df, id_col, text_col, carry)
    kept = ["id", *carried(docs)]
    counts = ("insult", "aimed", "denied", "told", "threat", "threat_aimed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.prepare()
        for batch in batches:
            found = [scorer.outcomes(t.as_py() or "") for t in batch.column("text")]
            z = [float(np.dot(scorer.weights, features(f))) for f in found]
            scores = [1 / (1 + math.exp(-max(-40.0, min(40.0, v)))) for v in z]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in kept), pa.array(scores, pa.float64()),
                    *(pa.array([f[c] for f in found], pa.int32()) for c in counts),
                ],
                [*kept, "score", *counts],
            )

    return docs.mapInArrow(released(run), f"{ddl(docs, *kept)}, score double, " + ", ".join(f"{c} int" for c in counts))
