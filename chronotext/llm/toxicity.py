"""Toxicity: a weighted finite-state grammar over clauses, with a lexicon learned from labels.

Words become classes (insult, threat, target, negation, reported speech, other); small weighted
transducers over the classes are composed into one machine that reads a clause and weighs
what matches in it. The lexicon of insults and the weights of the contexts are learned.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chronotext.llm.common import small_batches, texts

#: Labelled rows from which the model is learned: those with the smallest hashes of doc_id.
TRAIN_ROWS = 20_000
#: Lengths of the word beginnings that are tried as stems beside whole words.
STEMS = (4, 5, 6)
#: An entry was seen in this many toxic texts and after as many different words, and its odds are this high.
LEAST_CONTEXTS, LEAST_LOG_ODDS = 6, 2.5
THRESHOLD = 0.3

# English words of the small classes. Insults are learned.
TARGET = frozenset("you your yours u ur they them their he him his she her we us everyone people".split())
NEGATION = frozenset("not no never nobody isn't aren't wasn't don't doesn't didn't won't can't without".split())
REPORT = frozenset("said says say told claimed wrote writes quoted quote reported called".split())
INTENT = frozenset("will gonna going should must".split())
HARM = frozenset("kill hurt destroy beat shoot stab burn crush punish strangle".split())

CLAUSE = re.compile(r"[.!?;:,\n|()\"]+")
WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
CLASSES = ("other", "insult", "target", "negation", "report", "intent", "harm")
#: What a clause can add to: insults alone, with a target, negated, reported, and threats.
FEATURES = ("insult", "targeted", "negated", "reported", "threat")


@dataclass
class Transducer:
    """A weighted finite-state transducer: (state, class) -> (state, output or None, weight).

    A class without its own arc leaves the state as it is and puts out nothing.
    """

    start: object
    arcs: dict = field(default_factory=dict)

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, None, 0.0))

    def states(self):
        return {self.start} | {s for s, _ in self.arcs} | {to for to, _, _ in self.arcs.values()}


def side_by_side(left: Transducer, right: Transducer, combine) -> Transducer:
    """Both read the same clause; ``combine`` makes one output of both outputs and states; weights add."""
    machine = Transducer((left.start, right.start))
    waiting, seen = [machine.start], {machine.start}
    while waiting:
        state = waiting.pop()
        for symbol in CLASSES:
            one, out_one, weight_one = left.step(state[0], symbol)
            two, out_two, weight_two = right.step(state[1], symbol)
            to = one, two
            machine.arcs[state, symbol] = to, combine(out_one, out_two, to), weight_one + weight_two
            if to not in seen:
                seen.add(to)
                waiting.append(to)
    return machine


def grammar() -> Transducer:
    """The composition: where a clause stands (targeted, negated, reported) decides what a match adds to."""
    insult = Transducer("any", {("any", "insult"): ("any", "insult", 1.0)})
    target = Transducer("none", {("none", "target"): ("aimed", None, 0.0)})
    # A negation reaches over the next three other words, a report to the end of its clause.
    negation = Transducer("plain", {(s, "negation"): (3, None, 0.0) for s in ("plain", 1, 2, 3)})
    for left in (1, 2, 3):
        for symbol in ("other", "target"):
            negation.arcs[left, symbol] = (left - 1 or "plain", None, 0.0)
        negation.arcs[left, "insult"] = ("plain", "negated", 0.0)
    report = Transducer("direct", {("direct", "report"): ("told", None, 0.0)})
    threat = Transducer("calm", {("calm", "intent"): ("meant", None, 0.0), ("meant", "harm"): ("harm", None, 0.0), ("harm", "target"): ("calm", "threat", 1.0)})

    def aimed(found, _, state):
        return "targeted" if found and state[1] == "aimed" else found

    def negated(found, marked, _):
        return "negated" if found and marked else found

    def reported(found, _, state):
        return "reported" if found and state[1] == "told" else found

    machine = side_by_side(insult, target, aimed)
    machine = side_by_side(machine, negation, negated)
    machine = side_by_side(machine, report, reported)
    return side_by_side(machine, threat, lambda found, threatened, _: threatened or found)


GRAMMAR = grammar()


_FIXED = {w: (name, 0.0) for name, words in (("harm", HARM), ("intent", INTENT), ("report", REPORT), ("negation", NEGATION), ("target", TARGET)) for w in words}
_OTHER = "other", 0.0
#: Words whose classes a task keeps from one text to the next.
KEPT_WORDS = 200_000


def word_class(word: str, lexicon: dict[str, float]) -> tuple[str, float]:
    """The class of a word, and how strongly it is an insult: by the whole word, else by its longest stem."""
    for entry in (word, *(word[:n] + "*" for n in reversed(STEMS) if len(word) >= n)):
        if entry in lexicon:
            return "insult", lexicon[entry]
    return _FIXED.get(word, _OTHER)


def features(text: str, lexicon: dict[str, float], kept: dict | None = None) -> list[float]:
    """What the grammar matches in the clauses of a whole text, as log(1 + sum) for each feature.

    ``kept`` holds the classes of words seen before, for the same lexicon.
    """
    found = dict.fromkeys(FEATURES, 0.0)
    text = text.lower()
    classes = {} if kept is None else kept
    if len(classes) > KEPT_WORDS:
        classes.clear()
    some = False
    for word in set(WORD.findall(text)):
        symbol = classes.get(word)
        if symbol is None:
            symbol = classes[word] = word_class(word, lexicon)
        if symbol is not _OTHER and symbol[0] in ("insult", "harm"):
            some = True
    if some:
        for clause in CLAUSE.split(text):
            words = [classes.get(w) or word_class(w, lexicon) for w in WORD.findall(clause)]
            if not any(c in ("insult", "harm") for c, _ in words):
                continue
            state = GRAMMAR.start
            for symbol, strength in words:
                state, output, weight = GRAMMAR.step(state, symbol)
                if output:
                    found[output] += weight * (strength if symbol == "insult" else 1.0)
    return [math.log1p(found[name]) for name in FEATURES]


@dataclass
class Model:
    """Lexicon entries with their strength, and the weights of the features and the bias."""

    lexicon: dict[str, float]
    weights: list[float]
    bias: float

    def score(self, text: str) -> float:
        return self.scores([features(text, self.lexicon)])[0]

    def scores(self, rows) -> list[float]:
        x = np.asarray(rows, dtype=float).reshape(-1, len(FEATURES)) @ np.array(self.weights) + self.bias
        return (1 / (1 + np.exp(-np.clip(x, -30, 30)))).tolist()


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of the labelled documents that are not held out, ``rows`` of them at most."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    chosen = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # At most ``rows`` pairs of numbers, so they are broadcast.
    return texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")


def _observe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(entry, before, doc_id, clean): the words before an entry in toxic texts; the number of clean texts."""
    for batch in batches:
        clean: dict[str, int] = defaultdict(int)
        pairs = set()
        for doc_id, text, toxic in zip(batch["doc_id"], batch["text"], batch["toxic"]):
            words = WORD.findall(text.lower())
            if toxic:
                for before, word in zip(["", *words], words):
                    pairs.add((word, before, doc_id))
                    for n in STEMS:
                        if len(word) >= n:
                            pairs.add((word[:n] + "*", before, doc_id))
            else:
                for word in set(words):
                    clean[word] += 1
                for stem in {w[:n] + "*" for w in set(words) for n in STEMS if len(w) >= n}:
                    clean[stem] += 1
        columns = ["entry", "before", "doc_id", "clean"]
        yield pd.DataFrame([(e, "", 0, n) for e, n in clean.items()], columns=columns)
        yield pd.DataFrame([(e, b, i, 0) for e, b, i in pairs], columns=columns)


def learn_lexicon(train: DataFrame, sizes: dict[int, int]) -> dict[str, float]:
    """Entries that stand in several toxic texts after different words and hardly in clean ones.

    Counting different words before an entry keeps a toxic text that was copied often from making all of
    its words insults; counting texts does so for a long one.
    """
    seen = train.mapInPandas(_observe, "entry string, before string, doc_id long, clean long").groupBy("entry")
    toxic = F.least(*[F.count_distinct(F.when(F.col("clean") == 0, F.col(c))) for c in ("before", "doc_id")])
    counts = seen.agg(toxic.alias("toxic"), F.sum("clean").alias("clean")).where(f"toxic >= {LEAST_CONTEXTS}")
    odds = F.ln((F.col("toxic") + 0.5) / (sizes.get(1, 0) + 1)) - F.ln((F.col("clean") + 0.5) / (sizes.get(0, 0) + 1))
    chosen = counts.select("entry", odds.alias("odds")).where(F.col("odds") >= LEAST_LOG_ODDS)
    # Bounded by the training sample.
    return {r["entry"]: r["odds"] for r in chosen.orderBy("entry").collect()}


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """The model from at most ``rows`` labelled rows; without labels of both kinds the bare grammar."""
    train = training_rows(docs, labels, rows)
    sizes = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return Model({}, [1.0, 1.0, 0.3, 0.3, 1.0], -3.0)
    lexicon = learn_lexicon(train, sizes)

    def observed(batches):
        for batch in batches:
            yield pd.DataFrame({"x": [features(t, lexicon) for t in batch["text"]], "toxic": batch["toxic"]})

    seen = train.mapInPandas(observed, "x array<double>, toxic int").groupBy("x", "toxic").count().toPandas()
    x = np.array(seen["x"].tolist()).reshape(-1, len(FEATURES))
    return Model(lexicon, *_logistic(x, seen["toxic"].to_numpy(float), seen["count"].to_numpy(float)))


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[list[float], float]:
    """Weights by Newton's method, drawn towards those of the bare grammar where labels say little."""
    prior = np.array([1.0, 1.0, 0.3, 0.3, 1.0, -2.0])
    x = np.hstack([x, np.ones((len(x), 1))])
    order = np.lexsort((*x.T, y))
    x, y, n = x[order], y[order], n[order]
    pull = np.full(len(prior), 1.0)
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(pull), x.T @ (n * (p - y)) + pull * (w - prior))
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1].tolist(), float(w[-1])


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text) with an id.

    Every whole text is scored where it is read, without a shuffle. Only the text enters the score. Null
    and empty texts score as texts without a match. Repeated rows give one row each; rows with a null
    id are left out; other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict = {}
        for batch in batches:
            rows = [features(t, model.lexicon, kept) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": model.scores(rows)})

    scored = texts(docs).mapInPandas(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose text scores below the threshold, with all their columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}
        for batch in batches:
            rows = [features(t or "", model.lexicon, kept) for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(np.array(model.scores(rows)) < THRESHOLD, pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)
