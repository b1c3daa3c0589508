"""Toxicity by a weighted finite-state grammar of clauses over a learned lexicon.

Words are read as symbols: insult, threat, target, negation, reported speech, other. Which words insult is
learned from labelled documents (words and word beginnings, by log-odds over a bounded sample of labels); threats, targets,
negations and verbs of reporting are closed lists in four languages. One machine per phenomenon, composed into one:

  negation         rewrites insults and threats among the three symbols after a negation to negated ones
  reported speech  rewrites those behind a verb of reporting to reported ones, until the clause ends
  target           hands on the first word of a clause that names someone, wherever it stands
  insult           accepts clauses in which an insult is said of something: plain, of a target before or behind it, negated, reported
  threat           accepts clauses that hold both a threat and a target: plain, negated, reported

The first three are transducers, the last two acceptors of what they write. Only accepted clauses score: a word alone in a clause does not,
nor does a threat without a target. A clause weighs the learned weights of its insults and threats, and documents score by a logistic function of
their clauses' weights, in all and by pattern. It is fitted to the same sample; patterns the labels say little about stay near ``PRIOR``.

The lexicon and eight coefficients are broadcast (at most ``LEXICON`` entries); scoring is one pass without a shuffle. Labels
are read only from rows with crc32(doc_id) mod 5 other than 0; scores depend on texts alone.

Defined cases: a null text scores as an empty one; a very long text is read whole, clause by clause, in one task; repeated rows and ties score
alike (of several labels of an id the highest counts); without any label every score is 0; an empty table gives an empty
table; ``rejected`` passes further columns through, ``score`` ignores them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import Kept
from .common import ship, staged, take_over, text_of, tidied

#: Labelled documents under the model, entries of the lexicon.
SAMPLE, LEXICON = 20_000, 20_000
LEAST_SUPPORT, LEAST_ODDS = 5, 2.5
PREFIXES = (4, 5, 6)
INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER, NOT_INSULT, NOT_THREAT, SAID_INSULT, SAID_THREAT = range(10)
#: What accepted clauses are.
PLAIN, DIRECTED, THREATENED, NEGATED, REPORTED = range(5)
#: Coefficients of directed, threatening, negated and reported weight that labels move away from, in parts of that of all weight; strength of the pull.
PRIOR, PULL = (0.25, 0.5, -0.6, -0.4), 5.0
THREATS = frozenset("kill hurt destroy beat burn shoot stab murder töten schlagen vernichten tuer frapper détruire matar golpear destruir".split())
TARGETS = frozenset("you your yours u he she they him her them du dich dir ihr euch sie er tu te toi vous il elle ils tú usted ustedes él ella ellos".split())
NEGATIONS = frozenset("not no never nor isn't don't nicht kein keine nie pas jamais ne nunca jamás".split())
REPORTS = frozenset("said says say called calls claimed wrote quoted according sagte schrieb nannte dit disait écrit appelle dijo dice escribió llamó".split())
_clause = re.compile(r"[.!?;\n]+")
_edges = re.compile(r"^\W+|\W+$")


@dataclass(frozen=True)
class Machine:
    """Deterministic: (state, symbol) -> (state, symbol); symbols without an arc pass unchanged. ends: what a state accepts, None for nothing."""

    arcs: dict
    ends: dict

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, symbol))


def compose(first: Machine, second: Machine, symbols: range) -> Machine:
    """Feeds first's output to second, over all states that can be reached; accepts what both do."""
    arcs, ends, todo, number = {}, {}, [(0, 0)], {(0, 0): 0}
    for pair in todo:
        ends[number[pair]] = tuple(x for m, q in zip((first, second), pair) for x in m.ends.get(q, ()))
        for s in symbols:
            a, mid = first.step(pair[0], s)
            b, out = second.step(pair[1], mid)
            if (a, b) not in number:
                number[a, b] = len(number)
                todo.append((a, b))
            arcs[number[pair], s] = (number[a, b], out)
    return Machine(arcs, ends)


def acceptor(start, move, end, symbols: range) -> Machine:
    """A machine from a function on states of any kind; hands its input on."""
    arcs, ends, todo, number = {}, {}, [start], {start: 0}
    for q in todo:
        ends[number[q]] = end(q)
        for s in symbols:
            to = move(q, s)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            arcs[number[q], s] = (number[to], s)
    return Machine(arcs, ends)


def grammar() -> Machine:
    symbols, read = range(10), range(6)
    negation = {(k, NEGATION): (3, OTHER) for k in range(4)}
    for k in (1, 2, 3):
        negation |= {(k, s): (k - 1, s) for s in (TARGET, REPORT, OTHER)} | {(k, INSULT): (k - 1, NOT_INSULT), (k, THREAT): (k - 1, NOT_THREAT)}
    reported = {(q, REPORT): (1, OTHER) for q in (0, 1)} | {(1, INSULT): (1, SAID_INSULT), (1, THREAT): (1, SAID_THREAT)}
    target = {(0, TARGET): (1, TARGET), (1, TARGET): (1, OTHER)}
    # of several insults in a clause the plain one counts, then the reported one
    insults = {INSULT: 3, SAID_INSULT: 2, NOT_INSULT: 1}
    insult = acceptor(
        (0, 0, False),  # words up to two, insult, target
        lambda q, s: (min(q[0] + 1, 2), max(q[1], insults.get(s, 0)), q[2] or s == TARGET),
        lambda q: () if q[0] < 2 or not q[1] else ((NEGATED, REPORTED, DIRECTED if q[2] else PLAIN)[q[1] - 1],),
        symbols,
    )
    threats = {THREAT: 3, SAID_THREAT: 2, NOT_THREAT: 1}
    threat = acceptor((0, False), lambda q, s: (max(q[0], threats.get(s, 0)), q[1] or s == TARGET), lambda q: ((NEGATED, REPORTED, THREATENED)[q[0] - 1],) if q[0] and q[1] else (), symbols)
    machine = Machine(negation, {})
    for m in (Machine(reported, {}), Machine(target, {}), insult, threat):
        machine = compose(machine, m, read)
    return machine


def features(word: str) -> list[str]:
    return [word, *("^" + word[:k] for k in PREFIXES if len(word) > k)]


def clean(token: str) -> str:
    return _edges.sub("", token)


class Scorer:
    """Symbols and weights of words, accepted clauses."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        machine = grammar()
        self.lexicon, self.ends = lexicon, machine.ends
        self.next = [[machine.arcs[q, s][0] for s in range(6)] for q in range(len(machine.ends))]
        self.kept = Kept(self._read, limit=60_000)

    def _read(self, token: str):
        """None for other words, () for what is no word."""
        word = clean(token)
        if not word:
            return ()
        weight = max((self.lexicon.get(f, 0.0) for f in features(word)), default=0.0)
        if word in THREATS:
            return (THREAT, max(weight, LEAST_ODDS))
        if weight:
            return (INSULT, weight)
        for symbol, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
            if word in words:
                return (symbol, 0.0)
        return None

    def clauses(self, text: str) -> list[tuple[int, float]]:
        """Pattern and weight of the accepted clauses."""
        low = text.lower()
        if not any(x and x[1] for x in map(self.kept.__getitem__, low.split())):
            return []
        out = []
        for clause in _clause.split(low):
            own = [x for x in map(self.kept.__getitem__, clause.split()) if x != ()]
            if not any(x and x[1] for x in own):
                continue
            state, insults, threats = 0, 0.0, 0.0
            for x in own:
                symbol, weight = x or (OTHER, 0.0)
                state = self.next[state][symbol]
                if symbol == INSULT:
                    insults += weight
                elif symbol == THREAT:
                    threats += weight
            found = self.ends[state]
            if len(found) == 2:
                out += [(found[0], insults), (found[1], threats)]
            elif found:
                out.append((found[0], insults or threats))
        return out

    def summary(self, text: str) -> tuple[float, ...]:
        """Of all accepted clauses: their weight, the heaviest, their number; the weight of directed, threatening, negated, reported ones."""
        found = self.clauses(text)
        sums = [0.0] * 5
        for pattern, weight in found:
            sums[pattern] += weight
        return (math.log1p(sum(sums)), max((w for _, w in found), default=0.0), math.log1p(len(found)), *map(math.log1p, sums[1:]))


def logistic(x: np.ndarray, y: np.ndarray, ridge: np.ndarray, prior: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Intercept and coefficients, by Newton steps; ridge pulls them to prior."""
    x = np.column_stack([np.ones(len(x)), x])
    b = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        d = np.linalg.solve(h, x.T @ (y - p) - ridge * (b - prior))
        b += np.clip(d, -5, 5)
        if np.abs(d).max() < 1e-8:
            break
    return b


def coefficients(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of summaries: first those of all clauses, then those of the patterns, from PRIOR. Marks never work against their sense."""
    base = logistic(x[:, :3], y, np.full(4, 1e-2), np.zeros(4))
    one = np.array([math.log1p(5.0), 5.0, math.log(2.0)])  # a clause of weight 5
    scale = max(0.0, float(one @ base[1:])) / math.log1p(5.0)
    prior = np.concatenate([base, scale * np.array(PRIOR)])
    b = logistic(x, y, np.array([1e-2] * 4 + [PULL] * 4), prior)
    b[4:6], b[6:8] = np.maximum(b[4:6], 0.0), np.clip(b[6:8], -scale, 0.0)
    return b


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    toxic, rest = Counter(), Counter()
    for pdf in batches:
        for text, label in zip(pdf.text, pdf.label):
            own = {f for t in set(text.lower().split()) if (w := clean(t)) for f in features(w)}
            (toxic if label else rest).update(own)
    yield pd.DataFrame([(f, n, rest[f]) for f, n in toxic.items()] + [(f, 0, n) for f, n in rest.items() if f not in toxic], columns=["feature", "toxic", "rest"])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, limit: int = LEXICON) -> tuple[dict[str, float], np.ndarray]:
    """Lexicon and coefficients from at most ``sample`` labelled documents, those with the smallest hashes."""
    ship(docs.sparkSession)
    ids = labels.select(F.col(doc_id).alias("id"), (F.col(label) > 0).cast("int").alias("label")).dropna().filter(~held_out(F.col("id")))
    ids = ids.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(doc_id).alias("id"), text_of(text).alias("text")).join(F.broadcast(staged(ids, "toxic-ids")), "id")  # at most ``sample`` small rows
    rows = staged(rows.select("text", "label"), "toxic-sample")
    n = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if not n.get(1):
        return {}, np.array([-50.0, *[0.0] * 7])
    found = rows.mapInPandas(lambda it: tidied(_count(it)), "feature string, toxic long, rest long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("rest").alias("rest"))
    odds = F.log((F.col("toxic") + 0.5) / float(n[1] + 1)) - F.log((F.col("rest") + 0.5) / float(n.get(0, 0) + 1))
    found = found.filter(F.col("toxic") >= LEAST_SUPPORT).select("feature", odds.alias("odds")).filter(F.col("odds") >= LEAST_ODDS)
    lexicon = {r.feature: min(r.odds, 8.0) for r in found.orderBy(F.desc("odds"), "feature").limit(limit).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for pdf in batches:
            yield pd.DataFrame([(*scorer.summary(t), y) for t, y in zip(pdf.text, pdf.label)], columns=list("abcdefgy"))

    x = np.array(rows.mapInPandas(lambda it: tidied(summaries(it)), ", ".join(f"{c} double" for c in "abcdefgy")).collect())  # at most ``sample`` rows of eight numbers
    return lexicon, coefficients(x[:, :7], x[:, 7])


_scorers: dict = {}


def _score(batches: Iterator[pd.DataFrame], shared) -> Iterator[pd.DataFrame]:
    lexicon, b = shared.value
    if _scorers.get("of") is not lexicon:
        take_over("toxicity", _scorers.clear)
        _scorers.update(of=lexicon, scorer=Scorer(lexicon))
    scorer = _scorers["scorer"]
    for pdf in batches:
        x = np.array([(1.0, *scorer.summary(t)) for t in pdf.text]).reshape(-1, 8)
        yield pdf.drop(columns=["text"]).assign(score=1 / (1 + np.exp(-np.clip(x @ b, -50, 50))))


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(fit(docs, labels, doc_id, text, **how))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), text_of(text).alias("text"))
    return rows.mapInPandas(lambda it: tidied(_score(it, shared)), "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def rejected(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of docs that are not toxic, with all of docs' columns."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(fit(docs, labels, doc_id, text, **how))
    names, schema = docs.columns, docs.schema

    def keep(batches):
        import pyarrow as pa

        at = next(i for i, c in enumerate(names) if c == text)
        for batch in batches:
            pdf = pd.DataFrame({"text": [t or "" for t in batch.column(at).to_pylist()]})
            ok = next(_score(iter([pdf]), shared)).score.to_numpy() < 0.5
            yield batch.filter(pa.array(ok))

    return docs.mapInArrow(lambda it: tidied(keep(it)), schema)
