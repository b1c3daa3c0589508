"""Secret scans: base patterns, and a format model inferred from labelled credentials.

The base patterns label credentials by their context. From a bounded sample of their values (``SAMPLE`` per kind, the
smallest by hash over all documents) a prefix tree is built per kind, and states whose outgoing frequencies are
statistically compatible (Hoeffding bound) are merged, red-blue fashion, into a probabilistic automaton over character
classes; values beyond ``LONGEST`` characters are learned as far as that, without an end there. The background is a suffix automaton over characters, from the counts of all trigrams of all ordinary tokens: those that
are scored too and hold no labelled credential. A context is a state if its counts differ from the next shorter one's by the
same bound. Every candidate of every whole text,
a maximal run of at least ``LEAST`` credential characters (full stops inside, not at its end) that base spans do not cover, is then scored by the log-likelihood ratio per character
of its best automaton against the background; those above ``THRESHOLD`` become ``format`` spans, which may hold base spans.

Fitting merges summaries of bounded size in a tree, of which the last comes to the driver; scoring is one pass without a shuffle.

Defined cases: a null text is empty and has no spans; repeated rows give repeated results; without any labelled credential no format spans are made; offsets are code points, ends
exclusive; spans of equal start go by kind; a very long text is read whole in one task, in time linear in its length; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Kept
from .common import ship, text_of, tidied

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"(?=[A-Za-z0-9+/_=.-]{12})[A-Za-z0-9+/_=-]+(?:\.[A-Za-z0-9+/_=-]+)*")
LEAST = 12
#: Values per kind under the model; least log-likelihood ratio per character.
SAMPLE, THRESHOLD = 400, 0.6
ALPHA = 0.05
#: Summaries that one task merges.
FAN_IN = 64
#: Characters of a value that the automata are fitted to; those that go on have no end there.
LONGEST = 256
_SIZES = {"d": 10, "h": 6, "l": 20, "H": 6, "U": 20, "s": 6}
_CLASS = {"^": "^", **dict.fromkeys("0123456789", "d"), **dict.fromkeys("abcdef", "h"), **dict.fromkeys("ghijklmnopqrstuvwxyz", "l"), **dict.fromkeys("ABCDEF", "H"), **dict.fromkeys("GHIJKLMNOPQRSTUVWXYZ", "U")}


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's place, end, value), by start and kind."""
    out = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def classes(value: str) -> str:
    return "".join(_CLASS.get(c, "s") for c in value)


def differ(f1: int, n1: int, f2: int, n2: int, bound: float) -> bool:
    return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))


class Automaton:
    """Probabilistic automaton: counts of arrivals, ends and arcs per state."""

    def __init__(self, values: list[str], alpha: float = ALPHA, longest: int = LONGEST) -> None:
        self.arcs: list[dict[str, list]] = [{}]  # symbol -> [next, count]
        self.seen, self.ends = [0], [0]
        for v in values:
            self._add(v[:longest], len(v) > longest)
        self._merge(alpha)

    def _add(self, value: str, cut: bool) -> None:
        """A value that was cut has no end: its last state is reached, but what follows there is not known."""
        s = 0
        for c in value:
            self.seen[s] += 1
            arc = self.arcs[s].get(c)
            if arc is None:
                self.arcs.append({})
                self.seen.append(0)
                self.ends.append(0)
                arc = self.arcs[s][c] = [len(self.arcs) - 1, 0]
            arc[1] += 1
            s = arc[0]
        if not cut:
            self.seen[s] += 1
            self.ends[s] += 1

    def _compatible(self, a: int, b: int, bound: float) -> bool:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            if differ(self.ends[a], self.seen[a], self.ends[b], self.seen[b], bound):
                return False
            x, y = self.arcs[a], self.arcs[b]
            for c in x.keys() | y.keys():
                p, q = x.get(c), y.get(c)
                if differ(p[1] if p else 0, self.seen[a], q[1] if q else 0, self.seen[b], bound):
                    return False
                if p and q:
                    stack.append((p[0], q[0]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree below b to a."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            self.seen[a] += self.seen[b]
            self.ends[a] += self.ends[b]
            for c, (to, n) in self.arcs[b].items():
                arc = self.arcs[a].get(c)
                if arc is None:
                    self.arcs[a][c] = [to, n]
                else:
                    arc[1] += n
                    stack.append((arc[0], to))

    def _merge(self, alpha: float) -> None:
        bound = math.sqrt(0.5 * math.log(2 / alpha))
        red, i = [0], 0
        known = {0}
        while i < len(red):
            r = red[i]
            pending = [c for c in sorted(self.arcs[r]) if self.arcs[r][c][0] not in known]
            if not pending:
                i += 1
                continue
            c = pending[0]
            blue = self.arcs[r][c][0]
            to = next((s for s in red if self._compatible(s, blue, bound)), None)
            if to is None:
                red.append(blue)
                known.add(blue)
            else:
                self.arcs[r][c][0] = to
                self._fold(to, blue)
                i = 0
        place = {s: k for k, s in enumerate(red)}
        self.table = [
            ({c: (place[to], math.log((n + 0.5) / (self.seen[s] + 4)) - math.log(_SIZES[c])) for c, (to, n) in self.arcs[s].items()}, math.log((self.ends[s] + 0.5) / (self.seen[s] + 4)))
            for s in red
        ]
        del self.arcs, self.seen, self.ends

    #: Log-probability of a class that a state has no arc for, besides the choice within the class; the state stays.
    MISS = math.log(0.002)

    def score(self, value: str) -> float:
        """Log-likelihood per character of a string of classes."""
        s = total = 0
        for c in value:
            s, w = self.table[s][0].get(c) or (s, self.MISS - math.log(_SIZES[c]))
            total += w
        return (total + self.table[s][1]) / max(1, len(value))


def contexts(last: str) -> list[str]:
    """Contexts of the character behind two others, longest first: these, their classes, the last one's class, none."""
    own = classes(last)
    return ["3" + last, "2" + own, "1" + own[1], "0"]


class Background:
    """Suffix automaton over characters, from counts of trigrams; ``^`` stands twice before a token, ``$`` behind it."""

    SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-$"

    def __init__(self, grams: dict[str, int], alpha: float = ALPHA) -> None:
        bound = math.sqrt(0.5 * math.log(2 / alpha))
        counts: dict[str, Counter] = defaultdict(Counter)
        shorter: dict[str, list[str]] = {}
        for gram, n in grams.items():
            own = contexts(gram[:2])
            for k, c in enumerate(own):
                counts[c][gram[2]] += n
                shorter[c] = own[k + 1 :]
        odds: dict[str, dict[str, float]] = {}
        for c in sorted(counts):  # shorter ones first
            have, n = counts[c], counts[c].total()
            up = next((u for u in shorter[c] if u in odds), None)
            if up is None:
                odds[c] = {x: (have[x] + 0.5) / (n + 0.5 * len(self.SYMBOLS)) for x in self.SYMBOLS}
                continue
            most, m = counts[up], counts[up].total()
            if any(differ(have[x], n, most[x], m, bound) for x in most):
                odds[c] = {x: (have[x] + p) / (n + 1) for x, p in odds[up].items()}
        self.states = {c: {x: math.log(p) for x, p in o.items()} for c, o in odds.items()}

    def score(self, value: str) -> float:
        """Log-likelihood per character."""
        total, last = 0.0, "^^"
        for c in value + "$":
            state = self.states.get("3" + last)
            if state is None:
                state = next(self.states[u] for u in contexts(last) if u in self.states)
            total += state[c]
            last = last[1] + c
        return total / max(1, len(value))


def candidates(text: str, base: list[tuple[int, int, int, str]]) -> Iterator[tuple[int, int, str, bool]]:
    """start, end, value of the runs that base spans do not cover, and whether one overlaps them."""
    starts, ends = [], []  # of the base spans, those that touch as one
    for start, _, end, _ in base:
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    for m in CANDIDATE.finditer(text):
        if m.end() - m.start() < LEAST:
            continue
        k = bisect_right(starts, m.start())
        reached = ends[k - 1] if k else 0
        if reached < m.end():
            yield m.start(), m.end(), m[0], reached > m.start() or (k < len(starts) and starts[k] < m.end())


def least(have: dict[str, int], limit: int) -> dict[str, int]:
    """The values with the smallest hashes."""
    return have if len(have) <= limit else dict(sorted(have.items(), key=lambda x: (x[1], x[0]))[:limit])


def _packed(values: dict[int, dict[str, int]], grams: Counter) -> bytes:
    return zlib.compress(json.dumps([values, grams]).encode(), 1)


def _merged(blobs, limit: int) -> tuple[dict[int, dict[str, int]], Counter]:
    values, grams = defaultdict(dict), Counter()
    for blob in blobs:
        more, counts = json.loads(zlib.decompress(blob))
        grams.update(counts)
        for kind, have in more.items():
            values[int(kind)] = least(values[int(kind)] | have, limit)
    return values, grams


def _labelled(batches: Iterator[pd.DataFrame], limit: int) -> Iterator[pd.DataFrame]:
    """A summary of bounded size: the values of each kind with the smallest hashes, and the trigrams of all ordinary tokens with their counts."""
    from pyspark import TaskContext

    found: dict[int, dict[str, int]] = defaultdict(dict)
    tokens, grams = Counter(), Counter()

    def add() -> None:
        for token, n in tokens.items():
            token = f"^^{token}$"
            for k in range(len(token) - 2):
                grams[token[k : k + 3]] += n
        tokens.clear()

    for pdf in batches:
        for text in pdf.text:
            spans = base_spans(text)
            for _, kind, _, value in spans:
                found[kind].setdefault(value[: LONGEST + 1], zlib.crc32(value.encode()))  # what tells cut values from whole ones
            for _, _, token, labelled in candidates(text, spans):
                if not labelled:
                    tokens[token] += 1
            for kind, have in found.items():
                if len(have) > 8 * limit:
                    found[kind] = least(have, limit)
            if len(tokens) > 20_000:
                add()
    add()
    task = TaskContext.get()
    yield pd.DataFrame({"slot": [task.partitionId() if task else 0], "blob": [_packed({k: least(v, limit) for k, v in found.items()}, grams)]})


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> dict[int, Automaton | Background]:
    """Automata by kind; 3 is the background."""
    ship(docs.sparkSession)

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slot": [int(pdf.slot.iloc[0]) // FAN_IN], "blob": [_packed(*_merged(pdf.blob, sample))]})

    rows = docs.select(text_of(text).alias("text"))
    n = rows.rdd.getNumPartitions()
    rows = rows.mapInPandas(lambda it: tidied(_labelled(it, sample)), "slot int, blob binary")
    while n > 1:  # a tree: no task gets more than FAN_IN summaries
        rows = rows.groupBy(F.floor(F.col("slot") / FAN_IN)).applyInPandas(merged, "slot int, blob binary")
        n = -(-n // FAN_IN)
    values, grams = _merged((r.blob for r in rows.collect()), sample)  # one row
    models = {k: Automaton([classes(v) for v in sorted(have, key=lambda v: (have[v], v))]) for k, have in values.items()}
    return models | ({3: Background(grams)} if grams else {})


def ratio(value: str, model: dict[int, Automaton | Background]) -> float:
    own = classes(value)
    back = model[3].score(value) if 3 in model else -math.log(26)
    return max((a.score(own) for k, a in model.items() if k != 3), default=-math.inf) - back


def all_spans(text: str, model: dict[int, Automaton | Background], threshold: float = THRESHOLD, known: dict[str, float] | None = None) -> tuple[list, list]:
    """Base spans, and all spans; known: the ratios of values."""
    base = base_spans(text)
    more = []
    if model.keys() - {3}:
        for start, end, value, _ in candidates(text, base):
            if (ratio(value, model) if known is None else known[value]) >= threshold:
                more.append((start, 3, end, value))
    return base, sorted(base + more)


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans)


def _scan(batches: Iterator[pd.DataFrame], model, threshold: float) -> Iterator[pd.DataFrame]:
    known = Kept(lambda value: ratio(value, model.value), limit=50_000)
    for pdf in batches:
        out = []
        for text in pdf.text:
            base, every = all_spans(text, model.value, threshold, known)
            out.append((*(sum(s[1] == k for s in base) for k in range(3)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
        rows = pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])
        rows.insert(0, "doc_id", pdf.doc_id.to_numpy())
        yield rows


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, model: dict[int, Automaton | Background] | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(fit(docs, text) if model is None else model)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return rows.mapInPandas(lambda it: tidied(_scan(it, shared, threshold)), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
