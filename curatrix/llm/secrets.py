"""Secrets by grammar inference.

The base rules give labelled credentials: values of assignments, access keys and hexadecimal keys.
For each kind a prefix tree of the values is built and states whose futures are statistically
compatible (Hoeffding's bound on the frequencies of ends and next characters, recursively) are
merged, which leaves a deterministic probabilistic automaton of the kind's format.  The background is a
model of three characters over all words of all documents outside base spans.  Both give the likelihood of a whole value with its end, so
its length counts as well.  Every further run of 6 or more key characters, dots
included, is a candidate (and, if its whole isn't added, each of its parts between dots) and is scored by its log
likelihood ratio a character; it is added if a kind's automaton explains it far better than
the background, without its own share, does and nearly as well as that kind's own credentials.

Only states are merged on a bounded sample of labelled values: the ``SAMPLE`` different values
of a kind, of at most ``LONGEST`` characters, whose hashes are smallest.  How well a kind's credentials score is
taken over all of them, and candidates are all scored.

Cases: null counts as the empty text, which has no spans; whole texts of any length are searched; an empty table
gives no rows; kinds without any credential add nothing; repeated rows count each and get equal spans; of equally likely kinds the
last as listed is taken; of the table only the named columns are read, so columns of the names used here don't matter.
"""

from __future__ import annotations

import bisect
import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

KINDS = ("assign", "access", "hex")
SAMPLE, LONGEST = 600, 128
#: Runs that a worker remembers as not added.
REMEMBERED = 300_000
#: Least log likelihood ratio a character of an added span, and how far below its kind's poorest own credentials (per character) it may score.
RATIO, BELOW = 1.0, 0.1

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
#: Characters and the blank (0) before a word.
_SIZE = len(_LETTERS) + 1
_CODES = np.zeros(256, np.int64)
_CODES[np.frombuffer(_LETTERS.encode(), np.uint8)] = np.arange(1, _SIZE)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the base rules, by start, then kind."""
    out = [(m.start(), 0, m.end(), m.group(2)) for m in _ASSIGN.finditer(text) if m.end() - m.start(2) >= 6]
    out += [(m.start(), 1, m.end(), m.group()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end(), m.group()) for m in _HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, value) of runs of key characters, from 6 on and without dots at their ends, that no base span touches."""
    held = sorted((a, b) for a, _, b, _ in base)
    far, ends = 0, []
    for _, b in held:
        far = max(far, b)
        ends.append(far)
    starts = [a for a, _ in held]
    out = []
    for m in _RUN.finditer(text):
        v = m.group().strip(".")
        if len(v) < 6:
            continue
        start = m.start() + m.group().index(v)
        i = bisect.bisect_left(starts, start + len(v))
        if not i or ends[i - 1] <= start:
            out.append((start, start + len(v), v))
    return out


def parts(start: int, value: str) -> list[tuple[int, str]]:
    """(start, value) of a candidate, then of its parts between dots."""
    out = [(start, value)]
    if "." in value:
        out += [(start + m.start(), m.group()) for m in re.finditer(r"[^.]{6,}", value)]
    return out


class Automaton:
    """A deterministic probabilistic automaton from values, by merging compatible states of their prefix tree."""

    def __init__(self, values: list[str], alpha: float = 0.01):
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.seen, self.ends, self.next = [0], [0], [{}]
        for v in values:
            at = 0
            self.seen[0] += 1
            for c in v:
                to = self.next[at].get(c)
                if to is None:
                    to = self.next[at][c] = [len(self.seen), 0]
                    self.seen.append(0)
                    self.ends.append(0)
                    self.next.append({})
                to[1] += 1
                at = to[0]
                self.seen[at] += 1
            self.ends[at] += 1
        self.merge()
        self.smooth()

    def smooth(self, weight: float = 1.0) -> None:
        """Log likelihoods: of each state those of stopping, of the characters seen with their next state, and of any other one.

        Each state gives ``weight`` more counts to stopping and all characters alike.  A character that it
        hasn't seen leads to a free state, whose likelihoods are those of the kind's characters as a whole, so that those of
        all values make 1.
        """
        each = weight / (len(_LETTERS) + 1)
        total: dict[str, int] = {}
        for x in self.next:
            for c, (_, n) in x.items():
                total[c] = total.get(c, 0) + n
        self.free = len(self.next)
        self.table = []
        for stop, x in [*zip(self.ends, self.next), (sum(self.ends), {c: (self.free, n) for c, n in total.items()})]:
            whole = stop + sum(n for _, n in x.values()) + weight
            self.table.append(({c: (to, math.log((n + each) / whole)) for c, (to, n) in x.items()}, (self.free, math.log(each / whole)), math.log((stop + each) / whole)))

    def differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.bound * (n1**-0.5 + n2**-0.5)

    def alike(self, a: int, b: int) -> bool:
        left = [(a, b)]
        while left:
            a, b = left.pop()
            n1, n2 = self.seen[a], self.seen[b]
            if self.differ(self.ends[a], n1, self.ends[b], n2):
                return False
            x, y = self.next[a], self.next[b]
            for c in x.keys() | y.keys():
                if self.differ(x[c][1] if c in x else 0, n1, y[c][1] if c in y else 0, n2):
                    return False
                if c in x and c in y:
                    left.append((x[c][0], y[c][0]))
        return True

    def fold(self, a: int, b: int) -> None:
        """Adds the tree under b to the state a."""
        left = [(a, b)]
        while left:
            a, b = left.pop()
            self.seen[a] += self.seen[b]
            self.ends[a] += self.ends[b]
            x = self.next[a]
            for c, (to, n) in self.next[b].items():
                if c in x:
                    x[c][1] += n
                    left.append((x[c][0], to))
                else:
                    x[c] = [to, n]

    def merge(self) -> None:
        fixed = [0]
        while True:
            edges = [(r, c) for r in fixed for c in sorted(self.next[r]) if self.next[r][c][0] not in fixed]
            if not edges:
                break
            # the state that most values pass through is the best attested
            r, c = max(edges, key=lambda e: (self.next[e[0]][e[1]][1], -e[0], e[1]))
            b = self.next[r][c][0]
            a = next((q for q in fixed if self.alike(q, b)), None)
            if a is None:
                fixed.append(b)
            else:
                self.next[r][c][0] = a
                self.fold(a, b)
        names = {q: k for k, q in enumerate(fixed)}
        self.seen, self.ends = [self.seen[q] for q in fixed], [self.ends[q] for q in fixed]
        self.next = [{c: [names[to], n] for c, (to, n) in self.next[q].items()} for q in fixed]

    def score(self, value: str, least: float = -math.inf) -> float:
        """The log likelihood of the value and of its end, a character (the end counts as one), or minus infinity below least."""
        at, total, low = 0, 0.0, least * (len(value) + 1) - 1e-9
        for c in value:
            known, other, _ = self.table[at]
            at, p = known.get(c, other)
            total += p
            if total < low:
                return -math.inf
        total += self.table[at][2]
        return total / (len(value) + 1) if total >= low else -math.inf


def trigrams(text: str) -> np.ndarray:
    """The codes of each key character, and of each end of a word, with the two characters before it; others count as blanks."""
    x = _CODES[np.frombuffer(f"  {text} ".encode(), np.uint8)]
    a, b, c = x[:-2], x[1:-1], x[2:]
    return ((np.where(b > 0, a, 0) * _SIZE + b) * _SIZE + c)[(b > 0) | (c > 0)]


class Background:
    """Characters' and ends' probabilities after two others, backed off to one and none, from all trigrams' counts."""

    def __init__(self, counts: np.ndarray):
        self.three = counts.reshape(_SIZE, _SIZE, _SIZE)
        self.two, self.one = self.three.sum(0), self.three.sum((0, 1))
        self.after, self.all = self.two.sum(1), self.one.sum()
        self.before = self.three.sum(2)

    def score(self, value: str, weight: float = 5.0) -> float:
        """The log likelihood a character with its end, the value's own trigrams not counted."""
        t = trigrams(value)
        a, b, c = t // _SIZE**2, t // _SIZE % _SIZE, t % _SIZE
        own = lambda x: (x[:, None] == x).sum(1)
        less = lambda n, x: np.maximum(n - own(x), 0)
        p = (less(self.one[c], c) + 0.5) / (max(self.all - len(t), 0) + 0.5 * _SIZE)
        p = (less(self.two[b, c], b * _SIZE + c) + weight * p) / (less(self.after[b], b) + weight)
        p = (less(self.three[a, b, c], t) + weight * p) / (less(self.before[a, b], a * _SIZE + b) + weight)
        return float(np.log(np.minimum(p, 1.0)).mean())


def gather(docs: DataFrame) -> DataFrame:
    """What is learnt from: kind and value of each base span, and gram and n, trigrams' counts over all words outside base spans."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(_SIZE**3, np.int64)
        names = ["kind", "value", "gram", "n"]
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                kinds, values, rest = [], [], []
                for t in batch.column(0).slice(low, 200).to_pylist():
                    at = 0
                    for a, k, b, v in base_spans(t) if t else []:
                        kinds.append(k)
                        values.append(v)
                        rest.append(t[at : max(at, a)])
                        at = max(at, b)
                    rest.append(t[at:] if t else "")
                total += np.bincount(trigrams(" ".join(rest)), minlength=_SIZE**3)
                if kinds:
                    none = pa.nulls(len(kinds), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(values, pa.string()), none, none], names=names)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(seen), pa.int32()), pa.nulls(len(seen), pa.string()), pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=names)

    return C.materialize(docs.select("text").mapInArrow(run, "kind int, value string, gram long, n long"), "secret-facts")


def background(facts: DataFrame) -> Background | None:
    """From gather()'s counts; what reaches the driver is one count a trigram."""
    told = facts.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()  # at most 69 ** 3 rows
    if not len(told):
        return None
    counts = np.zeros(_SIZE**3, np.int64)
    counts[told["gram"].to_numpy()] = told["n"].to_numpy()
    return Background(counts)


def _sample(values: DataFrame) -> list[str]:
    """The SAMPLE different values whose hashes are smallest."""
    values = values.where(F.length("value") <= LONGEST).distinct()
    return [r["value"] for r in values.orderBy(F.xxhash64("value"), "value").limit(SAMPLE).collect()]


def infer(facts: DataFrame) -> tuple[list[Automaton | None], list[float]]:
    """The kinds' automata, and the least scores of their own credentials (hundredth part of all different ones)."""
    labelled = facts.where("kind is not null").select("kind", "value").distinct()
    models = []
    for k in range(len(KINDS)):
        own = _sample(labelled.where(F.col("kind") == k).select("value"))
        models.append(Automaton(own) if own else None)

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            # a kind whose values are all longer than LONGEST has no automaton
            scores = [models[k].score(v) if models[k] else None for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["kind", "score"])

    low = labelled.mapInArrow(score, "kind int, score double").groupBy("kind").agg(F.percentile_approx("score", 0.01, 10000).alias("low")).collect()
    told = {r["kind"]: r["low"] for r in low if r["low"] is not None}
    return models, [told[k] - BELOW if k in told else math.inf for k in range(len(KINDS))]


def judge(value: str, models: list[Automaton | None], least: list[float], plain: Background | None) -> tuple[int, float]:
    """The kind whose format a value has, or -1, and its log likelihood ratio a character."""
    best = max(((m.score(value, least[k]), k) for k, m in enumerate(models) if m), default=(-math.inf, -1))
    if best[0] == -math.inf or best[0] < least[best[1]]:
        return -1, -math.inf
    word = plain.score(value) if plain else -10.0
    fits = best[0] - word >= RATIO
    return (best[1] if fits else -1), best[0] - word


class Judge:
    """Which runs of a text are added, by the models; runs none of which is are remembered."""

    def __init__(self, models: list[Automaton | None], least: list[float], plain: Background | None):
        self.models, self.least, self.plain = models, least, plain
        self.dull: set[str] = set()

    def __getstate__(self):
        return self.__dict__ | {"dull": set()}

    def added(self, text: str, base: list[tuple[int, int, int, str]]) -> list[dict]:
        runs = {r.strip(".") for r in set(_RUN.findall(text)) - self.dull}
        runs = {r for r in runs if len(r) >= 6}
        if not runs:
            return []
        verdicts: dict[str, list[dict]] = {}
        for run in runs:
            own = verdicts[run] = []
            for start, v in parts(0, run):
                k, s = judge(v, self.models, self.least, self.plain)
                if k >= 0:
                    own.append({"start": start, "kind": k, "end": start + len(v), "value": v, "score": s})
                    if v == run:
                        break
        if len(self.dull) > REMEMBERED:
            self.dull.clear()
        self.dull |= {r for r, own in verdicts.items() if not own and len(r) <= LONGEST}
        if not any(verdicts.values()):
            return []
        return [x | {"start": start + x["start"], "end": start + x["end"]} for start, _, v in candidates(text, base) for x in verdicts.get(v, ())]


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base and added: each document's spans as (start, kind, end), with the value and, if added, its score.

    The texts are read twice: for what is learnt, and to find and score the spans where they are.
    """
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    facts = gather(chosen)
    judges = Judge(*infer(facts), background(facts))

    def search(batches):
        import pyarrow as pa

        span = [("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("value", pa.string())]
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                base, added = [], []
                for t in part.column(1).to_pylist():
                    own = base_spans(t) if t else []
                    base.append([dict(zip(("start", "kind", "end", "value"), x)) for x in own])
                    added.append(judges.added(t, own) if t else [])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(base, pa.list_(pa.struct(span))), pa.array(added, pa.list_(pa.struct([*span, ("score", pa.float64())])))], names=["doc_id", "base", "added"])

    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(search, f"doc_id {kind}, base array<struct<start:int,kind:int,end:int,value:string>>, added array<struct<start:int,kind:int,end:int,value:string,score:double>>")


def digest(found: DataFrame) -> DataFrame:
    """The counts and texts of spans(): n_assign, n_access, n_hex and base_sha256 of base spans, spans of all."""
    names = F.array(*[F.lit(k) for k in KINDS])
    plain = lambda xs: F.transform(xs, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    said = lambda xs: F.array_join(F.transform(F.array_sort(plain(xs)), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")
    of = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    counts = [of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(said(F.col("base")).cast("binary"), 256).alias("base_sha256"), said(F.concat(plain(F.col("base")), plain(F.col("added")))).alias("spans"))
