"""Toxicity by maximum-scoring segments.

Training: words' log-odds between toxic and clean documents under a Dirichlet prior in proportion
to their overall frequency.  Words whose log-odds are significant have a weight; so have word
beginnings shared by several different words, which stand for forms that training hasn't seen.  All other words
score the slightly negative log-odds of an unmarked word, so a clean text's expected score is below zero.

Scoring: one linear scan of a text's scores finds all its maximal segments (Ruzzo and Tompa).
A segment of score s in n words has the expected number E = K n exp(-lambda s) in clean text, with
lambda and K from clean training documents.  The evidence of significant segments goes through a logistic
calibration to a probability.

The model is fitted on a bounded sample of the labelled rows that aren't held out: the ``SAMPLE``
rows whose hashes are smallest, near copies counted once.  What is gathered are weights and features of those.

Cases: null counts as the empty text, which has no segments and gets the base score; unlabelled and
null labels don't train; without toxic training documents every score is 0; an empty table
gives no rows; repeated rows count each; labels repeated with one doc_id count once (toxic if any is);
only the named columns are read.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

SAMPLE = 20_000
#: Weight of the prior, words' overall frequency, as a part of all training counts.
PRIOR = 1 / 16
#: Least z of a weighted word or beginning, least documents with it, least words that share a beginning.
LEAST_Z, LEAST_DOCS, LEAST_FORMS = 2.4, 4, 4
BEGINNINGS = (4, 5, 6)
#: Expected number in clean text up to which a segment is significant.
SIGNIFICANT = 0.5
THRESHOLD = 0.7
REMEMBERED = 200_000

_WORDS = re.compile(r"[^\W\d_]+").findall


def words_of(text: str | None) -> list[str]:
    return _WORDS(text.lower()) if text else []


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def family(words: list[str]) -> int:
    """Smallest hash of the 5-word shingles: near copies mostly share it."""
    n = max(1, len(words) - 4)
    return min(zlib.crc32(" ".join(words[k : k + 5]).encode()) for k in range(n))


class Weights(dict):
    """A word's weight, 0 for unmarked words, remembered."""

    def __init__(self, words: dict[str, float], beginnings: dict[str, float], plain: frozenset[str]):
        super().__init__()
        self.words, self.beginnings, self.plain = words, beginnings, plain

    def __missing__(self, word: str) -> float:
        found = self.words.get(word, 0.0)
        if not found and word not in self.plain:
            for n in reversed(BEGINNINGS):
                if len(word) > n and (found := self.beginnings.get(word[:n], 0.0)):
                    break
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found
        return found


def segments(scores: list[float]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, start, end) of a sequence, by Ruzzo and Tompa's scan."""
    found: list[list] = []  # start, end, sum before, sum up to its end
    total = 0.0
    for k, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        new = [k, k + 1, before, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(r - l, a, b) for a, b, l, r in found]


class Model:
    def __init__(self, weights: tuple, drop: float, lam: float, k: float, logit: list[float] | None):
        self.weights, self.drop, self.lam, self.k, self.logit = weights, drop, lam, k, logit
        self.held: Weights | None = None

    def __getstate__(self):
        return self.__dict__ | {"held": None}

    def passages(self, text: str | None) -> tuple[int, list[tuple[float, float, int, int]]]:
        """The number of words and the maximal segments as (score, expected number, first word, last word + 1)."""
        if self.held is None:
            self.held = Weights(*self.weights)
        words = words_of(text)
        w = np.fromiter(map(self.held.__getitem__, words), float, len(words))
        hot = np.flatnonzero(w)
        if not len(hot):
            return len(words), []
        # unmarked words between marked ones count as one sum; no maximal segment begins or ends in them
        gaps = np.diff(hot) - 1
        scores = np.empty(2 * len(hot) - 1)
        scores[::2], scores[1::2] = w[hot], -self.drop * gaps
        return len(words), [(s, self.k * len(words) * math.exp(-min(self.lam * s, 700)), int(hot[a // 2]), int(hot[(b - 1) // 2]) + 1) for s, a, b in segments(scores.tolist())]

    @staticmethod
    def features(n: int, found: list[tuple[float, float, int, int]]) -> tuple[float, float, float]:
        real = [(s, e, b - a) for s, e, a, b in found if e <= SIGNIFICANT]
        best = max((-math.log(max(e, 1e-300)) for _, e, _ in real), default=0.0)
        all_ = sum(-math.log(max(e, 1e-300)) for _, e, _ in real)
        return math.log1p(best), math.log1p(all_), sum(x[2] for x in real) / max(n, 1)

    def score(self, n: int, found: list[tuple[float, float, int, int]]) -> float:
        if self.logit is None:
            return 0.0
        *w, c = self.logit
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, c + sum(a * b for a, b in zip(w, self.features(n, found)))))))


def _train(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and toxic of the training sample, one document a family of near copies."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    joined = docs.join(F.broadcast(known), "doc_id").select("doc_id", "text", "toxic")  # SAMPLE rows at most

    def keyed(batches):
        import pyarrow as pa

        for batch in batches:
            keys = [family(words_of(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=["doc_id", "text", "toxic", "family"])

    kind = joined.schema["doc_id"].dataType.simpleString()
    held = C.materialize(joined.mapInArrow(keyed, f"doc_id {kind}, text string, toxic int, family long"), "toxic-train")
    firsts = held.groupBy("family", "toxic").agg(F.min("doc_id").alias("doc_id"))
    return C.materialize(held.join(F.broadcast(firsts), ["family", "toxic", "doc_id"], "left_semi").select("text", "toxic"), "toxic-sample")


def _weighed(counted: DataFrame, n1: float, n0: float) -> DataFrame:
    """counted (key, t, c: documents of either sort with it) with the log-odds and their z."""
    a, all_ = (F.col("t") + F.col("c")) * PRIOR, (n1 + n0) * PRIOR
    odds = F.log((F.col("t") + a) / (n1 + all_)) - F.log((F.col("c") + a) / (n0 + all_))
    return counted.withColumn("odds", odds).withColumn("z", odds / F.sqrt(1 / (F.col("t") + a) + 1 / (F.col("c") + a)))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    train = _train(docs, labels)

    def presence(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                counts: dict[str, list[int]] = {}
                part = batch.slice(at, 500)
                for t, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for w in set(words_of(t)):
                        counts.setdefault(w, [0, 0])[0 if toxic else 1] += 1
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([x[0] for x in counts.values()], pa.int64()), pa.array([x[1] for x in counts.values()], pa.int64())], names=["word", "t", "c"])

    words = C.materialize(train.mapInArrow(presence, "word string, t long, c long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c")), "toxic-words")
    totals = words.agg(F.sum("t").alias("t"), F.sum("c").alias("c")).first()
    n1, n0 = float(totals["t"] or 0), float(totals["c"] or 0)
    empty = Model(({}, {}, frozenset()), 0.05, 1.0, 0.1, None)
    if not n1 or not n0:
        return empty
    marked = (F.col("z") >= LEAST_Z) & (F.col("t") >= LEAST_DOCS) & (F.col("odds") > 1)
    own = {r["word"]: r["odds"] for r in _weighed(words, n1, n0).where(marked).select("word", "odds").collect()}
    starts = {}
    for n in BEGINNINGS:
        by = words.where(F.length("word") > n).groupBy(F.substring("word", 1, n).alias("word")).agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.count_if(F.col("t") > 0).alias("forms"))
        starts |= {r["word"]: r["odds"] for r in _weighed(by, n1, n0).where(marked & (F.col("forms") >= LEAST_FORMS)).select("word", "odds").collect()}
    # words that clean documents use often enough aren't judged by their beginning
    plain = frozenset()
    if starts:
        begins = F.array(*[F.lit(x) for x in sorted(starts)])
        clean = words.where(F.col("c") >= LEAST_DOCS)
        for_any = F.lit(False)
        for n in BEGINNINGS:
            for_any = for_any | F.array_contains(begins, F.substring("word", 1, n))
        clean = clean.where(for_any)
        plain = frozenset(r["word"] for r in clean.select("word").collect()) - own.keys()
    # the log-odds of an unmarked word: what is left of toxic documents' words
    t = sum(r["t"] for r in _weighed(words, n1, n0).where(marked).agg(F.sum("t").alias("t")).collect() if r["t"])
    drop = -math.log(max(1 - t / n1, 0.5)) + 0.01
    model = Model((own, starts, plain), drop, 1.0, 0.1, [0.0] * 4)

    def seen(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, found = model.passages(text)
                rows.append((toxic, n, max((x[0] for x in found), default=0.0), sum(x[3] - x[2] for x in found), *model.features(n, found)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int32() if k < 1 else pa.float64()) for k in range(7)], names=["toxic", "n", "best", "marked", "f0", "f1", "f2"])

    told = "toxic int, n double, best double, marked double, f0 double, f1 double, f2 double"
    rows = train.mapInArrow(seen, told).toPandas()  # SAMPLE rows at most
    clean = rows[rows.toxic == 0]
    # lambda: marked words of clean documents, at their mean weight, against the drop
    p = (float((clean.marked).sum()) + 1) / (float(clean.n.sum()) + 2)
    mean = float(np.mean([*own.values(), *starts.values()] or [1.0]))
    low, high = 1e-3, 5.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if p * math.exp(mid * mean) + (1 - p) * math.exp(-mid * drop) < 1 else (low, mid)
    model.lam = max(low, 0.2)
    # K: how often clean documents reach the least weight, against n exp(-lambda s)
    s = min([*own.values(), *starts.values()], default=1.0)
    model.k = float(np.clip((float((clean.best >= s).sum()) + 1) / (float((clean.n * math.exp(-model.lam * s)).sum()) + 1), 1e-4, 1.0))
    rows = train.mapInArrow(seen, told).toPandas()
    x = np.c_[rows[["f0", "f1", "f2"]].to_numpy(), np.ones(len(rows))]
    y = rows.toxic.to_numpy(float)
    w = np.zeros(4)
    for _ in range(40):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = np.array([0.1, 0.1, 0.1, 1e-6])
        w = w - np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.diag(ridge), x.T @ (q - y) + ridge * w)
    model.logit = w.tolist()
    return model


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score and passages (first word, last word + 1, score, expected number) of each document."""

    def run(batches):
        import pyarrow as pa

        spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                seen = [model.passages(t) for t in part.column(1).to_pylist()]
                found = [[{"start": a, "end": b, "score": s, "expected": e} for s, e, a, b in x if e <= SIGNIFICANT] for _, x in seen]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([model.score(*x) for x in seen], pa.float64()), pa.array(found, spans)], names=["doc_id", "score", "passages"])

    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"doc_id {kind}, score double, passages array<struct<start:int,end:int,score:double,expected:double>>")


def toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and passages of each document."""
    model = fit(docs.select("doc_id", F.col("text").cast("string").alias("text")), labels)
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages")


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is below the threshold, with docs' columns, in one pass over the texts."""
    model = fit(docs.select("doc_id", F.col("text").cast("string").alias("text")), labels)
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                yield part.filter(pa.array([model.score(*model.passages(t)) < threshold for t in part.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
