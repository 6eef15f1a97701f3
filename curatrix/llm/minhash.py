"""Near duplicates by BagMinHash.

A text is the multiset of its 5-word shingles.  BagMinHash gives a signature whose components
agree between two multisets with the probability of their weighted Jaccard similarity: every
shingle has a hierarchy of Poisson processes over its discretised weight, one for each interval [0, 1),
[1, 2), [2, 4), [4, 8) and so on; a point has a time, a component and a place in the interval, and counts if its place
is below the shingle's weight.  A component's value is its earliest point.  Points are only
generated up to a time by which all components have one, so the work hardly grows with their number.

Signatures are cut in bands; texts that share a band are candidates.  Copies are first reduced to
one text.  In each bucket all texts are compared with the one that meets most texts over all
buckets, then texts of different components with another one, again and again while that finds links, and at last with each
other, unless the triangle inequality for their distances to the first, the number of shingles that they have in common with any
text of another component or the parities of their shingles' counts exclude a link.  Each comparison is of the whole multisets.  Classes are the connected components of links.

Cases: null counts as the empty text; texts without words are alone; texts of fewer than 5 words
have one shingle, all their words; rows repeated with one doc_id are one document in several versions, and a link
of one is a link of all; rows without doc_id take no part and have no class; an empty table gives no
rows; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.operators.graph import connected_components

from . import common as C

SHINGLE, SIMILAR = 5, 0.8
#: A pair of similarity 0.8 shares no band with probability (1 - 0.8 ** 4) ** 20 = 0.00003.
BANDS, ROWS = 20, 4
REMEMBERED = 200_000
#: Texts that all others are compared with in a bucket beyond the first, at most; what they leave is compared whatever the number.
TURNS = 8
#: So many times 64 parity bits.
PARITY = 8

_WORD = re.compile("[^ \t\n\x0b\f\r]+").findall
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's last steps."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    """A word's 64-bit hash, remembered."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()


def multiset(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the different shingles of a text, and how often each occurs."""
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - SHINGLE + 1)
    s = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(h))):
        s += h[k : k + n] * _MULTIPLIERS[k]
    return np.unique(_mix(s + np.uint64(min(len(h), SHINGLE))), return_counts=True)


def signature(h: np.ndarray, w: np.ndarray, m: int = BANDS * ROWS) -> np.ndarray:
    """The BagMinHash signature, m times, of hashes with integer weights."""
    intervals = [(h, np.zeros(len(h)), np.ones(len(h)), w)]
    level, low = 1, 1.0
    while (more := w > low).any():
        key = _mix(h[more] + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64))
        intervals.append((key, np.full(len(key), low), np.full(len(key), low), w[more]))
        level, low = level + 1, low * 2
    key, start, width, top = (np.concatenate(x) for x in zip(*intervals))
    rate = width * m
    until = (math.log(m) + 3) / float(w.sum())
    while True:
        out = np.full(m, np.inf)
        k, s, wd, tp, r, t, step = key, start, width, top, rate, np.zeros(len(key)), 1
        while len(k):
            x = _mix(k + np.uint64(step * 0xD1B54A32D192ED03 % 2**64))
            t = t - np.log((x >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / r
            on = t <= until
            k, s, wd, tp, r, t, x = k[on], s[on], wd[on], tp[on], r[on], t[on], x[on]
            y = _mix(x + np.uint64(0x2545F4914F6CDD1D))
            part = (y & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * m
            place = s + wd * ((y >> np.uint64(32)).astype(np.float64) * 2.0**-32)
            counts = place < tp
            np.minimum.at(out, part[counts].astype(np.int64), t[counts])
            step += 1
        if np.isfinite(out).all():
            return out
        until *= 2


def bands(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band."""
    bits = sig.view(np.uint64).reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        out = _mix(out ^ bits[:, k])
    return out.view(np.int64)


def overlap(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """The multisets' weighted Jaccard similarity."""
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    both = np.minimum(x[1][i], y[1][j]).sum()
    return float(both / max(1, x[1].sum() + y[1].sum() - both))


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, key (equal for texts of equal words) and the bands of each text that has words."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                keys, found = [], []
                for t in part.column(1).to_pylist():
                    words = _WORD(t) if t else []
                    keys.append(hashlib.blake2b(" ".join(words).encode(), digest_size=16).digest() if words else None)
                    found.append(bands(signature(*multiset(words))) if words else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "key", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, key binary, bands array<long>")


def _packed(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id and pack (compressed text) of the documents whose ids are wanted."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack.compress((t or "").encode()) for t in batch.column(1).to_pylist()], pa.binary())], names=["id", "pack"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return C.materialize(docs.join(wanted.select(F.col("id").alias("doc_id")).hint("merge"), "doc_id", "left_semi").mapInArrow(run, f"id {kind}, pack binary"), "near-packs", compression="none")


def verified(pairs: DataFrame, packs: DataFrame) -> DataFrame:
    """pairs (a, b) with their similarity, from the whole texts."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        bag = lambda p: multiset(_WORD(unpack.decompress(p).decode()))
        last = held = None
        for batch in batches:
            out = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if y != last:
                    last, held = y, bag(y)
                out.append(overlap(bag(x), held))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["a", "b", "similarity"])

    kind = pairs.schema["a"].dataType.simpleString()
    one = pairs.join(packs.select(F.col("id").alias("a"), F.col("pack").alias("pack_a")), "a")
    two = one.join(packs.select(F.col("id").alias("b"), F.col("pack").alias("pack_b")), "b")
    return C.materialize(two.select("a", "b", "pack_a", "pack_b").mapInArrow(run, f"a {kind}, b {kind}, similarity double"), "near-verified")


def _labels(members: DataFrame, checked: DataFrame, least: float) -> DataFrame:
    """members with their component under the links checked so far."""
    found = C.materialize(connected_components(checked.where(F.col("similarity") >= least)), "near-components")
    return members.join(found.withColumnRenamed("component", "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))


def _left(members: DataFrame, label: DataFrame) -> DataFrame:
    """bucket, id and label of the members of buckets that several components share."""
    told = members.select("bucket", "id").join(label, "id")
    mixed = told.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("bucket")
    return C.materialize(told.join(mixed, "bucket", "left_semi"), "near-left")


def _masses(left: DataFrame, packs: DataFrame, least: float) -> DataFrame:
    """id, size (shingles, repeats counted), shared (those that texts of other components among left have as well) and their parities.

    Parity bit k tells whether the number of shingles with the hash k modulo their number of bits is odd; each shingle that
    one text has more often than another changes one bit.

    A text of which not even the part ``least`` is shared has no link to another component and is left out.
    """

    def run(batches):
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                bags = [multiset(_WORD(unpack.decompress(p).decode())) for p in part.column(2).to_pylist()]
                times = np.array([len(h) for h, _ in bags], np.int64)
                rows = pa.array(np.repeat(np.arange(len(bags)), times))
                h, w = (np.concatenate([x[k] for x in bags]) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(h.view(np.int64)), pa.array(w)], names=["id", "label", "shingle", "w"])

    kinds = {c: left.schema[c].dataType.simpleString() for c in ("id", "label")}
    ids = left.select("id", "label").distinct().join(packs, "id")
    told = C.materialize(ids.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, shingle long, w long"), "near-shingles")
    place = F.pmod("shingle", F.lit(64 * PARITY))
    bit = lambda k: (F.floor(place / 64) == k) & (F.col("w") % 2 == 1)
    parity = [F.bit_xor(F.when(bit(k), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))).otherwise(F.lit(0).cast("long"))).alias(f"p{k}") for k in range(PARITY)]
    several = told.groupBy("shingle").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("shingle")
    several = C.materialize(several.withColumn("known", F.lit(True)), "near-several")
    sums = told.join(several, "shingle", "left").groupBy("id").agg(F.sum("w").alias("size"), F.sum(F.when(F.col("known"), F.col("w")).otherwise(0)).alias("shared"), *parity)
    sums = C.materialize(sums.where(F.col("shared") + 1e-6 >= least * F.col("size")), "near-masses")
    C.discard(told, several)
    return sums


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILAR) -> DataFrame:
    """doc_id and class_id, the smallest doc_id of its class, of each row of docs."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = C.materialize(signed(docs), "near-signed", compression="none")
    known = rows.where("doc_id is not null and key is not null")
    # copies: one text each, under its smallest id; versions of one id are linked by it
    reps = C.materialize(known.groupBy("key").agg(F.min(F.struct("doc_id", "bands")).alias("x")).select("key", F.col("x.doc_id").alias("id"), F.col("x.bands").alias("bands")), "near-texts", compression="none")
    places = reps.select("id", F.explode("bands").alias("bucket"))
    shared = places.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("x"), F.max("id").alias("y")).where("x <> y").select("bucket", "n")
    held = C.materialize(places.join(shared, "bucket").distinct(), "near-places", compression="none")
    # the text that meets most others stands nearest to the middle of its bucket
    weighed = held.join(held.groupBy("id").agg(F.sum("n").alias("w")), "id")
    middle = weighed.groupBy("bucket").agg(F.max(F.struct("w", (-F.col("id")).alias("m"))).alias("x")).select("bucket", (-F.col("x.m")).alias("pivot"), F.col("x.w").alias("w"))
    members = C.materialize(held.select("id", "bucket").join(middle, "bucket"), "near-members", compression="none")
    packs = _packed(docs, members.select("id").distinct())

    ends = lambda df, x, y: df.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()
    best = members.where("id <> pivot").groupBy("id").agg(F.max(F.struct("w", (-F.col("pivot")).alias("m"))).alias("x")).select("id", (-F.col("x.m")).alias("pivot"))
    checked = verified(ends(best, "id", "pivot"), packs)
    # texts that their best bucket mate doesn't bring together with the others
    label = _labels(members.select("id").distinct(), checked, least)
    label = C.materialize(label, "near-labels")
    other = members.where("id <> pivot").select("id", "pivot").distinct().join(label, "id").join(label.select(F.col("id").alias("pivot"), F.col("label").alias("to")), "pivot").where("label <> to")
    rest = C.materialize(ends(other, "id", "pivot").join(checked.select("a", "b"), ["a", "b"], "left_anti"), "near-rest")
    if not rest.isEmpty():
        checked = C.materialize(checked.union(verified(rest, packs)), "near-checked")
        label = C.materialize(_labels(members.select("id").distinct(), checked, least), "near-labels")
    # again other pivots, in turn of the first's component and of the others, as long as they bring texts together
    firsts = middle.select("bucket", F.col("pivot").alias("first"))
    left = _left(members, label)
    for turn in range(TURNS):
        told = firsts.join(label.select(F.col("id").alias("first"), F.col("label").alias("told")), "first").select("bucket", "told")
        side = (F.col("label") == F.col("told")) if turn % 2 == 0 else (F.col("label") != F.col("told"))
        pick = left.join(told, "bucket").groupBy("bucket").agg(F.max(F.struct(side.alias("side"), F.xxhash64("id", F.lit(turn)).alias("at"), "id", "label")).alias("x"))
        pairs = left.join(pick.select("bucket", F.col("x.id").alias("other"), F.col("x.label").alias("to")), "bucket").where("label <> to")
        again = verified(ends(pairs, "id", "other").join(checked.select("a", "b"), ["a", "b"], "left_anti"), packs)
        checked = checked.union(again)
        n, links = again.agg(F.count("*"), F.count_if(F.col("similarity") >= least)).first()
        if links:
            label = C.materialize(_labels(members.select("id").distinct(), checked, least), "near-labels")
            left = _left(members, label)
        if links * 20 <= n:
            break
    # in buckets of several components, what the distances to their first pivot and the shingles that texts share don't exclude
    far = checked.select(F.col("a").alias("id"), F.col("b").alias("first"), (1 - F.col("similarity")).alias("far"))
    far = far.union(far.select("first", "id", "far"))
    left = left.join(firsts, "bucket").join(far, ["id", "first"], "left").withColumn("far", F.when(F.col("id") == F.col("first"), F.lit(0.0)).otherwise(F.col("far")))
    left = C.materialize(left.select("bucket", "id", "label", "far").join(_masses(left, packs, least), "id"), "near-left")
    parity = [f"p{k}" for k in range(PARITY)]
    mate = left.select("bucket", *[F.col(c).alias(f"{c}2") for c in ("id", "label", "far", "size", "shared", *parity)])
    possible = F.coalesce(F.abs(F.col("far") - F.col("far2")) <= 1 - least + 1e-9, F.lit(True))
    # similarity s of multisets x and y means that s / (1 + s) of |x| + |y| is in both, and (1 - s) / (1 + s) in one alone
    sizes = F.col("size") + F.col("size2")
    possible = possible & (F.least("shared", "shared2") + 1e-6 >= least / (1 + least) * sizes)
    odd = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}2"))) for c in parity), F.lit(0))
    possible = possible & (odd <= (1 - least) / (1 + least) * sizes + 1e-6)
    more = left.join(mate, "bucket").where((F.col("id") > F.col("id2")) & (F.col("label") != F.col("label2")) & possible)
    more = C.materialize(more.select(F.col("id").alias("a"), F.col("id2").alias("b")).distinct().join(checked.select("a", "b"), ["a", "b"], "left_anti"), "near-more")
    # texts, their copies' ids and links: ids of one text, and texts of one id, are together
    versions = C.materialize(known.groupBy("doc_id").agg(F.min("key").alias("key"), F.max("key").alias("last")).where("key <> last").select("doc_id"), "near-versions")
    if more.isEmpty() and versions.isEmpty():
        found = label.select("id", F.col("label").alias("component"))
    else:
        links = checked.union(verified(more, packs)).where(F.col("similarity") >= least).select("a", "b")
        again = known.join(versions, "doc_id", "left_semi").join(reps.select("key", "id"), "key").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
        found = C.materialize(connected_components(links.union(again)), "near-classes")
    of = reps.select("key", "id").join(found, "id", "left").select("key", F.coalesce("component", "id").alias("class_id"))
    grouped = known.select("doc_id", "key").join(of, "key").select("doc_id", "class_id")
    alone = rows.where("doc_id is null or key is null").select("doc_id", F.col("doc_id").alias("class_id"))
    return grouped.union(alone)


def one_of_each(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """docs without near duplicates: of each class the row of the smallest doc_id stays; rows without words or id stay."""
    found = C.alone(lambda: classes(docs, least=least), "near-kept")
    kept = found.where("doc_id = class_id").select("doc_id").distinct()
    # the same join whatever the size of kept: what is dealt out grows with the texts
    out = docs.join(kept.hint("merge"), "doc_id", "left_semi")
    repeated = found.where("doc_id = class_id").groupBy("doc_id").count().where("count > 1").limit(1).count()
    if repeated:
        from pyspark.sql import Window as W

        order = F.row_number().over(W.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last(), *[F.col(c) for c, t in docs.dtypes if c not in ("doc_id", "text") and not t.startswith("map")]))
        name = C.free_name("version", docs.columns)
        out = out.withColumn(name, order).where(F.col(name) == 1).drop(name)
    return out.unionByName(docs.where("doc_id is null")).select(*docs.columns)
