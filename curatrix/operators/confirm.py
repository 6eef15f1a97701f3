"""Confirmation of candidate pairs by local descriptors: mutual nearest neighbours, then a common affine map."""

from __future__ import annotations

import struct
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


LEAST_MATCHES, LEAST_DESCRIPTORS, MOST_DESCRIPTORS = 10, 25, 500
RATIO, MOST_BITS = 0.75, 96
REACH, LEAST_INLIERS = 8.0, 0.4
EXHAUSTIVE, SAMPLES = 12, 256
# Fixed values of the sampling sequence.
SEED, SEED_STEP, STEP = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 6364136223846793005


def pack_points(points: np.ndarray) -> bytes:
    return struct.pack("<I", len(points)) + np.asarray(points, "<f4").tobytes()


def unpack_points(blob: bytes) -> np.ndarray:
    n = struct.unpack_from("<I", blob)[0]
    if len(blob) != 4 + 8 * n:
        raise ValueError("points: wrong length")
    return np.frombuffer(blob, "<f4", offset=4).reshape(n, 2)


def pack_descriptors(rows: list[bytes]) -> bytes:
    return struct.pack("<I", len(rows)) + b"".join(struct.pack("<I", len(r)) + r for r in rows)


def unpack_descriptors(blob: bytes) -> list[bytes]:
    n, at, out = struct.unpack_from("<I", blob)[0], 4, []
    for _ in range(n):
        if at + 4 > len(blob):
            raise ValueError("descriptors: cut short")
        size = struct.unpack_from("<I", blob, at)[0]
        if at + 4 + size > len(blob):
            raise ValueError("descriptors: cut short")
        out.append(blob[at + 4 : at + 4 + size])
        at += 4 + size
    if at != len(blob):
        raise ValueError("descriptors: bytes left over")
    return out


def mutual_matches(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Pairs that are each other's nearest, clearly nearer than the second and near at all."""
    if len(a) < 2 or len(b) < 2:
        return []
    width = max(map(len, a + b))
    bits = lambda rows: np.unpackbits(np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(len(rows), width), axis=1).astype(np.int32)
    x, y = bits(a), bits(b)
    far = x.sum(1)[:, None] + y.sum(1) - 2 * (x @ y.T)

    def best(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = d.argmin(1)
        two = np.partition(d, 1, axis=1)[:, :2]
        return first, (two[:, 0] < two[:, 1].astype(np.float32) * np.float32(RATIO)) & (two[:, 0] < MOST_BITS)

    (i, ok_a), (j, ok_b) = best(far), best(far.T)
    rows = np.flatnonzero(ok_a & ok_b[i] & (j[i] == np.arange(len(a))))
    return [(int(r), int(i[r])) for r in rows]


def _triples(n: int) -> np.ndarray:
    """All triples of few matches, else a fixed sequence of random ones."""
    if n <= EXHAUSTIVE:
        return np.array(list(combinations(range(n), 3)))
    state, out = SEED ^ (n * SEED_STEP % 2**64), []
    for _ in range(SAMPLES):
        own: list[int] = []
        while len(own) < 3:
            state = (state * STEP + 1) % 2**64
            if (k := (state >> 32) % n) not in own:
                own.append(k)
        out.append(own)
    return np.array(out)


def inliers(a: np.ndarray, b: np.ndarray, matches: list[tuple[int, int]]) -> int:
    """The most matches that one affine map of three of them carries to within REACH."""
    if len(matches) < 3:
        return 0
    p = np.c_[a[[i for i, _ in matches]], np.ones(len(matches), np.float32)].astype(np.float32)
    q = b[[j for _, j in matches]].astype(np.float32)
    t = _triples(len(matches))
    left, right = p[t], q[t]
    sound = np.abs(np.linalg.det(left.astype(np.float64))) > 1e-6
    if not sound.any():
        return 0
    maps = np.linalg.solve(left[sound], right[sound])
    off = np.einsum("nk,mkd->mnd", p, maps) - q
    return int(((off**2).sum(2) <= np.float32(REACH * REACH)).sum(1).max())


def confirmed(a: tuple[bytes | None, bytes | None], b: tuple[bytes | None, bytes | None], least: int = LEAST_MATCHES) -> bool:
    """Whether two ready feature sets (descriptors, points) show one scene."""
    if None in (*a, *b):
        return False
    da, db = unpack_descriptors(a[0]), unpack_descriptors(b[0])
    pa, pb = unpack_points(a[1]), unpack_points(b[1])
    if len(da) != len(pa) or len(db) != len(pb) or min(len(da), len(db)) < LEAST_DESCRIPTORS:
        return False
    matches = mutual_matches(da[:MOST_DESCRIPTORS], db[:MOST_DESCRIPTORS])
    need = max(least, 3)
    if len(matches) < need:
        return False
    n = inliers(pa, pb, matches)
    return n >= need and np.float32(n) / np.float32(len(matches)) >= np.float32(LEAST_INLIERS)


def confirm_pairs(pairs: DataFrame, features: DataFrame, most: int = 14, least: int = LEAST_MATCHES, fallback: bool = True) -> DataFrame:
    """pairs (a, b, distance) that are confirmed, with the reason.

    features: id, status, descriptors, points.  Pairs of two rows without keypoints are decided
    by their hashes alone, in the plan; only pairs of ready rows carry blobs to the workers.
    """
    s = features.select("id", "status")
    told = pairs.join(s.select(F.col("id").alias("a"), F.col("status").alias("sa")), "a").join(s.select(F.col("id").alias("b"), F.col("status").alias("sb")), "b")
    plain = told.where((F.col("sa") == "no_keypoints") & (F.col("sb") == "no_keypoints") & (F.col("distance") <= most) & F.lit(fallback)).select("a", "b", F.lit("hash").alias("reason"))
    blobs = lambda x: features.select(F.col("id").alias(x), F.col("descriptors").alias(f"d{x}"), F.col("points").alias(f"p{x}"))
    ready = told.where((F.col("sa") == "ready") & (F.col("sb") == "ready")).select("a", "b").join(blobs("a"), "a").join(blobs("b"), "b").select("a", "b", "da", "pa", "db", "pb")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ok = [confirmed((da, pa_), (db, pb), least) for da, pa_, db, pb in zip(*[batch.column(k).to_pylist() for k in range(2, 6)])]
            part = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(["descriptors"] * part.num_rows, pa.string())], names=["a", "b", "reason"])

    kind = pairs.schema["a"].dataType.simpleString()
    return plain.union(ready.mapInArrow(run, f"a {kind}, b {kind}, reason string"))
