"""Approximate nearest neighbours by an inverted multi-index.

Vectors are halved and each half is quantised on its own with k-means; a pair of centroids is a
cell.  A query walks the pairs in order of the summed distance of its halves (the negative inner products)
with a heap, until the cells hold enough vectors; what they hold is ranked by exact inner product.
How many are enough is measured when the index is fitted: the part of all vectors at which
``RECALL`` of the sample's true neighbours are reached.

Centroids and that part come from a bounded sample, the ``SAMPLE`` vectors whose hashes are smallest;
every vector is indexed.  Equal vectors are indexed once with their smallest ids, so large groups of copies
take no more room than one.  Cells are packed into shards of about ``SHARD`` vectors, large cells are
split over several, and queries meet a shard's vectors in blocks of about ``BLOCK`` queries.

Cases: vectors that are null, all zero or hold a null or non-finite component, rows with a null id,
and vectors of another length than most take no part; fewer than ``k`` candidates are all returned;
an empty table gives no rows; equal scores go by smaller id; ids repeated with one vector count
once; further columns aren't read.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

SAMPLE, CALIBRATE, RECALL = 20_000, 300, 0.97
SHARD, BLOCK = 4096, 4096


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k centroids, by Lloyd's rounds from a fixed random start."""
    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(1) - 2 * (x @ c.T)).argmin(1)


class Index:
    """The codebooks, and where the vectors of each cell are."""

    def __init__(self, sample: np.ndarray, n: int, k: int):
        self.half = sample.shape[1] // 2
        size = max(1, min(256, round((n / 200) ** 0.5), len(sample)))
        self.a, self.b = _kmeans(sample[:, : self.half], size), _kmeans(sample[:, self.half :], size)
        self.size = size
        self.part = self._part(sample, k)

    def cells(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x[:, : self.half], self.a) * self.size + _nearest(x[:, self.half :], self.b)

    def walk(self, q: np.ndarray):
        """The cells by growing summed distance to q, one by one."""
        da, db = -(self.a @ q[: self.half]), -(self.b @ q[self.half :])
        oa, ob = np.argsort(da, kind="stable").tolist(), np.argsort(db, kind="stable").tolist()
        da, db = np.sort(da, kind="stable").tolist(), np.sort(db, kind="stable").tolist()
        heap = [(da[0] + db[0], 0, 0)]
        while heap:
            _, i, j = heapq.heappop(heap)
            yield oa[i] * self.size + ob[j]
            # (i, j + 1) always, (i + 1, 0) once: each pair is offered by exactly one other
            if j + 1 < self.size:
                heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
            if j == 0 and i + 1 < self.size:
                heapq.heappush(heap, (da[i + 1] + db[0], i + 1, 0))

    def _part(self, sample: np.ndarray, k: int) -> float:
        if len(sample) <= 4 * k:
            return 1.0
        cells = self.cells(sample)
        held = np.bincount(cells, minlength=self.size**2)
        reached = []
        for i in np.linspace(0, len(sample) - 1, min(CALIBRATE, len(sample))).astype(int):
            scores = sample @ sample[i]
            scores[i] = -np.inf
            at = np.zeros(self.size**2)
            total = 0
            for c in self.walk(sample[i]):
                at[c] = total = total + held[c]
            reached += at[cells[np.argpartition(-scores, k)[:k]]].tolist()
        return float(np.quantile(reached, RECALL) / len(sample))

    def place(self, counts: dict[int, int]) -> None:
        """Packs cells into shards: cell -> (first shard, number of shards)."""
        self.counts, self.shards, shard, room = counts, {}, 0, SHARD
        for cell in sorted(counts):
            n = counts[cell]
            if n > SHARD:
                shard += room < SHARD
                pieces = -(-n // SHARD)
                self.shards[cell] = (shard, pieces)
                shard, room = shard + pieces, SHARD
            else:
                if n > room:
                    shard, room = shard + 1, SHARD
                self.shards[cell] = (shard, 1)
                room -= n
        self.enough = int(np.ceil(self.part * sum(counts.values())))

    def visited(self, q: np.ndarray) -> dict[int, list[int]]:
        """The cells that a query visits, by shard."""
        out: dict[int, list[int]] = {}
        total = 0
        for cell in self.walk(q):
            n = self.counts.get(cell)
            if n:
                first, pieces = self.shards[cell]
                for s in range(first, first + pieces):
                    out.setdefault(s, []).append(cell)
                total += n
                if total >= self.enough:
                    break
        return out


def _vectors(column) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def search(table: DataFrame, every: int = 20, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of each row whose id is divisible by ``every``."""
    spark = table.sparkSession
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    v = F.col("v")
    rows = table.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("v"))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & F.forall(v, finite) & F.exists(v, lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    result = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], result)
    rows = rows.where(F.size("v") == lengths["n"]).distinct()
    # equal vectors once, with the k + 1 smallest ids: the limit is applied before the exchange too
    least = rows.withColumn("r", F.row_number().over(W.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    groups = C.materialize(least.groupBy("v").agg(F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("ids")), "ann-groups")
    queries = C.materialize(rows.where(F.col("id") % every == 0).join(groups.select("v", "rep"), "v").select("id", "rep"), "ann-queries")
    n = groups.count()
    sample = groups.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("v").toPandas()["v"]
    index = Index(np.stack([np.asarray(x, np.float64) for x in sample]), n, k)

    def locate(batches):
        import pyarrow as pa

        for batch in batches:
            cells = index.cells(_vectors(batch.column(0))) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32())], names=["v", "rep", "ids", "cell"])

    kind = groups.schema["v"].dataType.simpleString()
    located = C.materialize(groups.select("v", "rep", "ids").mapInArrow(locate, f"v {kind}, rep long, ids array<long>, cell int"), "ann-cells")
    index.place({r["cell"]: r["count"] for r in located.groupBy("cell").count().collect()})  # at most 256 ** 2 cells

    asked = located.join(queries.select("rep").distinct(), "rep", "left_semi").select("v", "rep")
    blocks = max(1, -(-asked.count() // BLOCK))

    def ask(batches):
        import pyarrow as pa

        for batch in batches:
            x, reps, vs = _vectors(batch.column(0)), batch.column(1).to_pylist(), batch.column(0).to_pylist()
            out = []
            for q, rep, raw in zip(x, reps, vs):
                out += [(s, rep * 2654435761 % 2**32 % blocks, rep, raw, cells) for s, cells in index.visited(q).items()]
                if len(out) > 2000:
                    yield shaped(out)
                    out = []
            if out:
                yield shaped(out)

    def shaped(out):
        import pyarrow as pa

        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float32() if "float" in kind else pa.float64()), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["shard", "block", "q", "qv", "cells"])

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            cells, reps = batch.column(3).to_pylist(), batch.column(1).to_pylist()
            shards = [first + rep * 2654435761 % 2**32 % pieces for (first, pieces), rep in zip(map(index.shards.__getitem__, cells), reps)]
            for b in range(blocks):
                yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array([b] * len(shards), pa.int32()), *batch.columns], names=["shard", "block", "v", "rep", "ids", "cell"])

    asks = asked.mapInArrow(ask, f"shard int, block int, q long, qv {kind}, cells array<int>")
    held = located.mapInArrow(deal, f"shard int, block int, v {kind}, rep long, ids array<long>, cell int")

    def rank(ask, held):
        import pandas as pd

        if not len(ask) or not len(held):
            return pd.DataFrame({"q": [], "id": [], "score": []})
        q = np.stack(ask["qv"].to_numpy()).astype(np.float64)
        x = np.stack(held["v"].to_numpy()).astype(np.float64)
        own, ids = held["cell"].to_numpy(), held["ids"].to_numpy()
        want = np.zeros((len(q), index.size**2), bool)
        for i, cells in enumerate(ask["cells"]):
            want[i, np.asarray(cells)] = True
        out = []
        for at in range(0, len(q), 256):
            scores = np.where(want[at : at + 256][:, own], q[at : at + 256] @ x.T, -np.inf)
            m = min(k + 1, len(x))
            low = np.partition(scores, len(x) - m, axis=1)[:, len(x) - m]
            for i, (s, least) in enumerate(zip(scores, low)):
                for j in np.flatnonzero((s >= least) & (s > -np.inf)):  # with the ties at the end
                    exact = float(np.dot(q[at + i], x[j]))
                    out += [(ask["q"].iat[at + i], d, exact) for d in ids[j]]
        frame = pd.DataFrame(out, columns=["q", "id", "score"])
        frame = frame.sort_values(["q", "score", "id"], ascending=[True, False, True])
        return frame.groupby("q").head(k + 1)

    best = asks.groupBy("shard", "block").cogroup(held.groupBy("shard", "block")).applyInPandas(rank, "q long, id long, score double")
    order = W.partitionBy("q").orderBy(F.desc("score"), "id")
    best = C.materialize(best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "id", "score"))).alias("found")), "ann-best")
    # rows of one vector share its list; each leaves itself out
    own = C.join_keyed(queries.withColumnRenamed("rep", "q"), best, "q", best.count(), F.xxhash64("id"), how="inner")
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("id")), 1, k)
    return own.select(F.col("id").alias("query_id"), F.posexplode(others).alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
