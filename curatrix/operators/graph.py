"""Connected components of edge lists, by alternating large and small stars.

Each round replaces edges by edges to smaller neighbours; minima are partial aggregates, so a node
with very many neighbours meets no single task.  Rounds are cut off by tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from curatrix.sources.tables import discard, materialize


def _directed(edges: DataFrame) -> DataFrame:
    """Every edge from its larger end a to its smaller end b."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node go to its smallest neighbour (or to itself)."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    # an edge (a, b), a > b: a is the larger neighbour of b
    return edges.join(least.select(F.col("a").alias("b"), "m"), "b").select("a", F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and itself, go to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def _kept(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The different edges as a table, with their number and the sum of their hashes, which tell two rounds apart."""
    seen = Observation()
    told = edges.distinct().observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"))
    held = materialize(told, "stars")
    return held, (seen.get["n"], seen.get["s"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of all nodes of the edges; component is the smallest id.

    Self edges give components of one; null ends are left out.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    first = materialize(edges, "edges")
    now, told = _kept(_directed(first))
    while told[0]:
        before, last = now, told
        now, told = _kept(_directed(_small_star(_large_star(now))))
        discard(before)
        if told == last:
            break
    found = now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select("b", "b")).union(first.where("a = b").select("a", "b"))
    return found.groupBy("id").agg(F.min("component").alias("component"))
