"""Mixing sources to target weights.

Words are summed by source.  Each source gets a target, its documents the repetition rate
target / source size, and each document is emitted floor(rate) times plus one more time if its
hash, seen as a number in [0, 1), is below the fraction of the rate.

Cases: a null text has size 0; null sources are one source, last in order; a source of size 0
has the target 0; an empty table gives no rows; rows repeated with one doc_id draw alike; of the
table only the named columns are read, so further columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common as C

WEIGHTS = (5, 2, 1)
TOTAL = 1.5
MOST = 2


def draw(doc_id: Column) -> Column:
    """In [0, 1), from the first 52 bits of the MD5 of the id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def ranked(sources: DataFrame, key: str) -> DataFrame:
    """sources with rank (from 0, by code point, null last), without bringing all into one task."""
    spark = sources.sparkSession
    ordered = sources.repartitionByRange(F.col(key).isNull(), F.col(key)).withColumn("part", F.spark_partition_id())
    ordered = C.materialize(ordered, "mix-sources")
    counts = sorted((r["part"], r["n"]) for r in ordered.groupBy("part").agg(F.count("*").alias("n")).collect())
    before, at = [], 0
    for part, n in counts:
        before.append((part, at))
        at += n
    offsets = spark.createDataFrame(before, "part int, before long")
    inside = F.row_number().over(W.partitionBy("part").orderBy(F.col(key).asc_nulls_last())) - 1
    return ordered.withColumn("inside", inside).join(F.broadcast(offsets), "part").withColumn("rank", F.col("inside") + F.col("before")).drop("part", "inside", "before")


def targets(sizes: DataFrame, source: str = "source", weights: tuple = WEIGHTS, total: float = TOTAL, most: float = MOST) -> tuple[DataFrame, int]:
    """(source, source_size, target) and the number of sources.

    Weights go round by rank.  Targets share ``total`` times all words by weight; a target stops
    at ``most`` times its source's size and the excess is shared again by weight among the others.
    Each round is one sum over the sources, so their number isn't bounded by the driver.
    """
    by = C.materialize(ranked(sizes.groupBy(source).agg(F.sum("size").alias("source_size")), source), "mix-ranked")
    n = by.count()
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", weight)
    room = F.col("source_size") * F.lit(most)
    words = (by.agg(F.sum("source_size")).first()[0] or 0) * total
    held, left, level = 0, None, None
    while True:
        free = F.lit(True) if level is None else F.lit(float(level)) * F.col("weight") < room
        row = by.agg(F.sum(F.when(~free, room)).alias("held"), F.sum(F.when(free, F.col("weight"))).alias("left")).first()
        if (row["held"] or 0, row["left"]) == (held, left) or not row["left"]:
            break
        held, left = row["held"] or 0, row["left"]
        level = (words - held) / left
    if left is None:
        target = F.lit(0.0)
    else:
        target = F.least(room.cast("double"), F.lit(float(words - held)) * F.col("weight") / F.lit(float(left)))
    return by.select(source, "source_size", target.cast("double").alias("target")), n


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken = size * copies of each row of docs."""
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.size(C.words(F.col(text))).cast("long").alias("size"))
    sized = C.materialize(sized, "mix-sizes")
    by, n = targets(sized, **how)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # a salt that doesn't follow the id's order: the draw has its own hash
    mixed = C.join_keyed(sized, by, "source", n, F.xxhash64("doc_id"))
    copies = (F.floor(rate) + (draw(F.col("doc_id")) < rate - F.floor(rate)).cast("long")).cast("long")
    mixed = mixed.withColumn("copies", copies)
    return mixed.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def emit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """docs, each row as often as the mix takes it; the columns of docs.

    Copies are made in place: targets come from the aggregate, and the text isn't shuffled
    when the sources are few enough to be broadcast.
    """
    rate, n_copies = (C.free_name(c, docs.columns) for c in ("rate", "n_copies"))
    sized = docs.select(F.col(source).alias("source"), F.size(C.words(F.col(text))).cast("long").alias("size"))
    by, n = targets(sized, **how)
    by = by.select(F.col("source").alias(source), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias(rate))
    mixed = C.join_keyed(docs, by, source, n, F.xxhash64(doc_id))
    copies = (F.floor(rate) + (draw(F.col(doc_id)) < F.col(rate) - F.floor(rate)).cast("long")).cast("int")
    return mixed.withColumn(n_copies, F.explode(F.array_repeat(F.lit(0), copies))).select(*docs.columns)
