"""Similarity by Hamming distance of 64-bit hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curatrix.functions import expr as X
from curatrix.sources.tables import materialize

#: Sides of at most so many rows (two longs and a hash each) are sent to all tasks whole.
WHOLE = 20_000
#: Beyond that, hashes are dealt into blocks of about so many (under 1 MB), at least LEAST_BLOCKS of them.
BLOCK, LEAST_BLOCKS = 100_000, 12


def simhash(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id and the 64-bit simhash of a text's distinct lower-case tokens.

    Votes are counted two to a long, in 32-bit lanes, so a row carries 32 sums and not 64.
    """
    tokens = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda t: t != ""))
    rows = docs.select(F.col(doc_id).alias("id"), F.explode_outer(tokens).alias("t"))
    rows = rows.select("id", F.conv(F.substring(F.md5(F.col("t").cast("binary")), 1, 16), 16, -10).cast("long").alias("h"))
    lanes = F.lit(0x0000000100000001)
    sums = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(lanes)).alias(f"c{k}") for k in range(32)]
    counted = rows.groupBy("id").agg(F.count("h").alias("n"), *sums)
    out = F.lit(0).cast("long")
    for b in range(64):
        count = F.shiftrightunsigned(f"c{b % 32}", 32 * (b // 32)).bitwiseAND(F.lit(0xFFFFFFFF))
        out = out.bitwiseOR(F.when(count * 2 > F.col("n"), F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0).cast("long")))
    return counted.select("id", out.alias("h"))


def sign_hash(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """id and the signs of the first 64 components as bits."""
    v = F.col(embedding)
    out = F.lit(0).cast("long")
    for b in range(64):
        out = out.bitwiseOR(F.when(F.get(v, F.lit(b)) > 0, F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0).cast("long")))
    return vectors.select(F.col(vec_id).alias("id"), out.alias("h"))


def _near_hashes(hashes: DataFrame, most: int) -> DataFrame:
    """x, y and distance of the different hashes (h) at most ``most`` bits apart, each pair once.

    Every block meets every other one in a task of its own and is compared as arrays, so only hashes are
    dealt out, each once a block.
    """
    blocks = max(LEAST_BLOCKS, -(-hashes.count() // BLOCK))
    dealt = hashes.groupBy(F.pmod(F.xxhash64("h"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list("h").alias("hs"))
    tasks = min(blocks * (blocks + 1) // 2, 4096)
    one = dealt.select(F.col("block").alias("i"), F.col("hs").alias("x")).withColumn("j", F.explode(F.sequence("i", F.lit(blocks - 1)))).repartition(tasks, "i", "j")
    two = dealt.select(F.col("block").alias("j"), F.col("hs").alias("y")).withColumn("i", F.explode(F.sequence(F.lit(0), "j"))).repartition(tasks, "i", "j")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i, j, xs, ys in zip(*(batch.column(k) for k in range(4))):
                x, y = xs.values.to_numpy(), ys.values.to_numpy()
                own, held = i.as_py() == j.as_py(), []
                for k in range(len(x)):
                    rest = y[k + 1 :] if own else y
                    apart = np.bitwise_count((rest ^ x[k]).view(np.uint64))
                    at = np.flatnonzero(apart <= most)
                    if len(at):
                        held.append((np.full(len(at), x[k]), rest[at], apart[at].astype(np.int32)))
                    if held and (k % 1000 == 999 or k == len(x) - 1):
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=["x", "y", "distance"])
                        held = []

    return one.join(two, ["i", "j"]).select("i", "j", "x", "y").mapInArrow(run, "x long, y long, distance int")


def hamming_pairs(items: DataFrame, most: int, method: str = "auto") -> DataFrame:
    """(a, b, distance), a < b, of rows (id, h and, if there, exact_hash) at most ``most`` bits apart.

    Rows of equal content are no pairs, nor, where there is phash_bits, rows whose hashes differ in it or have none.  A counted small side goes to all tasks; beyond that
    the different hashes are compared in blocks, and rows of equal hash, content and width meet others as one.
    """
    items = items.where("h is not null")
    if "exact_hash" not in items.columns:
        items = items.withColumn("exact_hash", F.lit(None).cast("string"))
    bits = F.lit(64)
    if "phash_bits" in items.columns:
        items, bits = items.where("phash_bits > 0"), F.col("phash_bits")
    if method == "whole" or method == "auto" and items.count() <= WHOLE:
        left = items.select(F.col("id").alias("a"), F.col("h").alias("ha"), F.col("exact_hash").alias("xa"), bits.alias("na"))
        right = items.select(F.col("id").alias("b"), F.col("h").alias("hb"), F.col("exact_hash").alias("xb"), bits.alias("nb"))
        distance = X.hamming(F.col("ha"), F.col("hb"))
        wanted = (F.col("a") < F.col("b")) & (distance <= most) & ~F.coalesce(F.col("xa") == F.col("xb"), F.lit(False)) & (F.col("na") == F.col("nb"))
        return left.join(F.broadcast(right), wanted).select("a", "b", distance.cast("int").alias("distance"))
    # content is '' where it isn't known: such rows are pairs of each other
    rows = items.select("id", "h", bits.alias("n"), F.coalesce(F.concat(F.lit("="), "exact_hash"), F.lit("")).alias("content"))
    same = rows.select("h", "n", "content").distinct().withColumn("same", F.monotonically_increasing_id())
    same = materialize(same, "hamming-same")
    members = materialize(rows.join(same, ["h", "n", "content"]).select("same", "id"), "hamming-members")
    hashes = same.select("h").distinct()
    near = _near_hashes(hashes, most)
    near = near.union(hashes.select(F.col("h").alias("x"), F.col("h").alias("y"), F.lit(0).alias("distance")))
    one = same.select(F.col("h").alias("x"), F.col("n").alias("na"), F.col("content").alias("xa"), F.col("same").alias("one"))
    two = same.select(F.col("h").alias("y"), F.col("n").alias("nb"), F.col("content").alias("xb"), F.col("same").alias("two"))
    # of one hash, two contents meet once; only rows of unknown content meet their own
    ordered = (F.col("x") != F.col("y")) | (F.col("xa") < F.col("xb")) | ((F.col("xa") == "") & (F.col("xb") == ""))
    apart = (F.col("na") == F.col("nb")) & ((F.col("xa") != F.col("xb")) | (F.col("xa") == "")) & ordered
    met = near.join(one, "x").join(two, "y").where(apart).select("one", "two", "distance")
    met = met.join(members.select(F.col("same").alias("one"), F.col("id").alias("p")), "one").join(members.select(F.col("same").alias("two"), F.col("id").alias("q")), "two")
    met = met.where((F.col("one") != F.col("two")) & (F.col("p") != F.col("q")) | (F.col("p") < F.col("q")))
    return met.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "distance")


def candidates(pairs: DataFrame, pending: DataFrame) -> DataFrame:
    """(id, other, distance, rank, older) of the pending rows' candidates, nearest first, ties by id.

    A run over the catalog asks for all of them, an import only for those older than the row.
    """
    ends = lambda x, y: F.struct(F.col(x).alias("id"), F.col(y).alias("other"), "distance")
    both = pairs.select(F.inline(F.array(ends("a", "b"), ends("b", "a"))))
    rank = F.row_number().over(W.partitionBy("id").orderBy("distance", "other"))
    return both.join(pending.select("id"), "id", "left_semi").withColumn("rank", rank).withColumn("older", F.col("other") < F.col("id"))


def histogram(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("distance").agg(F.count("*").alias("n_pairs"))


def prewarm(items: DataFrame, pairs: DataFrame, cached: DataFrame) -> DataFrame:
    """Ids that have another candidate and no reusable cached features."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return items.join(ends, "id", "left_semi").join(cached.select("exact_hash", "size_bytes"), ["exact_hash", "size_bytes"], "left_anti").select("id")
