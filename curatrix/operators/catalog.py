"""State of the catalog: merges, feature cache, marks and the operations log.

Tables are immutable snapshots: a merge is a join that gives the next one.  :class:`Snapshots` keeps
them as Parquet folders with a pointer that is written last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions import expr as X
from curatrix.operators.primary import catalog_primary

FACTS = ("size_bytes", "mime_type", "exact_hash", "width", "height")


class Snapshots:
    """Versions of tables below one folder; a single writer at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self, table: str) -> list[int]:
        folder = self.path(f"{self.root}/{table}")
        if not self.fs.exists(folder):
            return []
        done = [s.getPath() for s in self.fs.listStatus(folder) if self.fs.exists(self.path(s.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName()[2:]) for p in done if p.getName().startswith("v="))

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        held = self.versions(table)
        if not held:
            return None
        return self.spark.read.parquet(f"{self.root}/{table}/v={held[-1] if version is None else version}")

    def write(self, table: str, df: DataFrame) -> int:
        version = (self.versions(table) or [0])[-1] + 1
        df.write.parquet(f"{self.root}/{table}/v={version}")
        return version

    def append(self, table: str, df: DataFrame) -> None:
        """For logs: rows are added to version 1."""
        df.write.mode("append").parquet(f"{self.root}/{table}/v=1")


def upserted(old: DataFrame, new: DataFrame, overwrite_meta: bool = True) -> DataFrame:
    """The next catalog: facts of new rows by target_path, workflow state of old ones.

    An empty created_at keeps the old one, as does an empty meta_json unless metadata is
    always overwritten.  New paths get ids after the largest, in order of path.
    """
    n = new.select("target_path", *[F.col(c).alias(f"n_{c}") for c in (*FACTS, "created_at", "meta_json")], F.lit(True).alias("n_"))
    both = old.join(n, "target_path", "full_outer")
    here = F.col("n_").isNotNull()
    text = lambda c: F.coalesce(F.when(F.col(f"n_{c}") != "", F.col(f"n_{c}")), F.col(c), F.lit(""))
    meta = F.when(here, F.col("n_meta_json")).otherwise(F.col("meta_json")) if overwrite_meta else text("meta_json")
    fresh = both.where("id is null").select("target_path")
    most = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("most"))
    ids = ranked(fresh, "target_path").join(F.broadcast(most)).select("target_path", (F.col("most") + F.col("rank")).alias("new_id"))  # one row
    both = both.join(ids, "target_path", "left")
    return both.select(
        F.coalesce("id", "new_id").alias("id"), "target_path", *[F.when(here, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in FACTS],
        text("created_at").alias("created_at"), meta.alias("meta_json"), "group_id",
        F.coalesce("keep_state", F.lit("undecided")).alias("keep_state"), F.coalesce("is_group_primary", F.lit(False)).alias("is_group_primary"), F.coalesce("group_status", F.lit("pending")).alias("group_status"),
    )


def ranked(df: DataFrame, key: str) -> DataFrame:
    """df with rank from 1 by key, by ranges: no task sees more than its range."""
    from pyspark.sql import Window as W

    from curatrix.sources.tables import materialize

    dealt = materialize(df.repartitionByRange(F.col(key)).withColumn("part_", F.spark_partition_id()), "ranked")
    counts = sorted((r["part_"], r["count"]) for r in dealt.groupBy("part_").count().collect())  # one row a partition
    before, at = [], 0
    for p, n in counts:
        before.append((p, at))
        at += n
    offsets = df.sparkSession.createDataFrame(before, "part_ int, before_ long")
    inside = F.row_number().over(W.partitionBy("part_").orderBy(key))
    return dealt.withColumn("in_", inside).join(F.broadcast(offsets), "part_").withColumn("rank", F.col("in_") + F.col("before_")).drop("part_", "in_", "before_")


def marked_missing(items: DataFrame, seen: DataFrame) -> DataFrame:
    """id and scan_status: missing where the run hasn't seen the row's path."""
    s = seen.select("target_path", F.lit(True).alias("seen_")).distinct()
    return items.join(s, "target_path", "left").select("id", F.when(F.col("seen_").isNotNull(), "present").otherwise("missing").alias("scan_status"))


def vanished(items: DataFrame, listing: DataFrame) -> DataFrame:
    return items.join(listing.select("target_path"), "target_path", "left_anti")


def pending(items: DataFrame) -> DataFrame:
    """The rows that a grouping run still has to do; one that was interrupted goes on with them."""
    return items.where("group_status = 'pending'")


def completed(items: DataFrame, done: DataFrame) -> DataFrame:
    """items with the rows of done marked completed."""
    d = done.select("id", F.lit(True).alias("done_")).distinct()
    status = F.when(F.col("done_"), "completed").otherwise(F.col("group_status"))
    return items.join(d, "id", "left").withColumn("group_status", status).select(*items.columns)


def pruned(items: DataFrame, listing: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, cache) without rows whose file has vanished and without the cache rows that only those used.

    Of the groups that lost rows, lone members leave and the others get their primary anew by the catalog's rule.
    """
    key, gone = ["exact_hash", "size_bytes"], vanished(items, listing)
    left = items.join(listing.select("target_path"), "target_path", "left_semi")
    hit = gone.where("group_id is not null").select("group_id").distinct()
    own = left.join(hit, "group_id", "left_semi")
    by = own.groupBy("group_id").agg(F.count("*").alias("n_")).join(catalog_primary(own), "group_id")
    met = left.join(by, "group_id", "left")
    lone = F.coalesce(F.col("n_") == 1, F.lit(False))
    new = {
        "group_id": F.when(~lone, F.col("group_id")),
        "keep_state": F.when(lone, "undecided").otherwise(F.col("keep_state")),
        "is_group_primary": F.when(lone, False).when(F.col("n_") > 1, F.col("id") == F.col("primary_id")).otherwise(F.col("is_group_primary")),
    }
    unused = gone.select(*key).distinct().join(left.select(*key), key, "left_anti")
    return met.select(*[new[c].alias(c) if c in new else F.col(c) for c in items.columns]), cache.join(unused, key, "left_anti")


def unchanged(listing: DataFrame, items: DataFrame) -> DataFrame:
    """listing with whether size and modification time are those the catalog holds, so the file needn't be read."""
    own = items.select("target_path", F.col("size_bytes").alias("s_"), X.fingerprint_time(F.col("meta_json")).alias("m_"), "exact_hash", "created_at")
    same = (F.col("size_bytes") == F.col("s_")) & (F.col("modified_at") == F.col("m_")) & (F.col("exact_hash") != "") & (F.col("created_at") != "")
    return listing.join(own, "target_path", "left").withColumn("skip", F.coalesce(same, F.lit(False))).select(*listing.columns, "skip")


def scan_reuse(items: DataFrame) -> DataFrame:
    """Per content the facts of the smallest id that has any, for rows whose features needn't be computed again."""
    own = items.where("exact_hash <> ''")
    return own.groupBy("exact_hash", "size_bytes").agg(F.min_by(F.struct("id", "width", "height"), F.when(F.col("width") > 0, F.col("id"))).alias("x")).where("x is not null").select("exact_hash", "size_bytes", "x.*")


# feature cache


def normalized(cache: DataFrame) -> DataFrame:
    """The cache as the current version keeps it; columns status, keypoints, feature_version, has_descriptors, has_points."""
    old = F.col("feature_version") != X.FEATURE_VERSION
    gone = (old & F.col("has_descriptors") & ~F.col("has_points")) | (old & (F.col("status") == "no_keypoints"))
    status = (
        F.when(F.col("status") == "unavailable", "decode_error")
        .when(old & F.col("has_descriptors") & F.col("has_points"), "ready")
        .when(F.col("status") == "too_small", "too_small")
        .when(~F.col("has_descriptors") & F.col("status").isin("ready", "pending"), "decode_error")
        .otherwise(F.col("status"))
    )
    return cache.where(~gone).withColumn("status", status).withColumn("feature_version", F.lit(X.FEATURE_VERSION))


def cache_merged(into: DataFrame, source: DataFrame) -> DataFrame:
    """Both caches: current source rows replace rows that are to be retried, or any if they aren't themselves."""
    key = ["exact_hash", "size_bytes"]
    rest = [c for c in into.columns if c not in key]
    s = source.where(F.col("feature_version") == X.FEATURE_VERSION).select(*key, *[F.col(c).alias(f"s_{c}") for c in rest], F.lit(True).alias("s_"))
    both = into.withColumn("d_", F.lit(True)).join(s, key, "full_outer")
    take = F.col("s_").isNotNull() & (F.col("d_").isNull() | X.retryable(F.col("status")) | ~X.retryable(F.col("s_status")))
    return both.select(*key, *[F.when(take, F.col(f"s_{c}")).otherwise(F.col(c)).alias(c) for c in rest])


def orphans(cache: DataFrame, items: DataFrame) -> DataFrame:
    return cache.join(items.select("exact_hash", "size_bytes"), ["exact_hash", "size_bytes"], "left_anti")


def reusable(cache: DataFrame) -> DataFrame:
    return cache.where(X.reusable(F.col("status"), F.col("keypoints"), F.col("feature_version")))


def read_through(items: DataFrame, cache: DataFrame, compute) -> DataFrame:
    """items with features: from the cache where reusable, else compute(misses), which gives the cache's columns."""
    key = ["exact_hash", "size_bytes"]
    ready = reusable(cache)
    hits = items.join(ready, key)
    return hits.unionByName(compute(items.join(ready.select(*key), key, "left_anti")), allowMissingColumns=True)


def logged(kind: str, payload: Column, at: str) -> list[Column]:
    return [F.lit(kind).alias("kind"), F.to_json(payload).alias("payload_json"), F.lit(at).alias("created_at")]


def latest_operations(log: DataFrame, group_id: int, n: int = 50) -> DataFrame:
    """The last n operations whose payload mentions the group's id (also as the beginning of a longer one)."""
    return log.where(F.contains("payload_json", F.lit(f'"group_id":{group_id}'))).orderBy(F.desc("id")).limit(n)


def refingerprinted(items: DataFrame, listing: DataFrame) -> DataFrame:
    """id and meta_json with the listing's modification time where the row has none and the sizes agree; other keys stay.

    JSON that isn't an object counts as empty.
    """
    missing = F.coalesce(X.fingerprint_time(F.col("meta_json")), F.lit("")) == ""
    seen = listing.select("target_path", F.col("modified_at").alias("m_"), F.col("size_bytes").alias("s_"))
    own = items.where(missing).join(seen, "target_path").where("s_ = size_bytes")
    meta = "coalesce(try_cast(try_parse_json(meta_json) as map<string, variant>), cast(map() as map<string, variant>))"
    finger = f"coalesce(try_cast({meta}['fingerprint'] as map<string, variant>), cast(map() as map<string, variant>))"
    told = "map('size_bytes', cast(s_ as variant), 'modified_at', cast(m_ as variant))"
    finger = f"map_concat(map_filter({finger}, (k, v) -> k not in ('size_bytes', 'modified_at')), {told})"
    return own.select("id", F.expr(f"to_json(map_concat(map_filter({meta}, (k, v) -> k <> 'fingerprint'), map('fingerprint', to_variant_object({finger}))))").alias("meta_json"))


def reset_low_keypoints(items: DataFrame, cache: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The catalog and cache without rows whose features are ready with at most ``most`` keypoints."""
    low = cache.where((F.col("status") == "ready") & (F.col("keypoints") <= most)).select("exact_hash", "size_bytes")
    return items.join(low, ["exact_hash", "size_bytes"], "left_anti"), cache.join(low, ["exact_hash", "size_bytes"], "left_anti")
