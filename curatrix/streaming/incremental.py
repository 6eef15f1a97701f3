"""Incremental ingestion with Structured Streaming: what batches do, on files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.operators.catalog import Snapshots, upserted


def first_seen(stream: DataFrame, within: str | None = None, time: str = "ts") -> DataFrame:
    """Rows whose content hasn't been seen; with ``within`` state is kept for that long only."""
    if within:
        return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(["exact_hash"])
    return stream.dropDuplicates(["exact_hash"])


def ingest(spark: SparkSession, source: str, schema: str, root: str) -> None:
    """Upserts all files of source that earlier runs haven't read into the catalog below root, then stops."""
    tables = Snapshots(spark, root)

    def batch(df: DataFrame, epoch: int) -> None:
        new = df.dropDuplicates(["target_path"])
        old = tables.read("items")
        if old is None:
            empty = "id long, target_path string, size_bytes long, mime_type string, exact_hash string, width long, height long, created_at string, meta_json string, group_id long, keep_state string, is_group_primary boolean, group_status string"
            old = spark.createDataFrame([], empty)
        tables.write("items", upserted(old, new))
        tables.append("log", spark.range(1).select(F.lit("ingest").alias("kind"), F.to_json(F.struct(F.lit(epoch).alias("epoch"))).alias("payload_json")))

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{root.rstrip('/')}/_stream").trigger(availableNow=True).start().awaitTermination()
