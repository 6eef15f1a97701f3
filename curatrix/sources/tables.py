"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The tables made so far inside alone().
_MADE: ContextVar[list | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's ``spark.checkpoint.dir``.

    Only where that is unset on one machine (tests) a temporary folder is made and set; on a cluster that is an error.
    """
    sc = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    held = sc._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir isn't set: a cluster needs a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="curatrix-"))
        held = sc._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/curatrix/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, so that its lineage ends there."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.option("compression", compression).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.curatrix_path = path
    if (made := _MADE.get()) is not None:
        made.append(back)
    return back


def alone(make: Callable[[], DataFrame], tag: str, compression: str = "zstd") -> DataFrame:
    """The rows of make() as a table; the tables made on the way to it go."""
    made: list[DataFrame] = []
    before = _MADE.set(made)
    try:
        df = make()
        _MADE.reset(before)
        done = materialize(df, tag, compression)
        let_go(done)
        return done
    finally:
        if _MADE.get() is made:
            _MADE.reset(before)
        discard(*made)


def discard(*frames: DataFrame) -> None:
    """Deletes tables of materialize() that nothing reads any more."""
    for df in frames:
        path = getattr(df, "curatrix_path", None)
        if path:
            spark = df.sparkSession
            jvm = spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def let_go(df: DataFrame) -> None:
    """Frees the shuffle files of plans that are done: Spark deletes them once the driver has collected the plans, which may be much later.

    The queues of Spark's events hold the last query that ended, with its plan, so another one, of no rows, takes its place first.
    """
    df.sparkSession.sql("set spark.sql.shuffle.partitions")
    df.sparkSession._jvm.System.gc()
