"""Free names: files that meet in a folder are numbered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_SUFFIX, _PREFIX = r"^(.+)-([1-9][0-9]{0,17})((?:\.[^.]*)?)\z", r"^([1-9][0-9]{0,17})-(.+)\z"


def suffixed(name: Column, n: Column) -> Column:
    """a.jpg as a-1.jpg; names that begin with their only dot have no extension."""
    bare = F.regexp_replace(name, r"(?<=.)\.[^.]*\z", "")
    return F.concat(bare, F.lit("-"), n.cast("string"), F.regexp_extract(name, r"^.+(\.[^.]+)\z", 1))


def prefixed(name: Column, n: Column) -> Column:
    return F.concat(n.cast("string"), F.lit("-"), name)


def _suffix_parts(name: Column) -> tuple[Column, Column]:
    return F.concat(F.regexp_extract(name, _SUFFIX, 1), F.regexp_extract(name, _SUFFIX, 3)), F.regexp_extract(name, _SUFFIX, 2)


def _prefix_parts(name: Column) -> tuple[Column, Column]:
    return F.regexp_extract(name, _PREFIX, 2), F.regexp_extract(name, _PREFIX, 1)


def freed(rows: DataFrame, taken: DataFrame | None, order: list[str], style: str = "suffix") -> DataFrame:
    """rows (id, folder, name and the columns of order) with ``free``, a name that is in no other row and not taken (folder, name).

    In each folder the first row of a name keeps it unless it is taken; the others get the smallest numbers, in order,
    that neither taken names nor names of rows use.  Names that came with a number keep it before any is given out, so the result
    doesn't depend on partitions, and two names never give one numbered name.  The k-th free number is k plus the count
    of used numbers that have fewer than k free ones before them, by a running count: nothing is tried out.
    """
    numbered, parts = {"suffix": (suffixed, _suffix_parts), "prefix": (prefixed, _prefix_parts)}[style]
    rows = rows.withColumn("k_", F.row_number().over(W.partitionBy("folder", "name").orderBy(*order)).cast("long") - 1)
    used = rows.select("folder", "name")
    if taken is not None:
        taken = taken.select("folder", "name").distinct()
        rows = rows.join(taken.withColumn("held_", F.lit(1)), ["folder", "name"], "left").withColumn("k_", F.col("k_") + F.coalesce("held_", F.lit(0))).drop("held_")
        used = used.union(taken)
    gaps = _gaps(used.distinct(), numbered, parts)
    kinds = {c: t for c, t in rows.dtypes if c not in ("folder", "name", "k_")}
    events = rows.withColumn("used_", F.lit(0)).unionByName(gaps.select("folder", "name", "k_", F.lit(1).alias("used_"), *[F.lit(None).cast(t).alias(c) for c, t in kinds.items()]))
    before = F.sum("used_").over(W.partitionBy("folder", "name").orderBy("k_", "used_").rowsBetween(W.unboundedPreceding, 0))
    told = events.withColumn("n_", F.col("k_") + before).where("used_ = 0")
    return told.withColumn("free", F.when(F.col("k_") == 0, F.col("name")).otherwise(numbered(F.col("name"), F.col("n_")))).drop("k_", "used_", "n_")


def _gaps(used: DataFrame, numbered: Callable[[Column, Column], Column], parts: Callable[[Column], tuple[Column, Column]]) -> DataFrame:
    """folder, name and, for each used number of it, how many smaller ones are free (k_)."""
    base, number = parts(F.col("name"))
    found = used.select("folder", F.col("name").alias("own_"), base.alias("name"), number.try_cast("long").alias("t_")).where("t_ is not null")
    found = found.where(numbered(F.col("name"), F.col("t_")) == F.col("own_"))
    rank = F.row_number().over(W.partitionBy("folder", "name").orderBy("t_"))
    return found.select("folder", "name", (F.col("t_") - rank).cast("long").alias("k_"))


def located(items: DataFrame, below: str) -> DataFrame:
    """(folder, name) of the paths below a folder; folder is relative to it."""
    path = F.col("target_path")
    inside = items.where(path.startswith(below)).select(F.substr(path, F.lit(len(below) + 1)).alias("p_"))
    inside = inside.where(F.instr("p_", "/") > 0)
    return inside.select(F.regexp_replace("p_", r"/[^/]*\z", "").alias("folder"), F.element_at(F.split("p_", "/"), -1).alias("name"))
