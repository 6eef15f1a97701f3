"""The two rules for a group's primary, and repair of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curatrix.functions import expr as X

TOLERANCE = 0.02


def catalog_primary(members: DataFrame, group: str = "group_id") -> DataFrame:
    """(group, primary_id): images if any, areas within 2 percent of the largest, then size, short path, path."""
    g = W.partitionBy(group)
    rows = members.withColumn("visual_", X.is_visual(F.col("mime_type")))
    rows = rows.withColumn("any_", F.max("visual_").over(g)).where("visual_ = any_").withColumn("area_", F.col("width") * F.col("height"))
    rows = rows.withColumn("most_", F.max("area_").over(g)).where((F.col("most_") - F.col("area_")) / F.greatest("most_", F.lit(1)) < TOLERANCE)
    best = F.min(F.struct((-F.col("size_bytes")).alias("a"), F.octet_length("target_path").alias("b"), "target_path", "id"))
    return rows.groupBy(group).agg(best["id"].alias("primary_id"))


def review_primary(members: DataFrame, group: str = "group_id") -> DataFrame:
    """(group, primary_id): largest area, then size, then smallest id; the area as a wide decimal."""
    area = F.col("width").cast("decimal(19,0)") * F.col("height").cast("decimal(19,0)")
    return members.groupBy(group).agg(F.max_by("id", F.struct(area.alias("a"), F.col("size_bytes"), (-F.col("id")).alias("c"))).alias("primary_id"))


def inconsistent_groups(members: DataFrame) -> DataFrame:
    """Groups of one member, or without exactly one primary."""
    by = members.where("group_id is not null").groupBy("group_id").agg(F.count("*").alias("n"), F.sum(F.col("is_group_primary").cast("long")).alias("primaries"))
    return by.where("n = 1 or primaries <> 1")


def repaired(members: DataFrame) -> DataFrame:
    """id, group_id, is_group_primary and keep_state after repair: lone members leave their group, groups without exactly one primary get theirs anew."""
    bad = inconsistent_groups(members)
    best = catalog_primary(members.join(bad.where("n > 1"), "group_id", "left_semi"))
    rows = members.join(bad.select("group_id", F.col("n").alias("n_")), "group_id", "left").join(best, "group_id", "left")
    lone, redo = F.coalesce(F.col("n_") == 1, F.lit(False)), F.col("n_") > 1
    return rows.select("id", F.when(~lone, F.col("group_id")).alias("group_id"), F.when(lone, False).when(redo, F.col("id") == F.col("primary_id")).otherwise(F.col("is_group_primary")).alias("is_group_primary"), F.when(lone, "undecided").otherwise(F.col("keep_state")).alias("keep_state"))


def after_deletion(members: DataFrame, deleted: DataFrame) -> DataFrame:
    """Surviving rows of groups that lost members: one survivor leaves the group, a group without primary gets one by the review rule."""
    touched = members.join(deleted.select("id"), "id", "left_semi").where("group_id is not null").select("group_id").distinct()
    left = members.join(deleted.select("id"), "id", "left_anti").join(touched, "group_id", "left_semi")
    by = left.groupBy("group_id").agg(F.count("*").alias("n_"), F.max("is_group_primary").alias("had_"))
    rows = left.join(by, "group_id").join(review_primary(left), "group_id")
    return rows.select("id", F.when(F.col("n_") > 1, F.col("group_id")).alias("group_id"), F.when(F.col("n_") <= 1, False).when(~F.col("had_"), F.col("id") == F.col("primary_id")).otherwise(F.col("is_group_primary")).alias("is_group_primary"))
