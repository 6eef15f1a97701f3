"""Exact duplicates: canonical rows, what is new, and where new rows go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions import expr as X
from curatrix.operators import naming


def present_and_hashed(items: DataFrame) -> DataFrame:
    return items.where((F.col("scan_status") == "present") & (F.col("exact_hash") != ""))


def canonical_order() -> list[Column]:
    """Images first, then area, size, short path in bytes and path."""
    return [X.is_visual(F.col("mime_type")).desc(), (F.col("width") * F.col("height")).desc(), F.col("size_bytes").desc(), F.octet_length("target_path").asc(), F.col("target_path").asc(), F.col("id").asc()]


def canonical(items: DataFrame) -> DataFrame:
    """One row a content hash: canonical_id and the number of copies.

    The best row is an argmin over a struct, so each task sends one row a hash.
    """
    key = F.struct((~X.is_visual(F.col("mime_type"))).alias("a"), (-F.col("width") * F.col("height")).alias("b"), (-F.col("size_bytes")).alias("c"), F.octet_length("target_path").alias("d"), F.col("target_path").alias("e"), F.col("id").alias("f"))
    return items.where("exact_hash <> ''").groupBy("exact_hash").agg(F.min(key)["f"].alias("canonical_id"), F.count("*").alias("n_copies"))


def duplicate_groups(items: DataFrame) -> DataFrame:
    return items.where("exact_hash <> ''").groupBy("exact_hash").agg(F.count("*").alias("n_copies"), F.min("id").alias("first_id"), F.sum("size_bytes").alias("total_bytes")).where("n_copies > 1")


def new_canonicals(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """Canonical rows whose content the catalog doesn't have."""
    return canonical(items).join(catalog.select("exact_hash"), "exact_hash", "left_anti")


def target_paths(items: DataFrame, root: str, as_of: str, existing: DataFrame | None = None) -> DataFrame:
    """id and the path each new row gets: root/date/safe name, with -1, -2 ... where names meet (naming.freed), in order of content."""
    rows = items.select("id", "exact_hash", X.date_folder(F.col("created_at"), as_of).alias("folder"), X.safe_name(X.base_name(F.col("target_path"))).alias("name"))
    held = None if existing is None else naming.located(existing, f"{root}/")
    out = naming.freed(rows, held, ["exact_hash", "id"])
    return out.select("id", F.concat(F.lit(f"{root}/"), F.col("folder"), F.lit("/"), F.col("free")).alias("new_path"))


def trash_paths(members: DataFrame, root: str, existing: DataFrame | None = None) -> DataFrame:
    """id and the path in its group's trash: its safe name, with 1-, 2- ... in front where names meet or are in the trash already."""
    folder = X.trash_folder(F.coalesce("group_id", -F.col("id")))
    rows = members.select("id", folder.alias("folder"), X.safe_name(X.base_name(F.col("target_path"))).alias("name"))
    held = None if existing is None else naming.located(existing, f"{root}{X.TRASH}")
    out = naming.freed(rows, held, ["id"], style="prefix")
    return out.select("id", F.concat(F.lit(f"{root}{X.TRASH}"), F.col("folder"), F.lit("/"), F.col("free")).alias("trash_path"))
