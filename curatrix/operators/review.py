"""Listings of groups, decisions about them, deletion and restoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.functions import expr as X
from curatrix.operators import dedup, naming
from curatrix.operators.primary import review_primary

DEFAULT_PAGE, LARGEST_PAGE = 20, 1000


def paging(page_index: int | None = None, page_size: int | None = None, page: int | None = None, limit: int | None = None) -> tuple[int, int]:
    """(page index from 0, page size) of a request; the older page (from 1) and limit count where the newer are missing."""
    size = page_size if page_size is not None else limit if limit is not None else DEFAULT_PAGE
    index = page_index if page_index is not None else (page or 1) - 1
    return max(0, index), min(max(1, size), LARGEST_PAGE)


def pending_groups(members: DataFrame) -> DataFrame:
    """group_id and order key of groups with an undecided member."""
    by = members.where("group_id is not null").groupBy("group_id").agg(F.sum(F.when(F.col("keep_state") == "undecided", 1).otherwise(0)).alias("open"), F.min("created_at").alias("m"))
    return by.where("open > 0").select("group_id", F.when(F.col("m") == "", "9999").otherwise(F.col("m")).alias("order_key"))


def trash_groups(members: DataFrame) -> DataFrame:
    by = members.where(F.col("group_id").isNotNull() & X.in_trash(F.col("target_path"))).groupBy("group_id").agg(F.min("created_at").alias("m"))
    return by.select("group_id", F.when(F.col("m") == "", "9999").otherwise(F.col("m")).alias("order_key"))


def page(groups: DataFrame, index: int, size: int) -> DataFrame:
    """One page of groups in order; ties by group_id."""
    return groups.orderBy("order_key", "group_id").offset(index * size).limit(size)


def listing(groups: DataFrame, members: DataFrame) -> DataFrame:
    """A page of groups with their members, by one join."""
    member = F.struct((~F.col("is_group_primary")).alias("later"), "id", "target_path", "size_bytes", "width", "height", "keep_state", "created_at")
    return groups.join(members, "group_id").groupBy("group_id", "order_key").agg(F.sort_array(F.collect_list(member)).alias("members"))


def page_info(n: int, index: int, size: int, empty_page: int = 1) -> dict:
    pages = -(-n // size)
    return {"total": n, "pages": pages, "current_page": min(index + 1, pages) if n else empty_page}


def statuses(members: DataFrame) -> DataFrame:
    """group_id and whether the group is in trash review, pending or completed."""
    trash, open_ = F.bool_or(X.in_trash_by_component(F.col("target_path"))), F.bool_or(F.col("keep_state") == "undecided")
    return members.where("group_id is not null").groupBy("group_id").agg(F.when(trash, "trash-review").when(open_, "pending").otherwise("completed").alias("status"))


def _told(decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decisions (group_id, kept, rejected, primary or null) and their paths (group_id, target_path, to), each once."""
    primary = F.col("primary") if "primary" in decisions.columns else F.lit(None).cast("string")
    d = decisions.select("group_id", F.coalesce("kept", F.array().cast("array<string>")).alias("kept"), F.coalesce("rejected", F.array().cast("array<string>")).alias("rejected"), primary.alias("primary"))
    to = [d.select("group_id", F.explode(c).alias("target_path"), F.lit(c).alias("to")) for c in ("kept", "rejected")]
    return d, to[0].union(to[1]).distinct()


def _after(members: DataFrame, decisions: DataFrame) -> DataFrame:
    """Members of decided groups with to, prime and moves: members in neither list become undecided, only the primary named is one."""
    d, paths = _told(decisions)
    met = members.join(d.select("group_id", "primary"), "group_id").join(paths, ["group_id", "target_path"], "left")
    met = met.withColumn("to", F.coalesce("to", F.lit("undecided"))).withColumn("prime", F.coalesce(F.col("target_path") == F.col("primary"), F.lit(False)))
    return met.withColumn("moves", (F.col("to") == "rejected") & ~X.in_trash_of(F.col("target_path"), F.col("group_id"))).drop("primary")


def resolved(members: DataFrame, decisions: DataFrame) -> DataFrame:
    """A row a decided group: outcome (applied, skipped, failed) and the number of rows that change.

    decisions: group_id, kept and rejected (arrays of paths) and perhaps primary (a path).  A group fails if a path is in both
    lists or isn't a member's, or if its primary isn't kept; it is skipped if no state, primary or path changes.
    """
    d, paths = _told(decisions)
    unknown = paths.join(members.select("group_id", "target_path"), ["group_id", "target_path"], "left_anti").select("group_id").distinct().withColumn("unknown", F.lit(True))
    changes = (F.col("to") != F.col("keep_state")) | (F.col("prime") != F.coalesce("is_group_primary", F.lit(False))) | F.col("moves")
    by = _after(members, decisions).groupBy("group_id").agg(F.count_if(changes).alias("n_changed"))
    out = d.join(unknown, "group_id", "left").join(by, "group_id", "left")
    unkept = F.col("primary").isNotNull() & ~F.array_contains("kept", F.coalesce("primary", F.lit("")))
    failed = F.arrays_overlap("kept", "rejected") | F.coalesce("unknown", F.lit(False)) | unkept
    changed = F.coalesce("n_changed", F.lit(0))
    return out.select("group_id", F.when(failed, "failed").when(changed == 0, "skipped").otherwise("applied").alias("outcome"), F.when(failed, F.lit(0)).otherwise(changed).cast("long").alias("n_changed"))


def decided(members: DataFrame, decisions: DataFrame, root: str) -> DataFrame:
    """members after the valid decisions: new states and primaries, rejected files under their group's trash."""
    ok = resolved(members, decisions).where("outcome = 'applied'").select("group_id")
    after = _after(members, decisions.join(ok, "group_id", "left_semi")).select("id", "group_id", "target_path", "to", "prime", "moves")
    moved = dedup.trash_paths(after.where("moves"), root, members)
    met = members.join(after.select("id", "to", "prime"), "id", "left").join(moved, "id", "left")
    new = {"keep_state": F.coalesce("to", "keep_state"), "is_group_primary": F.coalesce("prime", "is_group_primary"), "target_path": F.coalesce("trash_path", "target_path")}
    return met.select(*[new[c].alias(c) if c in new else F.col(c) for c in members.columns])


def decision_members(members: DataFrame, decisions: DataFrame, root: str) -> DataFrame:
    """(review_group_id, id) of the rows that decisions are about: a group's members, or for groups of the name review (ids below 0)
    the rows whose path is kept, rejected or primary or lies in the group's trash."""
    d, paths = _told(decisions)
    own = members.join(d.where("group_id >= 0").select("group_id"), "group_id").select(F.col("group_id").alias("review_group_id"), "id")
    named = paths.select("group_id", "target_path").union(d.where("primary is not null").select("group_id", "primary")).where("group_id < 0").distinct()
    by_path = members.drop("group_id").join(named, "target_path").select("group_id", "id")
    below = f"{root}{X.TRASH}"
    trash = members.where(F.col("target_path").startswith(below)).select("id", F.split(F.substr("target_path", F.lit(len(below) + 1)), "/")[0].alias("folder"))
    in_trash = trash.join(d.where("group_id < 0").select("group_id", X.trash_folder(F.col("group_id")).alias("folder")), "folder").select("group_id", "id")
    return own.union(by_path.union(in_trash).distinct())


def matches_mode(members: DataFrame) -> DataFrame:
    """group_id and whether it is shown in trash review (a member in the trash) and in pending review (an undecided member)."""
    trash, open_ = F.bool_or(X.in_trash_by_component(F.col("target_path"))), F.bool_or(F.col("keep_state") == "undecided")
    return members.where("group_id is not null").groupBy("group_id").agg(trash.alias("in_trash_review"), open_.alias("in_pending_review"))


def outcomes(resolved_: DataFrame) -> DataFrame:
    return resolved_.groupBy("outcome").agg(F.count("*").alias("n_groups"), F.sum("n_changed").alias("n_changed"))


def restored(members: DataFrame, wanted: DataFrame, root: str, as_of: str) -> DataFrame:
    """Rows that change (id, target_path, keep_state, is_group_primary) when the wanted ids (those in the trash) come back.

    A file goes to its date's folder under its safe name, numbered where live files or others have that name, and is
    kept; a group that has no primary gets one by the review rule.
    """
    back = members.join(wanted.select("id"), "id", "left_semi").where(X.in_trash(F.col("target_path")))
    rows = back.select("id", X.date_folder(F.col("created_at"), as_of).alias("folder"), X.safe_name(X.base_name(F.col("target_path"))).alias("name"))
    live = naming.located(members.where(~X.in_trash(F.col("target_path"))), f"{root}/")
    paths = naming.freed(rows, live, ["id"]).select("id", F.concat(F.lit(f"{root}/"), F.col("folder"), F.lit("/"), F.col("free")).alias("to"))
    groups = back.where("group_id is not null").select("group_id").distinct()
    own = members.join(groups, "group_id", "left_semi")
    bare = own.groupBy("group_id").agg(F.bool_or("is_group_primary").alias("had")).where("not had").select("group_id")
    best = review_primary(own.join(bare, "group_id", "left_semi")).select(F.col("primary_id").alias("id"), F.lit(True).alias("promoted"))
    met = members.join(paths, "id", "left").join(best, "id", "left").where("to is not null or promoted")
    return met.select("id", F.coalesce("to", "target_path").alias("target_path"), F.when(F.col("to").isNotNull(), "kept").otherwise(F.col("keep_state")).alias("keep_state"), F.coalesce("promoted", "is_group_primary").alias("is_group_primary"))


def trash_variants(members: DataFrame, listing_: DataFrame, root: str) -> DataFrame:
    """id and path of rows whose file isn't where the catalog says but lies in its group's trash, the smallest prefix first."""
    lost = members.join(listing_.select("target_path"), "target_path", "left_anti")
    name = X.safe_name(X.base_name(F.col("target_path")))
    want = lost.select("id", F.concat(F.lit(f"{root}{X.TRASH}"), X.trash_folder(F.coalesce("group_id", -F.col("id")))).alias("folder"), name.alias("name"))
    there = listing_.where(X.in_trash(F.col("target_path"))).select("target_path", F.regexp_replace("target_path", r"/[^/]*\z", "").alias("folder"), X.base_name(F.col("target_path")).alias("name"), F.lit(0).alias("n"))
    number = F.regexp_extract("name", r"^([1-9][0-9]*)-.", 1).try_cast("int")
    there = there.union(there.where(number.isNotNull()).select("target_path", "folder", F.regexp_replace("name", "^[0-9]+-", ""), number))
    return want.join(there, ["folder", "name"]).where("n <= 101").groupBy("id").agg(F.min_by("target_path", "n").alias("trash_path"))
