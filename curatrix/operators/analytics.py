"""Reports over the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions import expr as X


def group_summary(members: DataFrame) -> DataFrame:
    by = members.where("group_id is not null").groupBy("group_id")
    ends = [f(c).alias(f"{n}_{c}") for c in ("width", "height", "size_bytes") for n, f in (("min", F.min), ("max", F.max))]
    return by.agg(F.count("*").alias("n_members"), F.count_distinct("exact_hash").alias("n_hashes"), F.count_distinct("mime_type").alias("n_types"), *ends)


def low_keypoints(items: DataFrame, cache: DataFrame, most: int, like: list[str] | None = None, groups: list[int] | None = None, limit: int | None = None) -> DataFrame:
    out = items.join(cache, ["exact_hash", "size_bytes"]).where((F.col("status") == "ready") & (F.col("keypoints") <= most))
    for pattern in like or ():
        out = out.where(F.col("target_path").ilike(pattern))
    if groups:
        out = out.where(F.col("group_id").isin(groups))
    out = out.select("id", "target_path", "keypoints").orderBy("keypoints", "id")
    return out.limit(limit) if limit else out


def _bare(stem: Column) -> Column:
    """A stem without the number that keeps names apart in front of default."""
    return F.regexp_replace(stem, "^[0-9]+-default", "default")


def _plain(stem: Column) -> Column:
    """A stem without default in front and a rendition's tails behind, other characters than letters and digits as one underscore."""
    out = F.regexp_replace(stem, "^default", "")
    for tail in (r"-[0-9]+\z", r"_(shotwell|embedded)(_[0-9]+)*\z", r"_(arw|cr2|dng|jpg|jpeg|png)\z"):
        out = F.regexp_replace(out, tail, "")
    return F.regexp_replace(out, "[^a-z0-9]+", "_")


#: Stems that have a family.
DERIVED = "shotwell|embedded|^([0-9]+-)?default|^[0-9]{8}-[0-9]{6}"


def name_family(stem: Column) -> Column:
    """The family of a derived file's name; null for names that don't look derived."""
    s = _bare(stem)
    default = F.when(s.contains("shotwell"), "default_shotwell").when(s.contains("embedded"), "default_embedded")
    default = default.when(s.rlike("^default([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{8}[-_][0-9]{6})"), "default_timestamp").when(s.rlike(r"^default[0-9a-f]{32}\z"), "default_hash")
    default = default.when(s.rlike("^default_?(img|dsc|mg)[a-z]?_?[0-9]"), "default_camera").when(s.startswith("default"), "default_other")
    return default.when(s.rlike("^[0-9]{8}-[0-9]{6}"), "timestamp_rendition")


def _number(stem: Column) -> Column:
    return F.regexp_extract(_plain(stem), r"([0-9]{3,18})[^0-9]*\z", 1)


def _digits(stem: Column) -> Column:
    return F.regexp_replace(stem, "[^0-9]", "")


def name_relation() -> Column:
    """How a derived file's stem stands to its primary's: same_core, same_id, adjacent_id, other; for names by time null instead of other."""
    timed = F.col("family") == "timestamp_rendition"
    core = F.when(timed, F.startswith("p_words", "o_day")).otherwise(F.col("p_words") == F.col("o_plain"))
    b = F.when(timed, F.substring("o_stamp", 9, 6)).otherwise(F.col("o_number"))
    same = F.when(timed, F.contains("p_digits", "o_stamp")).otherwise((F.col("p_number") == F.col("o_number")) & (F.col("p_number") != ""))
    near = F.abs(F.col("p_number").try_cast("long") - b.try_cast("long")) == 1
    return F.when(core, "same_core").when(same, "same_id").when(F.coalesce(near, F.lit(False)), "adjacent_id").when(~F.col("family").isin("timestamp_rendition", "default_timestamp"), "other")


def derived_pairs(members: DataFrame, size_ratio: float = 5.0, edge_ratio: float = 2.0, least_edge: int = 1200) -> DataFrame:
    """Pairs of a group's only primary and a much smaller member whose name looks derived, with a category: the name's family and its relation to the primary's."""
    own = members.where("group_id is not null").withColumn("stem", F.coalesce(X.stem(F.col("target_path")), F.lit(""))).withColumn("edge", F.greatest("width", "height"))
    s = _bare(F.col("stem"))
    of = {
        "p": {"p_words": F.regexp_replace(s, "[^a-z0-9]+", "_"), "p_digits": _digits(s), "p_number": _number(s)},
        "o": {"o_plain": _plain(s), "o_day": F.regexp_replace(F.substring(s, 1, 15), "-", "_"), "o_stamp": F.substring(_digits(s), 1, 14), "o_number": _number(s)},
    }
    names = lambda side: [x.alias(c) for c, x in of[side].items()]
    single = own.groupBy("group_id").agg(F.count("*").alias("n"), F.count_if(F.col("is_group_primary")).alias("primaries")).where("n > 1 and primaries = 1")
    own = own.join(single, "group_id", "left_semi")
    p = own.where("is_group_primary").select("group_id", F.col("id").alias("primary_id"), F.col("size_bytes").alias("ps"), F.col("edge").alias("pe"), *names("p"))
    # one condition on the stem: a filter on the family would be pushed below the join with every branch of it written out
    o = own.where(~F.col("is_group_primary") & F.col("stem").rlike(DERIVED)).withColumn("family", name_family(F.col("stem")))
    o = o.select("group_id", F.col("id").alias("other_id"), F.col("size_bytes").alias("os"), F.col("edge").alias("oe"), "family", *names("o"))
    met = p.join(o, "group_id").where((F.col("ps") >= size_ratio * F.col("os")) & (F.col("pe") >= edge_ratio * F.col("oe")) & (F.col("pe") >= least_edge))
    return met.select("group_id", "primary_id", "other_id", F.concat_ws(":", "family", name_relation()).alias("category"))


def categories(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("category").agg(F.count("*").alias("n_pairs"), F.count_distinct("group_id").alias("n_groups"))


def snapshot(members: DataFrame, cache: DataFrame, group_id: int) -> DataFrame:
    """A group's rows with their cached features, primary first."""
    return members.where(F.col("group_id") == group_id).join(cache, ["exact_hash", "size_bytes"], "left").orderBy(F.desc("is_group_primary"), "id")


def bridges(components: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the number of other edges that either end has in its component: 0 on a side marks a leaf, both large and few across marks a bridge to look at."""
    deg = edges.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return edges.join(deg.select(F.col("id").alias("a"), (F.col("n") - 1).alias("other_a")), "a").join(deg.select(F.col("id").alias("b"), (F.col("n") - 1).alias("other_b")), "b").join(components.select(F.col("id").alias("a"), "component"), "a")


def preview(thumbs: DataFrame, least: int, item: str = "item") -> DataFrame:
    """(item, position) of the preview to take: of formats jpeg, bitmap and bitmap16 the smallest whose longer edge is at least ``least``, else the largest.

    Small and large go by longer edge, area and format; of equals the first small and the last large by position.
    """
    rank = F.when(F.col("format") == "bitmap", 3).when(F.col("format") == "bitmap16", 2).when(F.col("format") == "jpeg", 1)
    edge, area = F.greatest("width", "height"), F.col("width").cast("long") * F.col("height")
    rows = thumbs.withColumn("rank_", rank).where("rank_ is not null").select(item, "position", edge.alias("edge_"), F.struct(edge.alias("e"), area.alias("a"), "rank_", "position").alias("key_"))
    return rows.groupBy(item).agg(F.coalesce(F.min(F.when(F.col("edge_") >= least, F.col("key_"))), F.max("key_"))["position"].alias("position"))
