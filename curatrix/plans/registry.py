"""The registered catalog queries, each with SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curatrix.functions import expr as X
from curatrix.operators import analytics, catalog, confirm, dedup, families, primary, review, similar
from curatrix.operators.graph import connected_components
from curatrix.sources.tables import materialize
from curatrix.sources.views import view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

NEAR, NEAR_VECTORS = 14, 20
AS_OF = "2024-06-01"
T, FT = X.TRASH, f"{X.TRASH}filename-group-"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return add


_BEST = "lower(trim(mime_type)) LIKE 'image/%' DESC, width * height DESC, size_bytes DESC, strlen(target_path), target_path, id"


@query(f"""SELECT exact_hash, id AS canonical_id, n_copies FROM (SELECT *, row_number() OVER (PARTITION BY exact_hash ORDER BY {_BEST}) AS r,
    count(*) OVER (PARTITION BY exact_hash) AS n_copies FROM doc_items) WHERE r = 1""")
def exact_dup_canonical(spark, d):
    return dedup.canonical(view(spark, d, "doc_items"))


@query(f"""SELECT exact_hash, id AS canonical_id, n_copies FROM (SELECT *, row_number() OVER (PARTITION BY exact_hash ORDER BY {_BEST}) AS r,
    count(*) OVER (PARTITION BY exact_hash) AS n_copies FROM media_items WHERE exact_hash <> '') WHERE r = 1""")
def media_canonical(spark, d):
    return dedup.canonical(view(spark, d, "media_items"))


@query("SELECT exact_hash, count(*) AS n_copies, min(id) AS first_id, sum(size_bytes)::BIGINT AS total_bytes FROM doc_items GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(spark, d):
    return dedup.duplicate_groups(view(spark, d, "doc_items"))


@query(f"""SELECT exact_hash, id AS canonical_id, n_copies FROM (SELECT *, row_number() OVER (PARTITION BY exact_hash ORDER BY {_BEST}) AS r,
    count(*) OVER (PARTITION BY exact_hash) AS n_copies FROM doc_items) c WHERE r = 1
    AND NOT EXISTS (SELECT 1 FROM doc_items o WHERE o.id % 2 = 0 AND o.exact_hash = c.exact_hash)""")
def new_canonicals_anti(spark, d):
    items = view(spark, d, "doc_items")
    return dedup.new_canonicals(items, items.where("id % 2 = 0"))


@query("SELECT id, exact_hash FROM media_items WHERE scan_status = 'present' AND exact_hash <> ''")
def present_hashed_filter(spark, d):
    return dedup.present_and_hashed(view(spark, d, "media_items")).select("id", "exact_hash")


# Fixed values, written out here again so that the SQL doesn't share the operators' constants.
_RAW = """'image/x-sony-arw', 'image/x-sony-sr2', 'image/x-canon-cr2', 'image/x-canon-cr3', 'image/x-nikon-nef', 'image/x-nikon-nrw', 'image/x-adobe-dng',
    'image/x-fuji-raf', 'image/x-olympus-orf', 'image/x-panasonic-rw2', 'image/x-pentax-pef', 'image/x-sigma-x3f', 'image/x-hasselblad-3fr', 'image/x-raw'"""


@query(f"SELECT id, lower(trim(mime_type)) LIKE 'image/%' AS visual, lower(trim(mime_type)) IN ({_RAW}) AS raw, mime_type IN ('', 'application/octet-stream', 'application/x-empty', 'inode/x-empty') AS generic FROM media_items")
def visual_eligibility(spark, d):
    m = F.col("mime_type")
    return view(spark, d, "media_items").select("id", X.is_visual(m).alias("visual"), X.is_raw(m).alias("raw"), X.is_generic(m).alias("generic"))


@query("SELECT m.id, f.status, f.keypoints FROM media_items m JOIN feature_cache f USING (exact_hash, size_bytes)")
def cache_join_inner(spark, d):
    return view(spark, d, "media_items").join(view(spark, d, "feature_cache"), ["exact_hash", "size_bytes"]).select("id", "status", "keypoints")


@query("SELECT m.id, f.status, f.keypoints FROM media_items m LEFT JOIN feature_cache f USING (exact_hash, size_bytes)")
def cache_join_left(spark, d):
    return view(spark, d, "media_items").join(view(spark, d, "feature_cache"), ["exact_hash", "size_bytes"], "left").select("id", "status", "keypoints")


@query("SELECT exact_hash, size_bytes FROM feature_cache f WHERE NOT EXISTS (SELECT 1 FROM media_items m WHERE m.exact_hash = f.exact_hash AND m.size_bytes = f.size_bytes)")
def cache_orphans_anti(spark, d):
    return catalog.orphans(view(spark, d, "feature_cache"), view(spark, d, "media_items")).select("exact_hash", "size_bytes")


@query("SELECT count(DISTINCT group_id) AS n_pending FROM group_items WHERE group_id IN (SELECT group_id FROM group_items WHERE keep_state = 'undecided')")
def pending_groups_semi(spark, d):
    g = view(spark, d, "group_items")
    return g.join(g.where("keep_state = 'undecided'").select("group_id"), "group_id", "left_semi").agg(F.count_distinct("group_id").alias("n_pending"))


@query(f"SELECT count(DISTINCT group_id) AS n_trash FROM group_items WHERE contains(target_path, '{T}')")
def trash_groups_count(spark, d):
    return view(spark, d, "group_items").where(X.in_trash(F.col("target_path"))).agg(F.count_distinct("group_id").alias("n_trash"))


@query("SELECT id, target_path FROM group_items WHERE target_path NOT IN (SELECT target_path FROM group_items WHERE id % 10 <> 3)")
def vanished_rows_anti(spark, d):
    g = view(spark, d, "group_items")
    return catalog.vanished(g, g.where("id % 10 <> 3")).select("id", "target_path")


@query("""SELECT exact_hash, size_bytes, id, width, height FROM (SELECT *, row_number() OVER (PARTITION BY exact_hash, size_bytes ORDER BY id) AS r
    FROM media_items WHERE exact_hash <> '' AND width > 0) WHERE r = 1""")
def reuse_lookup(spark, d):
    return catalog.scan_reuse(view(spark, d, "media_items"))


_FINGER = """CASE WHEN meta_json LIKE '%"modified_at":"%' THEN regexp_extract(meta_json, '"modified_at":"([^"]*)"', 1) END"""


@query(f"""SELECT l.target_path, l.size_bytes, l.modified_at, coalesce(l.size_bytes = m.size_bytes AND l.modified_at = {_FINGER} AND m.exact_hash <> '' AND m.created_at <> '', false) AS skip
    FROM (SELECT target_path, CASE WHEN id % 7 = 0 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes, CAST(n AS STRING) AS modified_at FROM media_items) l
    LEFT JOIN (SELECT * FROM media_items) m USING (target_path)""")
def unchanged_skip(spark, d):
    m = view(spark, d, "media_items")
    listing = m.select("target_path", F.expr("case when id % 7 = 0 then size_bytes + 1 else size_bytes end").alias("size_bytes"), F.col("n").cast("string").alias("modified_at"))
    return catalog.unchanged(listing, m)


_TAKE = "s.feature_version IS NOT NULL AND (d.status IS NULL OR d.status IN ('pending', 'decode_error') OR s.status NOT IN ('pending', 'decode_error'))"


@query(f"""SELECT exact_hash, size_bytes, CASE WHEN {_TAKE} THEN s.status ELSE d.status END AS status, CASE WHEN {_TAKE} THEN s.keypoints ELSE d.keypoints END AS keypoints
    FROM (SELECT * FROM feature_cache WHERE size_bytes % 3 <> 0) d
    FULL JOIN (SELECT exact_hash, size_bytes, CASE WHEN keypoints % 2 = 0 THEN 'decode_error' ELSE status END AS status, keypoints + 1 AS keypoints, feature_version FROM feature_cache
               WHERE size_bytes % 3 <> 1 AND feature_version = 7) s USING (exact_hash, size_bytes)""")
def feature_cache_merge(spark, d):
    f = view(spark, d, "feature_cache").select("exact_hash", "size_bytes", "status", "keypoints", "feature_version")
    other = f.where("size_bytes % 3 <> 1").withColumn("status", F.expr("case when keypoints % 2 = 0 then 'decode_error' else status end")).withColumn("keypoints", F.col("keypoints") + 1)
    return catalog.cache_merged(f.where("size_bytes % 3 <> 0"), other).drop("feature_version")


@query("""SELECT exact_hash, size_bytes, CASE WHEN status = 'unavailable' THEN 'decode_error' WHEN feature_version <> 7 AND has_descriptors AND has_points THEN 'ready'
    WHEN status = 'too_small' THEN 'too_small' WHEN NOT has_descriptors AND status IN ('ready', 'pending') THEN 'decode_error' ELSE status END AS status, 7 AS feature_version
    FROM feature_cache WHERE NOT (feature_version <> 7 AND ((has_descriptors AND NOT has_points) OR status = 'no_keypoints'))""")
def feature_cache_normalize(spark, d):
    return catalog.normalized(view(spark, d, "feature_cache")).select("exact_hash", "size_bytes", "status", "feature_version")


@query("SELECT exact_hash, size_bytes, status FROM feature_cache WHERE feature_version = 7 AND status NOT IN ('pending', 'decode_error') AND (status <> 'ready' OR keypoints >= 25)")
def reusable_features(spark, d):
    return catalog.reusable(view(spark, d, "feature_cache")).select("exact_hash", "size_bytes", "status")


@query("""SELECT id, target_path, keypoints FROM group_items JOIN feature_cache USING (exact_hash, size_bytes) WHERE status = 'ready' AND keypoints <= 60 AND target_path ILIKE '%.jpg'
    ORDER BY keypoints, id LIMIT 40""")
def low_keypoint_report(spark, d):
    return analytics.low_keypoints(view(spark, d, "group_items"), view(spark, d, "feature_cache"), 60, ["%.jpg"], limit=40)


@query("SELECT id FROM group_items g WHERE NOT EXISTS (SELECT 1 FROM feature_cache f WHERE f.exact_hash = g.exact_hash AND f.size_bytes = g.size_bytes AND f.status = 'ready' AND f.keypoints <= 40)")
def low_keypoint_reset(spark, d):
    return catalog.reset_low_keypoints(view(spark, d, "group_items"), view(spark, d, "feature_cache"), 40)[0].select("id")


_U64 = "('0x' || {x})::UBIGINT"
_SIGNED = "CASE WHEN {x} >= 9223372036854775808 THEN ({x}::HUGEINT - 18446744073709551616)::BIGINT ELSE {x}::BIGINT END"


@query(f"SELECT id, {_SIGNED.format(x=_U64.format(x='substr(exact_hash, 1, 16)'))} ::VARCHAR AS phash_value FROM doc_items UNION ALL SELECT -id, NULL FROM doc_items WHERE id % 2 = 0")
def phash_decode(spark, d):
    items = view(spark, d, "doc_items")
    whole = items.select("id", F.base64(F.unhex(F.substring("exact_hash", 1, 16))).alias("p"))
    short = items.where("id % 2 = 0").select((-F.col("id")).alias("id"), F.lit("AAAA").alias("p"))
    return whole.union(short).select("id", X.phash_value(F.col("p")).cast("string").alias("phash_value"))


SIM = f"""tok AS (SELECT DISTINCT doc_id AS id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS t FROM documents),
    hashed AS (SELECT id, {_U64.format(x="substr(md5(t), 1, 16)")} AS h FROM tok WHERE t <> ''),
    votes AS (SELECT id, b, sum(CASE WHEN (h >> b::UBIGINT) & 1 = 1 THEN 1 ELSE -1 END) AS v FROM hashed, range(64) r(b) GROUP BY id, b),
    whole AS (SELECT id, sum(CASE WHEN v > 0 THEN 1::HUGEINT << b::INT ELSE 0 END) AS s FROM votes GROUP BY id),
    sims AS (SELECT d.doc_id AS id, CASE WHEN coalesce(s, 0) >= 9223372036854775808 THEN (s - 18446744073709551616)::BIGINT ELSE coalesce(s, 0)::BIGINT END AS h,
                    sha256(d.text) AS exact_hash FROM documents d LEFT JOIN whole w ON w.id = d.doc_id)"""
PAIRS = f"""pairs AS (SELECT x.id AS a, y.id AS b, bit_count(xor(x.h, y.h))::INT AS distance FROM sims x JOIN sims y
    ON x.id < y.id AND bit_count(xor(x.h, y.h)) <= {NEAR} AND x.exact_hash <> y.exact_hash)"""
COMPONENTS = """sym AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach(a, b) AS (SELECT a, b FROM sym UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a),
    comp AS (SELECT a AS id, least(a, min(b)) AS component FROM reach GROUP BY a)"""


def sims(spark, d) -> DataFrame:
    h = similar.simhash(spark.read.parquet(f"{d}/documents.parquet"))
    return materialize(h.join(view(spark, d, "doc_items"), "id"), "simhashes")


@query(f"WITH {SIM} SELECT id, h FROM sims")
def simhash_documents(spark, d):
    return similar.simhash(spark.read.parquet(f"{d}/documents.parquet"))


@query(f"WITH {SIM}, {PAIRS} SELECT a, b, distance FROM pairs")
def hamming_pairs_documents(spark, d):
    return similar.hamming_pairs(sims(spark, d), NEAR)


VEC = """vec AS (SELECT vec_id AS id, sum(CASE WHEN embedding[b + 1] > 0 THEN 1::HUGEINT << b::INT ELSE 0 END) AS s FROM embeddings, range(64) r(b) GROUP BY vec_id),
    vh AS (SELECT id, CASE WHEN s >= 9223372036854775808 THEN (s - 18446744073709551616)::BIGINT ELSE s::BIGINT END AS h FROM vec)"""


@query(f"WITH {VEC} SELECT x.id AS a, y.id AS b, bit_count(xor(x.h, y.h))::INT AS distance FROM vh x JOIN vh y ON x.id < y.id AND bit_count(xor(x.h, y.h)) <= {NEAR_VECTORS}")
def hamming_pairs_embeddings(spark, d):
    return similar.hamming_pairs(similar.sign_hash(spark.read.parquet(f"{d}/embeddings.parquet")), NEAR_VECTORS)


@query(f"WITH {SIM}, {PAIRS} SELECT a, b, distance FROM pairs")
def hamming_pairs_indexed(spark, d):
    return similar.hamming_pairs(sims(spark, d), NEAR, method="index")


@query(f"WITH {SIM}, {PAIRS} SELECT distance, count(*) AS n_pairs FROM pairs GROUP BY distance")
def hamming_histogram(spark, d):
    return similar.histogram(similar.hamming_pairs(sims(spark, d), NEAR))


@query(f"""WITH {SIM}, {PAIRS} SELECT DISTINCT i.id FROM doc_items i JOIN (SELECT a AS id FROM pairs UNION SELECT b FROM pairs) e ON e.id = i.id
    WHERE NOT EXISTS (SELECT 1 FROM doc_items c WHERE c.id % 3 = 0 AND c.exact_hash = i.exact_hash AND c.size_bytes = i.size_bytes)""")
def prewarm_candidates(spark, d):
    items = sims(spark, d)
    return similar.prewarm(items, similar.hamming_pairs(items, NEAR), items.where("id % 3 = 0"))


@query(f"""WITH {SIM}, {PAIRS}, sized AS (SELECT id, CASE WHEN size_bytes % 2 = 0 THEN 64 ELSE 256 END AS n, mime_type = 'text/plain' AS pending FROM doc_items),
    same AS (SELECT p.* FROM pairs p JOIN sized x ON x.id = p.a JOIN sized y ON y.id = p.b AND x.n = y.n), both_ AS (SELECT a AS id, b AS other, distance FROM same UNION ALL SELECT b, a, distance FROM same)
    SELECT id, other, distance, (row_number() OVER (PARTITION BY id ORDER BY distance, other))::INT AS rank, other < id AS older FROM both_ JOIN sized USING (id) WHERE pending""")
def pending_candidates(spark, d):
    """Documents in English stand for the pending rows; hashes of even and odd sizes have different widths."""
    items = sims(spark, d).withColumn("phash_bits", F.expr("case when size_bytes % 2 = 0 then 64 else 256 end"))
    pairs = similar.hamming_pairs(items, NEAR)
    return similar.candidates(pairs, items.where("mime_type = 'text/plain'"))


@query(f"WITH RECURSIVE {SIM}, {PAIRS}, {COMPONENTS} SELECT id, component FROM comp")
def near_dup_components(spark, d):
    return connected_components(similar.hamming_pairs(sims(spark, d), NEAR))


_A4 = """vis AS (SELECT *, lower(trim(mime_type)) LIKE 'image/%' AS visual FROM grouped), pool AS (SELECT *, max(visual::INT) OVER (PARTITION BY g) AS any_ FROM vis),
    area AS (SELECT *, max(width * height) OVER (PARTITION BY g) AS most FROM pool WHERE visual::INT = any_),
    best AS (SELECT g, id AS primary_id, row_number() OVER (PARTITION BY g ORDER BY size_bytes DESC, strlen(target_path), target_path, id) AS r
             FROM area WHERE (most - width * height) / greatest(most, 1)::DOUBLE < 0.02)"""


@query(f"""WITH RECURSIVE {SIM}, {PAIRS}, {COMPONENTS}, grouped AS (SELECT i.*, component AS g FROM comp JOIN doc_items i USING (id)), {_A4}
    SELECT g AS component, primary_id, n_members FROM best JOIN (SELECT component AS g, count(*) AS n_members FROM comp GROUP BY 1) USING (g) WHERE r = 1""")
def near_dup_primary(spark, d):
    items = sims(spark, d)
    found = materialize(connected_components(similar.hamming_pairs(items, NEAR)), "near")
    members = items.join(found, "id")
    n = members.groupBy("component").agg(F.count("*").alias("n_members"))
    return primary.catalog_primary(members, "component").join(n, "component")


@query(f"WITH RECURSIVE {SIM}, {PAIRS}, {COMPONENTS} SELECT id, component FROM comp")
def cluster_incremental_merge(spark, d):
    """Labels of an earlier run are seed edges of the next, which only adds edges of new rows."""
    pairs = materialize(similar.hamming_pairs(sims(spark, d), NEAR), "pairs")
    old = connected_components(pairs.where("b % 2 = 0 and a % 2 = 0")).where("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b"))
    return connected_components(pairs.where("b % 2 = 1 or a % 2 = 1").select("a", "b").union(old))


@query("SELECT group_id, count(*) AS n, sum(is_group_primary::INT)::BIGINT AS primaries FROM group_items WHERE group_id IS NOT NULL GROUP BY 1 HAVING count(*) = 1 OR sum(is_group_primary::INT) <> 1")
def group_consistency_violations(spark, d):
    return primary.inconsistent_groups(view(spark, d, "group_items"))


_BAD = "bad AS (SELECT group_id, count(*) AS n FROM group_items WHERE group_id IS NOT NULL GROUP BY 1 HAVING count(*) = 1 OR sum(is_group_primary::INT) <> 1)"


@query(f"""WITH {_BAD}, grouped AS (SELECT i.*, i.group_id AS g FROM group_items i JOIN bad b ON b.group_id = i.group_id AND b.n > 1), {_A4}
    SELECT i.id, CASE WHEN b.n = 1 THEN NULL ELSE i.group_id END AS group_id, CASE WHEN b.n = 1 THEN false WHEN b.n > 1 THEN i.id = p.primary_id ELSE i.is_group_primary END AS is_group_primary,
           CASE WHEN b.n = 1 THEN 'undecided' ELSE i.keep_state END AS keep_state
    FROM group_items i LEFT JOIN bad b ON b.group_id = i.group_id LEFT JOIN (SELECT * FROM best WHERE r = 1) p ON p.g = i.group_id""")
def group_repair(spark, d):
    return primary.repaired(view(spark, d, "group_items"))


@query("SELECT group_id, arg_max(id, row(width * height, size_bytes, -id)) AS primary_id FROM group_items WHERE group_id IS NOT NULL GROUP BY 1")
def review_primary(spark, d):
    return primary.review_primary(view(spark, d, "group_items").where("group_id is not null"))


@query("SELECT coalesce(max(group_id), 0) AS max_group_id FROM group_items")
def max_group_id(spark, d):
    return view(spark, d, "group_items").agg(F.coalesce(F.max("group_id"), F.lit(0)).alias("max_group_id"))


@query("""SELECT group_id, CASE WHEN m = '' THEN '9999' ELSE m END AS order_key FROM (SELECT group_id, min(created_at) AS m FROM group_items WHERE group_id IS NOT NULL GROUP BY 1
    HAVING sum(CASE WHEN keep_state = 'undecided' THEN 1 ELSE 0 END) > 0) ORDER BY order_key, group_id LIMIT 20 OFFSET 40""")
def pending_page(spark, d):
    index, size = review.paging(page=3)
    return review.page(review.pending_groups(view(spark, d, "group_items")), index, size)


@query(f"""SELECT group_id, CASE WHEN m = '' THEN '9999' ELSE m END AS order_key FROM (SELECT group_id, min(created_at) AS m FROM group_items
    WHERE group_id IS NOT NULL AND contains(target_path, '{T}') GROUP BY 1) ORDER BY order_key, group_id LIMIT 25""")
def trash_page(spark, d):
    index, size = review.paging(page_index=0, page_size=25)
    return review.page(review.trash_groups(view(spark, d, "group_items")), index, size)


@query(f"""SELECT group_id, CASE WHEN bool_or(contains(target_path, '{T}')) THEN 'trash-review' WHEN bool_or(keep_state = 'undecided') THEN 'pending' ELSE 'completed' END AS status
    FROM group_items WHERE group_id IS NOT NULL GROUP BY 1""")
def group_status(spark, d):
    return review.statuses(view(spark, d, "group_items"))


@query("""SELECT group_id, count(*) AS n_members, count(DISTINCT exact_hash) AS n_hashes, count(DISTINCT mime_type) AS n_types, min(width) AS min_width, max(width) AS max_width,
    min(height) AS min_height, max(height) AS max_height, min(size_bytes) AS min_size_bytes, max(size_bytes) AS max_size_bytes FROM group_items WHERE group_id IS NOT NULL GROUP BY 1""")
def group_snapshot_summary(spark, d):
    return analytics.group_summary(view(spark, d, "group_items"))


def families_sql(items: str) -> str:
    if items == "group_items":
        items = "(SELECT * FROM group_items WHERE group_id IS NULL AND (instr(target_path, '/.catalog/trash/') = 0 OR instr(target_path, '/.catalog/trash/filename-group-') > 0)) g"
    tails = "b0"
    for tail in (r"_(shotwell|embedded(_[0-9]+)*)$", r"_(arw|cr2|jpg|jpeg|png)$", r"-[0-9]+$"):
        tails = f"regexp_replace({tails}, '{tail}', '')"
    stamp = lambda x: f"CASE WHEN regexp_matches({x}, '[0-9]{{8}}[-_][0-9]{{6}}') THEN 'timestamp:' || substr(regexp_extract({x}, '[0-9]{{8}}[-_][0-9]{{6}}'), 1, 8) || '-' || substr(regexp_extract({x}, '[0-9]{{8}}[-_][0-9]{{6}}'), 10, 6) END"
    return f"""named AS (SELECT *, nullif(regexp_extract(lower(string_split(target_path, '/')[-1]), '^(.+)\\.([^.]+)$', 1), '') AS stem FROM {items}),
    stripped AS (SELECT *, CASE WHEN starts_with(regexp_replace(stem, '^[0-9]+-', ''), 'default') THEN substr(regexp_replace(stem, '^[0-9]+-', ''), 8) END AS b0 FROM named WHERE stem IS NOT NULL),
    based AS (SELECT *, nullif({tails}, '') AS base FROM stripped),
    cand AS (SELECT *, base IS NOT NULL AS default_named, base IS NOT NULL OR regexp_matches(stem, '^[0-9]{{8}}-[0-9]{{6}}(-[0-9]+)?$') AS derived,
        CASE WHEN width = height THEN 'square' WHEN height > width THEN 'portrait' ELSE 'landscape' END AS orientation,
        CASE WHEN base IS NOT NULL THEN ['subject:' || base, {stamp("base")}]
             ELSE ['subject:' || stem, CASE WHEN regexp_matches(stem, '^img_[0-9]{{8}}_[0-9]{{6}}_[0-9]{{3,5}}$') THEN 'subject:img_' || regexp_extract(stem, '_([0-9]+)$', 1) END, {stamp("stem")}] END AS ks FROM based)"""


_KEYED = "keyed AS (SELECT DISTINCT id, orientation, unnest(ks) AS key FROM nodes)"
_FPAIRS = "pairs AS (SELECT DISTINCT x.id AS a, y.id AS b FROM keyed x JOIN keyed y ON x.key = y.key AND x.orientation = y.orientation AND x.id < y.id)"


@query(f"WITH {families_sql('media_items')} SELECT id, array_to_string(list_sort(list_distinct(ks)), ',') AS keys, derived FROM cand")
def family_keys(spark, d):
    return families.candidates(view(spark, d, "media_items")).select("id", F.array_join("keys", ",").alias("keys"), "derived")


@query(f"WITH {families_sql('media_items')}, nodes AS (SELECT * FROM cand), {_KEYED}, {_FPAIRS} SELECT a, b FROM pairs")
def family_edges(spark, d):
    return families.edges(families.candidates(view(spark, d, "media_items")))


@query(f"WITH RECURSIVE {families_sql('media_items')}, nodes AS (SELECT * FROM cand WHERE keep_state = 'undecided'), {_KEYED}, {_FPAIRS}, {COMPONENTS} SELECT id, component FROM comp")
def family_components(spark, d):
    return families.components(families.candidates(view(spark, d, "media_items")), families.default_node())


_OPEN = f"SELECT * FROM cand WHERE keep_state = 'undecided' AND NOT contains(target_path, '{T}')"
_INSIDE = """inside AS (SELECT c.*, component FROM comp JOIN cand c USING (id)),
    prim AS (SELECT component, arg_max(id, row(width * height, size_bytes, -id)) AS primary_id FROM inside GROUP BY 1)"""
_DEFAULT = f"""WITH RECURSIVE {families_sql('group_items')}, nodes AS ({_OPEN}), {_KEYED}, {_FPAIRS}, {COMPONENTS}, {_INSIDE},
    by_ AS (SELECT component, count(*) AS n_members, coalesce(min(id) FILTER (default_named), min(id) FILTER (derived)) AS m, min(created_at) AS first_created FROM inside GROUP BY 1 HAVING bool_or(derived)),
    shown AS (SELECT -m AS review_group_id, m AS default_member_id, i.id, i.id = primary_id AS is_primary, n_members, first_created FROM inside i JOIN by_ USING (component) JOIN prim USING (component))"""


@query(f"{_DEFAULT} SELECT * FROM shown")
def default_review_groups(spark, d):
    return families.default_groups(families.candidates(view(spark, d, "group_items")))


_TRASH = f"""WITH RECURSIVE {families_sql('group_items')}, nodes AS (SELECT * FROM cand WHERE NOT contains(target_path, '{T}') OR contains(target_path, '{FT}')), {_KEYED}, {_FPAIRS}, {COMPONENTS}, {_INSIDE},
    by_ AS (SELECT component, count(*) AS n_members, min(id) FILTER (contains(target_path, '{FT}')) AS m, min(created_at) AS first_created FROM inside GROUP BY 1
            HAVING bool_or(contains(target_path, '{FT}')) AND bool_or(NOT contains(target_path, '{T}')))"""


@query(f"{_TRASH} SELECT -({X.TRASH_GROUPS} + m) AS review_group_id, m AS default_member_id, i.id, i.id = primary_id AS is_primary, n_members, first_created FROM inside i JOIN by_ USING (component) JOIN prim USING (component)")
def trash_review_groups(spark, d):
    return families.trash_groups(families.candidates(view(spark, d, "group_items")))


@query(f"{_DEFAULT} SELECT DISTINCT review_group_id, 'filename-group-' || (-review_group_id)::VARCHAR AS folder, 'resolve_filename_group' AS operation, review_group_id <= -{X.TRASH_GROUPS} AS from_trash FROM shown")
def virtual_ids(spark, d):
    g = F.col("review_group_id")
    return default_review_groups(spark, d).select("review_group_id").distinct().select(g, X.trash_folder(g).alias("folder"), X.operation_name(g).alias("operation"), (g <= -X.TRASH_GROUPS).alias("from_trash"))


def _once(x: str) -> str:
    """The first row of every path: a catalog's paths are unique, the views' aren't."""
    return f"(SELECT * FROM {x} QUALIFY row_number() OVER (PARTITION BY target_path ORDER BY id) = 1)"


def unique_paths(items: DataFrame) -> DataFrame:
    first = F.row_number().over(W.partitionBy("target_path").orderBy("id"))
    return materialize(items.withColumn("r", first).where("r = 1").drop("r"), "unique")


def decisions(g: DataFrame) -> DataFrame:
    """Decisions by id, with a path in both lists in some groups, an unknown path or primary in others, and a kept primary in every second."""
    pick = lambda n: F.sort_array(F.collect_list(F.when(F.col("id") % 3 == n, F.col("target_path"))))
    own = g.where("group_id is not null").groupBy("group_id").agg(pick(0).alias("kept"), pick(1).alias("rejected"))
    kept = F.when(F.col("group_id") % 10 == 4, F.concat("kept", "rejected")).otherwise(F.col("kept"))
    rejected = F.when(F.col("group_id") % 14 == 6, F.concat("rejected", F.array(F.lit("nowhere")))).otherwise(F.col("rejected"))
    primary = F.when(F.col("group_id") % 22 == 8, F.lit("nowhere")).when(F.col("group_id") % 4 == 0, F.get("kept", F.lit(0)))
    return own.select("group_id", kept.alias("kept"), rejected.alias("rejected"), primary.alias("primary"))


_RESOLVED = f"""once AS {_once("group_items")}, own AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'kept' WHEN id % 3 = 1 THEN 'rejected' ELSE 'undecided' END AS to_ FROM once WHERE group_id IS NOT NULL),
    firsts AS (SELECT group_id, min(target_path) FILTER (to_ = 'kept') AS first_kept FROM own GROUP BY 1),
    after_ AS (SELECT o.*, coalesce(o.group_id % 4 = 0 AND o.target_path = first_kept, false) AS prime, to_ = 'rejected' AND NOT contains(target_path, '/.catalog/trash/group-' || o.group_id::VARCHAR || '/') AS moves
               FROM own o JOIN firsts USING (group_id)),
    res AS (SELECT group_id, (group_id % 10 = 4 AND count(*) FILTER (to_ = 'rejected') > 0) OR group_id % 14 = 6 OR group_id % 22 = 8 AS failed,
                   count(*) FILTER (keep_state <> to_ OR prime <> is_group_primary OR moves) AS n FROM after_ GROUP BY 1),
    out_ AS (SELECT group_id, CASE WHEN failed THEN 'failed' WHEN n = 0 THEN 'skipped' ELSE 'applied' END AS outcome, CASE WHEN failed THEN 0 ELSE n END AS n_changed FROM res)"""


@query(f"WITH {_RESOLVED} SELECT group_id, outcome, n_changed FROM out_")
def resolve_decisions(spark, d):
    g = unique_paths(view(spark, d, "group_items"))
    return review.resolved(g, decisions(g))


@query(f"WITH {_RESOLVED} SELECT outcome, count(*) AS n_groups, sum(n_changed)::BIGINT AS n_changed FROM out_ GROUP BY 1")
def resolve_outcomes(spark, d):
    return review.outcomes(resolve_decisions(spark, d))


def _free(style: str, order: str) -> str:
    """CTEs that give ``placed`` (id, folder, name, free) from ``rows_`` (id, folder, name and order) and ``taken`` (folder, name): numbers are tried one by one."""
    ext = "CASE WHEN regexp_matches(name, '^.+\\.[^.]+$') THEN regexp_extract(name, '^.+(\\.[^.]+)$', 1) ELSE '' END"
    bare = "CASE WHEN regexp_matches(name, '^.+\\.[^.]*$') THEN regexp_extract(name, '^(.+)\\.[^.]*$', 1) ELSE name END"
    tried = f"{bare} || '-' || s::VARCHAR || {ext}" if style == "suffix" else "s::VARCHAR || '-' || name"
    return f"""held AS (SELECT DISTINCT folder, name, 1 AS h FROM taken),
    placed_k AS (SELECT r.*, row_number() OVER (PARTITION BY folder, name ORDER BY {order}) - 1 + coalesce(h, 0) AS k FROM rows_ r LEFT JOIN held USING (folder, name)),
    used AS (SELECT folder, name FROM held UNION SELECT folder, name FROM rows_), sizes AS (SELECT folder, count(*) AS c FROM used GROUP BY 1),
    need AS (SELECT folder, name, max(k) AS most FROM placed_k GROUP BY ALL HAVING max(k) > 0), tries AS (SELECT folder, name, unnest(range(1, most + c + 1)) AS s FROM need JOIN sizes USING (folder)),
    made AS (SELECT folder, name, s, {tried} AS free FROM tries), open_ AS (SELECT m.*, row_number() OVER (PARTITION BY folder, name ORDER BY s) AS k FROM made m
             WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.folder = m.folder AND u.name = m.free)),
    placed AS (SELECT p.id, p.folder, p.name, CASE WHEN p.k = 0 THEN p.name ELSE o.free END AS free FROM placed_k p LEFT JOIN open_ o ON o.folder = p.folder AND o.name = p.name AND o.k = p.k)"""


def _below(items: str, root: str) -> str:
    return f"SELECT regexp_replace(p, '/[^/]*$', '') AS folder, string_split(p, '/')[-1] AS name FROM (SELECT substr(target_path, {len(root) + 1}) AS p FROM {items} WHERE starts_with(target_path, '{root}')) b WHERE contains(p, '/')"


_SAFE = "regexp_replace({x}, '[^A-Za-z0-9._-]', '_', 'g')"
_NAME = _SAFE.format(x="string_split(target_path, '/')[-1]")


@query(f"""WITH {_RESOLVED}, act AS (SELECT a.* FROM after_ a JOIN out_ o ON o.group_id = a.group_id AND o.outcome = 'applied'),
    rows_ AS (SELECT id, 'group-' || group_id::VARCHAR AS folder, {_NAME} AS name FROM act WHERE moves), taken AS ({_below("once", "repo" + T)}), {_free("prefix", "id")}
    SELECT i.id, coalesce(a.to_, i.keep_state) AS keep_state, coalesce(a.prime, i.is_group_primary) AS is_group_primary, coalesce('repo{T}' || p.folder || '/' || p.free, i.target_path) AS target_path
    FROM once i LEFT JOIN act a ON a.id = i.id LEFT JOIN placed p ON p.id = i.id""")
def resolve_states(spark, d):
    g = unique_paths(view(spark, d, "group_items"))
    return review.decided(g, decisions(g), "repo").select("id", "keep_state", "is_group_primary", "target_path")


@query(f"""WITH once AS {_once("group_items")}, a AS (SELECT id, CASE WHEN id % 2 = 0 THEN coalesce(group_id, -id) ELSE -id END AS g, target_path, group_id FROM once),
    grouped AS (SELECT DISTINCT g.g AS review_group_id, o.id FROM a g JOIN once o ON o.group_id = g.g WHERE g.g >= 0), named AS (SELECT g AS review_group_id, id FROM a WHERE g < 0),
    below AS (SELECT a.g, o.id FROM a JOIN once o ON a.g < 0 AND starts_with(o.target_path, 'repo{FT}' || (-a.g)::VARCHAR || '/'))
    SELECT review_group_id, id FROM grouped UNION SELECT * FROM named UNION SELECT * FROM below""")
def decision_members(spark, d):
    """Decisions about a group of the catalog for rows of even ids, about a group of the name review for others."""
    g = unique_paths(view(spark, d, "group_items"))
    said = g.select(F.when(F.col("id") % 2 == 0, F.coalesce("group_id", -F.col("id"))).otherwise(-F.col("id")).alias("group_id"), F.array("target_path").alias("kept"))
    said = said.groupBy("group_id").agg(F.flatten(F.collect_list("kept")).alias("kept")).withColumn("rejected", F.array().cast("array<string>"))
    return review.decision_members(g, said, "repo")


@query(f"""SELECT group_id, bool_or(contains(target_path, '{T}')) AS in_trash_review, bool_or(keep_state = 'undecided') AS in_pending_review FROM group_items WHERE group_id IS NOT NULL GROUP BY 1""")
def review_modes(spark, d):
    return review.matches_mode(view(spark, d, "group_items"))


@query(f"""WITH gone AS (SELECT id, group_id FROM group_items WHERE contains(target_path, '{T}') AND id % 2 = 0),
    left_ AS (SELECT * FROM group_items WHERE id NOT IN (SELECT id FROM gone) AND group_id IN (SELECT group_id FROM gone WHERE group_id IS NOT NULL)),
    by_ AS (SELECT group_id, count(*) AS n, bool_or(is_group_primary) AS had, arg_max(id, row(width * height, size_bytes, -id)) AS p FROM left_ GROUP BY 1)
    SELECT id, CASE WHEN n > 1 THEN l.group_id END AS group_id, CASE WHEN n <= 1 THEN false WHEN NOT had THEN id = p ELSE is_group_primary END AS is_group_primary FROM left_ l JOIN by_ b ON b.group_id = l.group_id""")
def delete_trash_survivors(spark, d):
    g = view(spark, d, "group_items")
    return primary.after_deletion(g, g.where(X.in_trash(F.col("target_path")) & (F.col("id") % 2 == 0)))


def _folder(as_of: str = AS_OF) -> str:
    return f"CASE WHEN created_at = '' THEN '{as_of.replace('-', '/')}' ELSE replace(substr(created_at, 1, 10), '-', '/') END"


@query(f"""WITH rows_ AS (SELECT id, {_folder()} AS folder, {_NAME} AS name FROM group_items WHERE contains(target_path, '{T}')),
    taken AS ({_below(f"(SELECT * FROM group_items WHERE NOT contains(target_path, '{T}')) g", "repo/")}), {_free("suffix", "id")},
    bare AS (SELECT group_id, arg_max(id, row(width * height, size_bytes, -id)) AS id FROM group_items WHERE group_id IS NOT NULL GROUP BY 1 HAVING bool_or(contains(target_path, '{T}')) AND NOT bool_or(is_group_primary))
    SELECT i.id, coalesce('repo/' || p.folder || '/' || p.free, i.target_path) AS target_path, CASE WHEN p.id IS NOT NULL THEN 'kept' ELSE i.keep_state END AS keep_state, b.id IS NOT NULL OR i.is_group_primary AS is_group_primary
    FROM group_items i LEFT JOIN placed p ON p.id = i.id LEFT JOIN bare b ON b.id = i.id WHERE p.id IS NOT NULL OR b.id IS NOT NULL""")
def restore_paths(spark, d):
    """Everything in the trash comes back."""
    g = view(spark, d, "group_items")
    return review.restored(g, g, "repo", AS_OF)


@query(f"""WITH rows_ AS (SELECT id, exact_hash, {_folder()} AS folder, {_NAME} AS name FROM media_items WHERE exact_hash <> ''), taken AS ({_below("group_items", "repo/")}), {_free("suffix", "exact_hash, id")}
    SELECT id, 'repo/' || folder || '/' || free AS new_path FROM placed""")
def target_path_plan(spark, d):
    return dedup.target_paths(view(spark, d, "media_items").where("exact_hash <> ''"), "repo", AS_OF, view(spark, d, "group_items"))


@query(f"""WITH rows_ AS (SELECT id, CASE WHEN group_id IS NULL THEN 'filename-group-' || id::VARCHAR ELSE 'group-' || group_id::VARCHAR END AS folder, {_NAME} AS name
      FROM group_items WHERE keep_state = 'rejected' AND NOT contains(target_path, '{T}')), taken AS ({_below("group_items", "repo" + T)}), {_free("prefix", "id")}
    SELECT id, 'repo{T}' || folder || '/' || free AS trash_path FROM placed""")
def trash_path_plan(spark, d):
    g = view(spark, d, "group_items")
    return dedup.trash_paths(g.where((F.col("keep_state") == "rejected") & ~X.in_trash(F.col("target_path"))), "repo", g)


@query("SELECT id, CASE WHEN group_status = 'pending' THEN 'completed' ELSE group_status END AS group_status FROM group_items")
def pending_completion(spark, d):
    g = view(spark, d, "group_items")
    return catalog.completed(g, catalog.pending(g)).select("id", "group_status")


_PRUNED = """present AS (SELECT target_path FROM media_items WHERE scan_status = 'present'), kept_ AS (SELECT * FROM group_items WHERE target_path IN (SELECT target_path FROM present)),
    gone AS (SELECT * FROM group_items WHERE target_path NOT IN (SELECT target_path FROM present)), hit AS (SELECT DISTINCT group_id FROM gone WHERE group_id IS NOT NULL),
    counts AS (SELECT group_id, count(*) AS n FROM kept_ WHERE group_id IN (SELECT group_id FROM hit) GROUP BY 1)"""


@query(f"""WITH {_PRUNED}, grouped AS (SELECT k.*, k.group_id AS g FROM kept_ k JOIN counts c ON c.group_id = k.group_id), {_A4}
    SELECT k.id, CASE WHEN n = 1 THEN NULL ELSE k.group_id END AS group_id, CASE WHEN n = 1 THEN 'undecided' ELSE keep_state END AS keep_state,
           CASE WHEN n = 1 THEN false WHEN n > 1 THEN k.id = p.primary_id ELSE is_group_primary END AS is_group_primary
    FROM kept_ k LEFT JOIN counts c ON c.group_id = k.group_id LEFT JOIN (SELECT * FROM best WHERE r = 1) p ON p.g = k.group_id""")
def pruned_items(spark, d):
    return _prune(spark, d)[0].select("id", "group_id", "keep_state", "is_group_primary")


@query(f"""WITH {_PRUNED} SELECT exact_hash, size_bytes, status FROM feature_cache f WHERE NOT (EXISTS (SELECT 1 FROM gone g WHERE g.exact_hash = f.exact_hash AND g.size_bytes = f.size_bytes)
    AND NOT EXISTS (SELECT 1 FROM kept_ k WHERE k.exact_hash = f.exact_hash AND k.size_bytes = f.size_bytes))""")
def pruned_cache(spark, d):
    return _prune(spark, d)[1].select("exact_hash", "size_bytes", "status")


def _prune(spark, d):
    listing = view(spark, d, "media_items").where("scan_status = 'present'")
    return catalog.pruned(view(spark, d, "group_items"), listing, view(spark, d, "feature_cache"))


_THUMB = "CASE event_type WHEN 'click' THEN 'jpeg' WHEN 'view' THEN 'bitmap' WHEN 'purchase' THEN 'bitmap16' ELSE 'other' END"


@query(f"""WITH thumbs AS (SELECT m.user_id AS item, m.id AS position, m.width, m.height, {_THUMB} AS format, greatest(m.width, m.height) AS edge FROM media_items m JOIN media_raw r USING (id)),
    ok AS (SELECT *, edge >= 3000 AS big, CASE format WHEN 'bitmap' THEN 3 WHEN 'bitmap16' THEN 2 ELSE 1 END AS f FROM thumbs WHERE format <> 'other')
    SELECT item, position FROM ok QUALIFY row_number() OVER (PARTITION BY item ORDER BY big DESC, CASE WHEN big THEN edge ELSE -edge END, CASE WHEN big THEN width * height ELSE -width * height END,
           CASE WHEN big THEN f ELSE -f END, CASE WHEN big THEN position ELSE -position END) = 1""")
def preview_choice(spark, d):
    m = view(spark, d, "media_items").join(view(spark, d, "media_raw").select("id", F.expr(_THUMB).alias("format")), "id")
    return analytics.preview(m.select(F.col("user_id").alias("item"), F.col("id").alias("position"), "width", "height", "format"), 3000)


_AGAIN = "CASE WHEN has_points THEN 'ready' ELSE 'no_keypoints' END"


@query(f"""SELECT exact_hash, size_bytes, CASE WHEN NOT (status = 'no_keypoints' OR (status = 'ready' AND keypoints < 25)) THEN 'sparse' WHEN has_points AND keypoints % 20 * 2 > keypoints THEN 'retry'
    WHEN status = 'ready' AND keypoints BETWEEN 1 AND 24 THEN 'none' WHEN status = 'no_keypoints' THEN 'retry' ELSE 'sparse' END AS choice FROM feature_cache""")
def extraction_choice(spark, d):
    f = view(spark, d, "feature_cache")
    choice = X.extraction_choice(F.col("status"), F.col("keypoints"), F.expr(_AGAIN), F.expr("keypoints % 20 * 2"))
    return f.select("exact_hash", "size_bytes", choice.alias("choice"))


_EXIF = "CASE WHEN k % 7 = 0 THEN replace(substr(created_at, 1, 10), '-', ':') || ' ' || substr(created_at, 12, 8) WHEN k % 7 = 1 THEN 'unknown' ELSE '' END"


@query(f"""SELECT id, strftime(coalesce(try_strptime(exif, '%Y:%m:%d %H:%M:%S'), try_strptime(nullif(replace(replace(regexp_extract(target_path, '[0-9]{{4}}[-_]?[0-9]{{2}}[-_]?[0-9]{{2}}'), '-', ''), '_', ''), ''), '%Y%m%d'),
    TIMESTAMP '2024-06-01 00:00:00'), '%Y-%m-%dT%H:%M:%S+00:00') AS taken_at FROM (SELECT id, string_split(target_path, '/')[-1] AS target_path, {_EXIF} AS exif FROM media_items)""")
def created_at_precedence(spark, d):
    m = view(spark, d, "media_items").withColumn("exif", F.expr(_EXIF))
    taken = F.coalesce(X.exif_time(F.col("exif")), X.filename_date(X.base_name(F.col("target_path"))), F.to_timestamp(F.lit(AS_OF)))
    return m.select("id", X.rfc3339(taken).alias("taken_at"))


@query("""SELECT id, strftime(coalesce(try_strptime(t, '%Y:%m:%d %H:%M:%S'), try_strptime(t, '%Y-%m-%d %H:%M:%S'), try_strptime(t, '%Y-%m-%dT%H:%M:%S'), try_strptime(t, '%Y-%m-%d')), '%Y-%m-%dT%H:%M:%S+00:00') AS loose,
    CASE WHEN id = 0 THEN NULL ELSE strftime(TIMESTAMP '1904-01-01 00:00:00' + to_seconds(id * 100000), '%Y-%m-%dT%H:%M:%S+00:00') END AS quicktime,
    strftime(TIMESTAMP '2001-01-01 00:00:00' + to_seconds(id * 1000), '%Y-%m-%dT%H:%M:%S+00:00') AS matroska
    FROM (SELECT id, CASE k % 6 WHEN 0 THEN substr(created_at, 1, 19) WHEN 1 THEN replace(substr(created_at, 1, 19), 'T', ' ') WHEN 2 THEN substr(created_at, 1, 10) WHEN 3 THEN replace(substr(created_at, 1, 10), '-', ':') || ' 01:02:03'
          WHEN 4 THEN 'no time' ELSE '' END AS t FROM media_items WHERE created_at <> '')""")
def loose_datetime(spark, d):
    text = """case k % 6 when 0 then substr(created_at, 1, 19) when 1 then replace(substr(created_at, 1, 19), 'T', ' ') when 2 then substr(created_at, 1, 10)
        when 3 then replace(substr(created_at, 1, 10), '-', ':') || ' 01:02:03' when 4 then 'no time' else '' end"""
    m = view(spark, d, "media_items").where("created_at <> ''").withColumn("t", F.expr(text))
    return m.select("id", X.rfc3339(X.loose_time(F.col("t"))).alias("loose"), X.rfc3339(X.quicktime_time(F.col("id") * 100000)).alias("quicktime"), X.rfc3339(X.matroska_time(F.col("id").cast("decimal(20,0)") * F.lit(1_000_000_000_000))).alias("matroska"))


_EXT = """WHEN 'mov' THEN 'video/quicktime' WHEN 'qt' THEN 'video/quicktime' WHEN 'mp4' THEN 'video/mp4' WHEN 'm4v' THEN 'video/mp4' WHEN '3gp' THEN 'video/3gpp' WHEN '3g2' THEN 'video/3gpp2'
    WHEN 'mkv' THEN 'video/x-matroska' WHEN 'webm' THEN 'video/webm' WHEN 'mts' THEN 'video/mp2t' WHEN 'm2ts' THEN 'video/mp2t' WHEN 'avi' THEN 'video/x-msvideo' WHEN 'mxf' THEN 'application/mxf'"""


@query(f"""SELECT id, CASE WHEN mime_type = '' THEN coalesce(CASE lower(regexp_extract(path, '\\.([^.]+)$', 1)) {_EXT} END, mime_type) ELSE mime_type END AS mime_type
    FROM (SELECT id, mime_type, CASE WHEN id % 4 = 0 THEN target_path || '.MOV' WHEN id % 4 = 1 THEN target_path || '.m4v' ELSE target_path END AS path FROM media_items)""")
def mime_fallback(spark, d):
    m = view(spark, d, "media_items").withColumn("path", F.expr("case when id % 4 = 0 then target_path || '.MOV' when id % 4 = 1 then target_path || '.m4v' else target_path end"))
    return m.select("id", X.mime_or_extension(F.col("mime_type"), F.col("path")).alias("mime_type"))


_URL = "'/data/' || regexp_replace(url, '^[a-z]+://', '')"


@query(f"""SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS logical, {_URL} AS physical, regexp_replace(string_split(url, '/')[-1], '[^A-Za-z0-9._-]', '_', 'g') AS safe_name FROM pages""")
def logical_paths(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url", F.concat(F.lit("/data/"), F.regexp_replace("url", "^[a-z]+://", "")).alias("path"))
    logical = X.logical_path(F.col("path"), "/data")
    return p.select("page_id", logical.alias("logical"), X.physical_path(logical, "/data").alias("physical"), X.safe_name(X.base_name(F.col("url"))).alias("safe_name"))


@query("SELECT id, CASE WHEN target_path IN (SELECT target_path FROM media_items WHERE id % 4 <> 1) THEN 'present' ELSE 'missing' END AS scan_status FROM media_items")
def missing_marking(spark, d):
    m = view(spark, d, "media_items")
    return catalog.marked_missing(m, m.where("id % 4 <> 1"))


@query(f"""WITH u AS {_once('group_items')}, old AS (SELECT * FROM u WHERE id % 3 <> 0), new AS (SELECT target_path, size_bytes + 1 AS size_bytes, CASE WHEN id % 5 = 2 THEN '' ELSE created_at END AS created_at FROM u WHERE id % 2 = 0 OR id % 3 = 0)
    SELECT coalesce(o.id, (SELECT max(id) FROM old) + row_number() OVER (PARTITION BY o.id IS NULL ORDER BY target_path)) AS id, target_path, CASE WHEN n.size_bytes IS NOT NULL THEN n.size_bytes ELSE o.size_bytes END AS size_bytes,
           coalesce(nullif(n.created_at, ''), o.created_at, '') AS created_at, o.group_id, coalesce(o.keep_state, 'undecided') AS keep_state, coalesce(o.group_status, 'pending') AS group_status
    FROM old o FULL JOIN new n USING (target_path)""")
def catalog_upsert(spark, d):
    u = unique_paths(view(spark, d, "group_items"))
    new = u.where("id % 2 = 0 or id % 3 = 0").withColumn("size_bytes", F.col("size_bytes") + 1).withColumn("created_at", F.expr("case when id % 5 = 2 then '' else created_at end"))
    return catalog.upserted(u.where("id % 3 <> 0"), new).select("id", "target_path", "size_bytes", "created_at", "group_id", "keep_state", "group_status")


@query("""SELECT id, kind, payload_json FROM operations_log WHERE contains(payload_json, '"group_id":4') ORDER BY id DESC LIMIT 50""")
def oplog_latest_for_group(spark, d):
    return catalog.latest_operations(view(spark, d, "operations_log"), 4)


_PLAIN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '^default', ''), '-[0-9]+$', ''), '_(shotwell|embedded)(_[0-9]+)*$', ''), '_(arw|cr2|dng|jpg|jpeg|png)$', ''), '[^a-z0-9]+', '_', 'g')"
_DERIVED = f"""stems AS (SELECT *, nullif(regexp_extract(lower(string_split(target_path, '/')[-1]), '^(.+)\\.([^.]+)$', 1), '') AS stem FROM group_items WHERE group_id IS NOT NULL),
    bare AS (SELECT *, regexp_replace(coalesce(stem, ''), '^[0-9]+-default', 'default') AS s FROM stems),
    single AS (SELECT group_id FROM stems GROUP BY 1 HAVING count(*) > 1 AND count(*) FILTER (is_group_primary) = 1),
    fam AS (SELECT *, CASE WHEN contains(s, 'shotwell') THEN 'default_shotwell' WHEN contains(s, 'embedded') THEN 'default_embedded'
        WHEN regexp_matches(s, '^default([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{8}}[-_][0-9]{{6}})') THEN 'default_timestamp' WHEN regexp_matches(s, '^default[0-9a-f]{{32}}$') THEN 'default_hash'
        WHEN regexp_matches(s, '^default_?(img|dsc|mg)[a-z]?_?[0-9]') THEN 'default_camera' WHEN starts_with(s, 'default') THEN 'default_other' WHEN regexp_matches(s, '^[0-9]{{8}}-[0-9]{{6}}') THEN 'timestamp_rendition' END AS family FROM bare),
    met AS (SELECT p.group_id, p.id AS primary_id, o.id AS other_id, o.family, p.s AS ps, o.s AS os, {_PLAIN.format(x="p.s")} AS pp, {_PLAIN.format(x="o.s")} AS op, regexp_replace(p.s, '[^a-z0-9]+', '_', 'g') AS pu,
               regexp_replace(p.s, '[^0-9]', '', 'g') AS pd, substr(regexp_replace(o.s, '[^0-9]', '', 'g'), 1, 14) AS stamp
        FROM fam p JOIN fam o ON p.group_id = o.group_id AND p.is_group_primary AND NOT o.is_group_primary AND o.family IS NOT NULL AND p.group_id IN (SELECT group_id FROM single)
        WHERE p.size_bytes >= 5 * o.size_bytes AND greatest(p.width, p.height) >= 2 * greatest(o.width, o.height) AND greatest(p.width, p.height) >= 1200),
    numbers AS (SELECT *, regexp_extract(pp, '([0-9]{{3,18}})[^0-9]*$', 1) AS a, CASE WHEN family = 'timestamp_rendition' THEN substr(stamp, 9, 6) ELSE regexp_extract(op, '([0-9]{{3,18}})[^0-9]*$', 1) END AS b FROM met),
    der AS (SELECT group_id, primary_id, other_id, concat_ws(':', family, CASE WHEN family = 'timestamp_rendition' AND starts_with(pu, replace(substr(os, 1, 15), '-', '_')) OR family <> 'timestamp_rendition' AND pu = op THEN 'same_core'
        WHEN family = 'timestamp_rendition' AND contains(pd, stamp) OR family <> 'timestamp_rendition' AND a = b AND a <> '' THEN 'same_id'
        WHEN abs(try_cast(a AS BIGINT) - try_cast(b AS BIGINT)) = 1 THEN 'adjacent_id' WHEN family NOT IN ('timestamp_rendition', 'default_timestamp') THEN 'other' END) AS category FROM numbers)"""


@query(f"WITH {_DERIVED} SELECT group_id, primary_id, other_id, category FROM der")
def derived_pairs(spark, d):
    return analytics.derived_pairs(view(spark, d, "group_items"))


@query(f"WITH {_DERIVED} SELECT category, count(*) AS n_pairs, count(DISTINCT group_id) AS n_groups FROM der GROUP BY 1")
def derived_categories(spark, d):
    return analytics.categories(derived_pairs(spark, d))


def descriptor_sets(vectors: DataFrame) -> DataFrame:
    """id, status, descriptors and points made from vectors: neighbours by id share one scene under a shift."""

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for i in ids:
                scene, n = i // 2, 30
                desc = [hashlib.sha512(f"{scene}:{k}".encode()).digest() for k in range(n)]
                grid = np.array([[37 * k % 211, 53 * k % 197] for k in range(n)], np.float32)
                rows.append(("no_keypoints" if i % 11 == 0 else "ready", confirm.pack_descriptors(desc), confirm.pack_points(grid + np.float32(i % 2 * 9))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.binary(), pa.binary()))]], names=["id", "status", "descriptors", "points"])

    return vectors.select(F.col("vec_id").alias("id")).mapInArrow(run, "id long, status string, descriptors binary, points binary")


@query()
def descriptor_confirm(spark, d):
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    pairs = v.select(F.col("vec_id").alias("a")).withColumn("b", F.explode(F.array(F.col("a") + 1, F.col("a") + 2))).withColumn("distance", (F.col("a") % 20).cast("int"))
    return confirm.confirm_pairs(pairs, descriptor_sets(v))
