"""Catalog-shaped views over the star-schema, event and document tables, in SQL that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from curatrix.functions.expr import TRASH


def views(duck: bool) -> dict[str, str]:
    sha = (lambda x: f"sha256({x})") if duck else (lambda x: f"sha2({x}, 256)")
    size = "strlen" if duck else "octet_length"
    fmt = (lambda t, spark, mine: f"strftime({t}, '{mine}')") if duck else (lambda t, spark, mine: f"date_format({t}, '{spark}')")
    k = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"
    minute = "date_trunc('minute', ts)"
    return {
        "doc_items": f"""
            SELECT doc_id AS id, {sha("text")} AS exact_hash, CAST({size}(text) AS BIGINT) AS size_bytes,
                   'repo/' || source || '/' || CAST(doc_id AS STRING) || '.txt' AS target_path,
                   CASE lang WHEN 'en' THEN 'text/plain' ELSE 'text/x-' || lang END AS mime_type,
                   CAST(0 AS BIGINT) AS width, CAST(0 AS BIGINT) AS height FROM documents""",
        "media_raw": f"SELECT event_id AS id, ts, user_id, event_type, value, {k} AS k, CAST(floor(event_id / 3) AS BIGINT) % 10000 AS n FROM events",
        "media_items": f"""
            SELECT id, k, n, user_id,
                   'repo/' || {fmt("ts", "yyyy/MM/dd", "%Y/%m/%d")} || '/' || CASE event_type
                     WHEN 'click' THEN 'IMG_' || lpad(CAST(n AS STRING), 4, '0') || '.JPG'
                     WHEN 'view' THEN 'defaultimg_' || lpad(CAST(n AS STRING), 4, '0') || '-2.jpg'
                     WHEN 'purchase' THEN '1-defaultimg_' || lpad(CAST(n AS STRING), 4, '0') || '_cr2_shotwell.jpg'
                     WHEN 'signup' THEN 'IMG_' || {fmt(minute, "yyyyMMdd_HHmmss", "%Y%m%d_%H%M%S")} || '.jpg'
                     ELSE {fmt(minute, "yyyyMMdd-HHmmss", "%Y%m%d-%H%M%S")} || '-3.jpg' END AS target_path,
                   CASE WHEN k % 23 = 0 THEN '' ELSE {sha("CAST(user_id % 97 AS STRING) || '-' || CAST(k % 5 AS STRING)")} END AS exact_hash,
                   CAST(floor(value * 100) AS BIGINT) AS size_bytes,
                   CASE WHEN k % 19 = 0 THEN 'video/mp4' WHEN k % 13 = 0 THEN '' WHEN event_type = 'purchase' THEN ' Image/X-Canon-CR2' ELSE 'image/jpeg' END AS mime_type,
                   CASE WHEN k % 17 = 0 THEN '' ELSE {fmt("ts", "yyyy-MM-dd", "%Y-%m-%d")} || 'T' || {fmt("ts", "HH:mm:ss", "%H:%M:%S")} || '+00:00' END AS created_at,
                   CAST(200 + (k % 10) * 400 AS BIGINT) AS width, CAST(200 + (k % 7) * 300 AS BIGINT) AS height,
                   CASE WHEN k % 29 = 0 THEN 'missing' ELSE 'present' END AS scan_status,
                   CASE k % 5 WHEN 0 THEN 'rejected' WHEN 1 THEN 'kept' ELSE 'undecided' END AS keep_state,
                   CASE WHEN k % 11 = 0 THEN 'no json' WHEN k % 3 = 0 THEN '{{}}' ELSE '{{"fingerprint":{{"size_bytes":' || CAST(k AS STRING) || ',"modified_at":"' || CAST(n AS STRING) || '"}}}}' END AS meta_json
            FROM media_raw""",
        "group_items": f"""
            SELECT id, k, exact_hash, size_bytes, mime_type, created_at, width, height, keep_state, group_id,
                   CASE WHEN k < 10 THEN 'repo{TRASH}' || CASE WHEN group_id IS NULL THEN 'filename-group-' || CAST(id AS STRING) ELSE 'group-' || CAST(group_id AS STRING) END || '/' || name
                        ELSE target_path END AS target_path, is_group_primary, group_status, meta_json
            FROM (SELECT *, CASE WHEN id % 5 = 0 THEN NULL ELSE CAST(floor(id / 4) AS BIGINT) END AS group_id, id % 4 = 1 AS is_group_primary,
                         CASE WHEN k % 2 = 0 THEN 'pending' ELSE 'completed' END AS group_status, substr(target_path, 17) AS name FROM media_items) g""",
        "feature_cache": f"""
            SELECT exact_hash, size_bytes, CASE k % 6 {" ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(("pending", "ready", "no_keypoints", "too_small", "decode_error", "unavailable")))} END AS status,
                   k AS keypoints, CASE WHEN k % 4 = 0 THEN 6 ELSE 7 END AS feature_version, k % 2 = 0 AS has_descriptors, k % 3 = 0 AS has_points
            FROM (SELECT exact_hash, size_bytes, min(k) AS k FROM media_items WHERE exact_hash <> '' AND id % 3 <> 0 GROUP BY exact_hash, size_bytes) f
            UNION ALL SELECT 'orphan-' || CAST(id AS STRING), id, 'ready', 30, 7, true, true FROM media_items WHERE id % 50 = 7""",
        "operations_log": """
            SELECT conv_id * 1000 + turn AS id, CASE role WHEN 'user' THEN 'resolve_group' ELSE 'delete_trash' END AS kind,
                   '{"group_id":' || CAST(conv_id AS STRING) || ',"turn":' || CAST(turn AS STRING) || '}' AS payload_json FROM conversations""",
    }


def install(spark: SparkSession, sf_dir: str) -> None:
    """Registers the views and the tables below them for sf_dir; views are plans, nothing is read."""
    for table in ("documents", "events", "conversations", "embeddings"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    for name, sql in views(False).items():
        spark.sql(sql).createOrReplaceTempView(name)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    install(spark, sf_dir)
    return spark.table(name)


def with_views(sql: str) -> str:
    """SQL for DuckDB with the views it needs in front."""
    every = views(True)
    need: list[str] = []

    def add(text: str) -> None:
        for name in every:
            if name in text and name not in need:
                add(every[name])
                if name not in need:
                    need.append(name)

    add(sql)
    ctes = ",\n".join(f"{n} AS ({every[n]})" for n in need)
    body = sql.strip()
    if not need:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
