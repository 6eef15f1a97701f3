"""Column expressions of the catalog: hashes, times, media types, names, paths and predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folder of the catalog's own state below its root, and the trash in it.
STATE = ".catalog"
TRASH = f"/{STATE}/trash/"
#: First id of virtual groups that are seeded by trash.
TRASH_GROUPS = 1_000_000_000

RETRYABLE = ("pending", "decode_error")
STATUSES = ("pending", "ready", "no_keypoints", "too_small", "decode_error", "unavailable")
FEATURE_VERSION, LEAST_KEYPOINTS = 7, 25

# Media types of raw sensor files, and of extensions that content sniffing leaves open.
RAW_TYPES = (
    "image/x-sony-arw", "image/x-sony-sr2", "image/x-canon-cr2", "image/x-canon-cr3", "image/x-nikon-nef", "image/x-nikon-nrw", "image/x-adobe-dng",
    "image/x-fuji-raf", "image/x-olympus-orf", "image/x-panasonic-rw2", "image/x-pentax-pef", "image/x-sigma-x3f", "image/x-hasselblad-3fr", "image/x-raw",
)
EXTENSIONS = {
    "mov": "video/quicktime", "qt": "video/quicktime", "mp4": "video/mp4", "m4v": "video/mp4", "3gp": "video/3gpp", "3g2": "video/3gpp2",
    "mkv": "video/x-matroska", "webm": "video/webm", "mts": "video/mp2t", "m2ts": "video/mp2t", "avi": "video/x-msvideo", "mxf": "application/mxf",
}
GENERIC_TYPES = ("", "application/octet-stream", "application/x-empty", "inode/x-empty")


# hashes


def phash_value(phash: Column) -> Column:
    """The 8 bytes of a Base64 hash as a signed long; null unless exactly 8 bytes decode."""
    raw = F.try_to_binary(phash, F.lit("base64"))
    return F.when(F.octet_length(raw) == 8, F.conv(F.hex(raw), 16, -10).cast("long"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


# media types


def is_visual(mime: Column) -> Column:
    return F.coalesce(F.lower(F.trim(mime)).startswith("image/"), F.lit(False))


def is_raw(mime: Column) -> Column:
    return F.lower(F.trim(mime)).isin(*RAW_TYPES)


def is_generic(mime: Column) -> Column:
    return F.coalesce(mime, F.lit("")).isin(*GENERIC_TYPES)


def extension_type(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.try_element_at(table, extension(path))


def mime_or_extension(mime: Column, path: Column) -> Column:
    """The sniffed type, or the extension's where sniffing found only a generic one."""
    return F.when(is_generic(mime), F.coalesce(extension_type(path), mime)).otherwise(mime)


# paths and names


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """Lower-case name before the last dot; null without a dot inside the name."""
    s = F.regexp_extract(F.lower(base_name(path)), r"^(.+)\.([^.]+)\z", 1)
    return F.when(s != "", s)


def extension(path: Column) -> Column:
    e = F.regexp_extract(F.lower(base_name(path)), r"^(.+)\.([^.]+)\z", 2)
    return F.when(e != "", e)


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9._-]", "_")


def excluded(relative: Column) -> Column:
    """Whether a component is hidden or the trash."""
    return F.exists(F.split(relative, "/"), lambda c: c.startswith(".") | (c == "trash"))


def logical_path(path: Column, parent: str) -> Column:
    """The path below the destination's parent, where it lies there."""
    prefix = parent.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substr(path, F.lit(len(prefix) + 1))).otherwise(path)


def physical_path(path: Column, parent: str) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(parent.rstrip("/") + "/"), path))


def in_trash(path: Column) -> Column:
    return F.instr(path, TRASH) > 0


def in_trash_by_component(path: Column) -> Column:
    return path.rlike(r"(^|/)\.catalog/trash(/|\z)")


def in_family_trash(path: Column) -> Column:
    return F.contains(path, F.lit(f"{TRASH}filename-group-"))


def trash_folder(group_id: Column) -> Column:
    return F.when(group_id < 0, F.concat(F.lit("filename-group-"), F.abs(group_id).cast("string"))).otherwise(F.concat(F.lit("group-"), group_id.cast("string")))


def in_trash_of(path: Column, group_id: Column) -> Column:
    """Whether a path lies in its group's own trash."""
    return F.contains(path, F.concat(F.lit(TRASH), trash_folder(group_id), F.lit("/")))


def operation_name(group_id: Column) -> Column:
    return F.when(group_id < 0, "resolve_filename_group").otherwise("resolve_group")


# families of file names


def family_base(stem_: Column) -> Column:
    """What a rendition's name was made from; null for names that aren't renditions."""
    s = F.regexp_replace(stem_, "^[0-9]+-", "")
    b = F.when(s.startswith("default"), F.substr(s, F.lit(8)))
    for tail in (r"_(shotwell|embedded(_[0-9]+)*)\z", r"_(arw|cr2|jpg|jpeg|png)\z", r"-[0-9]+\z"):
        b = F.regexp_replace(b, tail, "")
    return F.when(b != "", b)


def timestamp_key(stem_: Column) -> Column:
    found = F.regexp_extract(stem_, "([0-9]{8})[-_]([0-9]{6})", 0)
    return F.when(found != "", F.concat(F.substring(found, 1, 8), F.lit("-"), F.substring(found, 10, 6)))


def is_timestamp_rendition(stem_: Column) -> Column:
    return stem_.rlike(r"^[0-9]{8}-[0-9]{6}(-[0-9]+)?\z")


def same_id_key(stem_: Column) -> Column:
    found = F.regexp_extract(stem_, r"^img_[0-9]{8}_[0-9]{6}_([0-9]{3,5})\z", 1)
    return F.when(found != "", F.concat(F.lit("img_"), found))


def family_keys(path: Column) -> Column:
    """Sorted distinct keys of a path's family, null for names without extension."""
    s, b = stem(path), family_base(stem(path))
    subject = lambda x: F.concat(F.lit("subject:"), x)
    stamp = lambda x: F.concat(F.lit("timestamp:"), timestamp_key(x))
    made, own = F.array(subject(b), stamp(b)), F.array(subject(s), subject(same_id_key(s)), stamp(s))
    return F.when(s.isNotNull(), F.array_sort(F.array_distinct(F.array_compact(F.when(b.isNotNull(), made).otherwise(own)))))


def is_default_named(path: Column) -> Column:
    return F.coalesce(family_base(stem(path)).isNotNull(), F.lit(False))


def is_derived(path: Column) -> Column:
    s = stem(path)
    return F.coalesce(family_base(s).isNotNull() | is_timestamp_rendition(s), F.lit(False))


def orientation(width: Column, height: Column) -> Column:
    return F.when(width == height, "square").when(height > width, "portrait").otherwise("landscape")


def exif_orientation(tag: Column) -> Column:
    return F.when(tag.between(5, 8), "portrait").when(tag.isNotNull(), "landscape")


def optics(*texts: Column) -> Column:
    """The first non-empty of some EXIF texts, without quotes, in lower case."""
    clean = [F.lower(F.trim(F.regexp_replace(F.trim(t), '^"|"\\z', ""))) for t in texts]
    return F.coalesce(*[F.when(c != "", c) for c in clean])


# times


def filename_date(name: Column) -> Column:
    """Midnight of the first date in a name; null if that isn't a date."""
    found = F.regexp_replace(F.regexp_extract(name, "[0-9]{4}[-_]?[0-9]{2}[-_]?[0-9]{2}", 0), "[-_]", "")
    return F.try_to_timestamp(F.when(found != "", found), F.lit("yyyyMMdd"))


def exif_time(text: Column) -> Column:
    return F.try_to_timestamp(F.when(text.rlike(r"^[0-9]{4}:[0-9]{2}:[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\z"), text), F.lit("yyyy:MM:dd HH:mm:ss"))


#: Loose times: with an offset; without one (UTC), with any digits of a second; EXIF's form; a date.
ZONED = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})\z"
LOCAL = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?\z"
DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"


def loose_time(text: Column) -> Column:
    """A time in one of the loose forms as a timestamp, to microseconds; null for any other text."""
    t = F.trim(F.regexp_replace(text, r"^\x00+|\x00+\z", ""))
    short = F.regexp_replace(t, r"(\.[0-9]{6})[0-9]+", "$1")
    utc = F.concat(short, F.when(t.rlike(DAY), F.lit("T00:00:00Z")).otherwise(F.lit("Z")))
    return F.coalesce(F.try_to_timestamp(F.when(t.rlike(ZONED), F.upper(short))), F.try_to_timestamp(F.when(t.rlike(LOCAL) | t.rlike(DAY), utc)), exif_time(t))


def quicktime_time(seconds: Column) -> Column:
    """Seconds since 1904 as a timestamp; 0 means none."""
    return F.when(seconds != 0, F.timestamp_seconds(seconds - F.lit(2082844800)))


def _floored(n: Column, by: int) -> Column:
    """A long divided by another, rounded down, in whole numbers."""
    return F.call_function("div", n - F.pmod(n, F.lit(by)), F.lit(by))


def matroska_time(nanos: Column) -> Column:
    """Nanoseconds since 2001, a long or a decimal, as a timestamp, to microseconds."""
    return F.timestamp_micros(_floored(nanos, 1000) + F.lit(978307200000000))


def rfc3339(ts: Column) -> Column:
    """UTC with 0, 3 or 6 digits of a second; years beyond 9999 have no sign."""
    s = F.ltrim(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+"))
    us = F.date_format(ts, "SSSSSS")
    part = F.when(us == "000000", "").when(us.endswith("000"), F.concat(F.lit("."), F.substring(us, 1, 3))).otherwise(F.concat(F.lit("."), us))
    return F.concat(s, part, F.lit("+00:00"))


def nanos_rfc3339(nanos: Column) -> Column:
    """Nanoseconds since 1970 as text with 0, 3, 6 or 9 digits of a second."""
    sec = _floored(nanos, 1_000_000_000)
    ns = F.lpad(F.pmod(nanos, F.lit(1_000_000_000)).cast("string"), 9, "0")
    part = F.when(ns == "000000000", "").when(ns.endswith("000000"), F.concat(F.lit("."), F.substring(ns, 1, 3))).when(ns.endswith("000"), F.concat(F.lit("."), F.substring(ns, 1, 6))).otherwise(F.concat(F.lit("."), ns))
    return F.concat(F.date_format(F.timestamp_seconds(sec), "yyyy-MM-dd'T'HH:mm:ss"), part, F.lit("+00:00"))


def date_folder(created_at: Column, as_of: str) -> Column:
    """yyyy/mm/dd of a time text in its own offset; of ``as_of`` where it has none."""
    own = F.regexp_extract(created_at, "^([0-9]{4})-([0-9]{2})-([0-9]{2})T", 0)
    return F.when(own != "", F.translate(F.substring(own, 1, 10), "-", "/")).otherwise(F.lit(as_of.replace("-", "/")))


def fingerprint_time(meta: Column) -> Column:
    """The modification time in a row's JSON; null where that is missing or the text isn't JSON."""
    return F.get_json_object(meta, "$.fingerprint.modified_at")


def retryable(status: Column) -> Column:
    return status.isin(*RETRYABLE)


def reusable(status: Column, keypoints: Column, version: Column) -> Column:
    """Whether a cached feature row needn't be computed again."""
    return (version == FEATURE_VERSION) & ~retryable(status) & ((status != "ready") | (F.coalesce(keypoints, F.lit(0)) >= LEAST_KEYPOINTS))


def wants_retry(status: Column, keypoints: Column) -> Column:
    """Whether a sparse extraction is tried again with the default settings."""
    few = F.coalesce(keypoints, F.lit(0)) < LEAST_KEYPOINTS
    return (status == "no_keypoints") | ((status == "ready") & few)


def extraction_choice(status: Column, keypoints: Column, retried: Column, retried_keypoints: Column) -> Column:
    """Of a sparse extraction and its retry: 'retry' where that found more or the sparse one found nothing, 'none' where the sparse one found too few, else 'sparse'."""
    a, b = F.coalesce(keypoints, F.lit(0)), F.coalesce(retried_keypoints, F.lit(0))
    choice = F.when((retried == "ready") & (b > a), "retry").when((status == "ready") & (a > 0) & (a < LEAST_KEYPOINTS), "none")
    return F.when(~wants_retry(status, keypoints), "sparse").otherwise(choice.when(status == "no_keypoints", "retry").otherwise("sparse"))
