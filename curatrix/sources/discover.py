"""Files as rows: a listing of folders and the facts of each file."""

from __future__ import annotations

import hashlib
import os
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions.containers import container_time
from curatrix.functions.expr import EXTENSIONS, GENERIC_TYPES

PREFIX, BLOCK = 3072, 65536
# Beginnings that tell a media type.
MAGIC = (
    (0, b"\xff\xd8\xff", "image/jpeg"), (0, b"\x89PNG\r\n\x1a\n", "image/png"), (0, b"GIF8", "image/gif"), (0, b"BM", "image/bmp"), (8, b"CR\x02", "image/x-canon-cr2"),
    (0, b"II*\0", "image/tiff"), (0, b"MM\0*", "image/tiff"), (8, b"WEBP", "image/webp"), (0, b"\x1aE\xdf\xa3", "video/x-matroska"), (4, b"ftypqt", "video/quicktime"),
    (4, b"ftypM4V", "video/x-m4v"), (4, b"ftyp3gp", "video/3gpp"), (4, b"ftyp", "video/mp4"), (0, b"%PDF", "application/pdf"),
)


def list_files(spark: SparkSession, roots: list[str], partitions: int | None = None) -> DataFrame:
    """root and relative path of every file below the roots.

    Links aren't followed; hidden folders and the trash are left out, but not a root itself.
    Folders are listed on the driver, which only sees names.
    """

    def walk():
        for root in roots:
            for folder, dirs, names in os.walk(root):
                dirs[:] = sorted(d for d in dirs if not d.startswith(".") and d != "trash" and not os.path.islink(os.path.join(folder, d)))
                for name in sorted(names):
                    full = os.path.join(folder, name)
                    if not name.startswith(".") and name != "trash" and os.path.isfile(full) and not os.path.islink(full):
                        yield root, os.path.relpath(full, root)

    return spark.createDataFrame(list(walk()), "root string, relative string").repartition(partitions or max(1, spark.sparkContext.defaultParallelism))


def sniff(head: bytes, name: str) -> str:
    found = next((mime for at, magic, mime in MAGIC if head[at : at + len(magic)] == magic), "application/octet-stream" if head else "application/x-empty")
    return EXTENSIONS.get(name.rpartition(".")[2].lower(), found) if found in GENERIC_TYPES else found


def facts(files: DataFrame) -> DataFrame:
    """files with size, type, content hash, time in the container and modification time; unreadable files go."""

    def run(frames):
        import pandas as pd

        for pdf in frames:
            rows = []
            for root, relative in zip(pdf["root"], pdf["relative"]):
                path = os.path.join(root, relative)
                try:
                    stat, digest, head = os.stat(path), hashlib.sha256(), b""
                    with open(path, "rb") as f:
                        while block := f.read(BLOCK):
                            head = head or block[:PREFIX]
                            digest.update(block)
                    mime = sniff(head, relative)
                    inside = container_time(mime, open(path, "rb").read()) if mime.startswith("video/") else None
                except OSError:
                    continue
                taken = inside or datetime.fromtimestamp(stat.st_mtime, timezone.utc)
                rows.append((root, relative, stat.st_size, mime, digest.hexdigest(), taken.isoformat(), str(stat.st_mtime_ns)))
            yield pd.DataFrame(rows, columns=["root", "relative", "size_bytes", "mime_type", "exact_hash", "created_at", "modified_ns"])

    return files.mapInPandas(run, "root string, relative string, size_bytes long, mime_type string, exact_hash string, created_at string, modified_ns string")


def text_facts(docs: DataFrame) -> DataFrame:
    """Facts of documents as the catalog keeps them."""
    return docs.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("exact_hash"), F.octet_length("text").cast("long").alias("size_bytes"))
