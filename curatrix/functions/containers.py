"""Creation times inside media containers: ISO base media (MP4, MOV) and Matroska."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from curatrix.functions import expr as X

ZONED, LOCAL = (p.removesuffix(r"\z").removeprefix("^") for p in (X.ZONED, X.LOCAL))

EPOCH_1904 = datetime(1904, 1, 1, tzinfo=timezone.utc)
EPOCH_2001 = datetime(2001, 1, 1, tzinfo=timezone.utc)
# Boxes that hold boxes, keys that hold dates, Matroska element ids.
NESTS = (b"moov", b"trak", b"mdia", b"udta", b"meta", b"ilst")
DATE_KEYS = ("com.apple.quicktime.creationdate", "creationdate", "creation_time", "date")
SEGMENT, INFO, DATE_UTC = 0x18538067, 0x1549A966, 0x4461
FORMATS = ("%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y:%m:%d %H:%M:%S", "%Y-%m-%d")


def loose_time(text: str) -> datetime | None:
    """The forms of functions.expr.loose_time, to microseconds."""
    text = text.strip("\0").strip()
    short = re.sub(r"(\.\d{6})\d+", r"\1", text)
    if re.fullmatch(ZONED, text):
        try:
            return datetime.fromisoformat(short.upper()).astimezone(timezone.utc)
        except ValueError:
            return None
    if re.fullmatch(LOCAL, text) and "." in text:
        try:
            return datetime.fromisoformat(short).replace(tzinfo=timezone.utc)
        except ValueError:
            return None
    for f in FORMATS:
        try:
            return datetime.strptime(text, f).replace(tzinfo=timezone.utc)
        except ValueError:
            continue
    return None


def is_date_key(key: str) -> bool:
    key = key.lower()
    return key in DATE_KEYS or "creation" in key and "date" in key


def boxes(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, start of the payload, end) of the boxes in a range; size 0 means up to its end."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if start + 16 > end:
                return
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            return
        yield kind, start + head, start + size
        start += size


def _header_time(data: bytes, at: int, end: int) -> datetime | None:
    if at >= end:
        return None
    if data[at] == 0 and at + 8 <= end:
        seconds = struct.unpack_from(">I", data, at + 4)[0]
    elif data[at] == 1 and at + 12 <= end:
        seconds = struct.unpack_from(">Q", data, at + 4)[0]
    else:
        return None
    try:
        return EPOCH_1904 + timedelta(seconds=seconds) if seconds else None
    except OverflowError:
        return None


def _text_time(data: bytes, at: int, end: int) -> datetime | None:
    """A time in a text item: its data box behind 8 bytes, or the plain text."""
    for kind, a, b in boxes(data, at, end):
        if kind == b"data" and b - a > 8:
            return loose_time(data[a + 8 : b].decode("utf-8", "replace"))
    plain = data[at:end]
    for skip in (0, 4):
        if (t := loose_time(plain[skip:].decode("utf-8", "replace"))) is not None:
            return t
    return None


def isobmff_time(data: bytes) -> datetime | None:
    """The explicit creation date of the metadata, else the first of the headers' times."""
    told: list[datetime] = []
    headers: list[datetime] = []
    left = [(0, len(data), ())]
    while left:
        start, end, _ = left.pop(0)
        keys: list[str] = []
        for kind, a, b in boxes(data, start, end):
            if kind == b"keys" and b - a >= 8:
                at = a + 8
                for size, _name, p, q in _keys(data, at, b):
                    keys.append(data[p:q].decode("utf-8", "replace"))
            elif kind == b"ilst":
                for item, p, q in boxes(data, a, b):
                    n = int.from_bytes(item, "big")
                    named = 0 < n <= len(keys) and is_date_key(keys[n - 1])
                    if (named or item == b"\xa9day") and (t := _text_time(data, p, q)):
                        told.append(t)
            elif kind == b"\xa9day" and (t := _text_time(data, a, b)):
                told.append(t)
            elif kind in (b"mvhd", b"mdhd", b"tkhd") and (t := _header_time(data, a, b)):
                headers.append(t)
            elif kind in NESTS:
                # meta is a full box in MP4: its version and flags come before its boxes
                skip = 4 if kind == b"meta" and data[a : a + 4] == b"\0\0\0\0" else 0
                left.append((a + skip, b, ()))
    return (told or headers or [None])[0]


def _keys(data: bytes, at: int, end: int) -> Iterator[tuple[int, bytes, int, int]]:
    while at + 8 <= end:
        size, name = struct.unpack_from(">I4s", data, at)
        if size < 8 or at + size > end:
            return
        yield size, name, at + 8, at + size
        at += size


def _vint(data: bytes, at: int, keep: bool) -> tuple[int | None, int] | None:
    """(value, next place) of a variable-length integer; the value None means unknown size."""
    if at >= len(data) or not data[at]:
        return None
    n = 9 - data[at].bit_length()
    if at + n > len(data):
        return None
    value = int.from_bytes(data[at : at + n], "big")
    if not keep:
        value &= (1 << 7 * n) - 1
        if value == (1 << 7 * n) - 1:
            return None, at + n
    return value, at + n


def matroska_time(data: bytes) -> datetime | None:
    at, end = 0, len(data)
    while at < end:
        if (name := _vint(data, at, True)) is None or (size := _vint(data, name[1], False)) is None:
            return None
        a = size[1]
        b = end if size[0] is None else min(end, a + size[0])
        if name[0] in (SEGMENT, INFO):
            at, end = a, b
            continue
        if name[0] == DATE_UTC and b - a == 8:
            nanos = struct.unpack_from(">q", data, a)[0]
            return EPOCH_2001 + timedelta(microseconds=nanos // 1000)
        at = b
    return None


def container_time(mime: str, data: bytes) -> datetime | None:
    mime = mime.strip().lower()
    if mime in ("video/mp4", "video/quicktime", "video/x-m4v", "video/3gpp", "video/3gpp2"):
        return isobmff_time(data)
    if mime in ("video/x-matroska", "video/webm"):
        return matroska_time(data)
    return None
