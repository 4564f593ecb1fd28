"""What an image's first bytes say: format, width and height, and whether they are within limits."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bytes, sides and pixels that a page's image may have.
LEAST_BYTES, MOST_BYTES, MOST_WIDTH, MOST_HEIGHT, MOST_PIXELS = 24, 19_000_000, 10_000, 60_000, 80_000_000


def _jpeg(b: bytes) -> tuple[int, int] | None:
    at = 2
    while at + 9 <= len(b) and b[at] == 0xFF:
        marker, size = b[at + 1], int.from_bytes(b[at + 2 : at + 4], "big")
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):  # a frame's head
            height, width = struct.unpack_from(">HH", b, at + 5)
            return width, height
        at += 2 + size
    return None


def _webp(b: bytes) -> tuple[int, int] | None:
    kind = b[12:16]
    if kind == b"VP8X" and len(b) >= 30:
        return int.from_bytes(b[24:27], "little") + 1, int.from_bytes(b[27:30], "little") + 1
    if kind == b"VP8L" and len(b) >= 25:
        bits = int.from_bytes(b[21:25], "little")
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if kind == b"VP8 " and len(b) >= 30:
        width, height = struct.unpack_from("<HH", b, 26)
        return width & 0x3FFF, height & 0x3FFF
    return None


def header(b: bytes | None) -> tuple[str | None, int | None, int | None, bool]:
    """(format, width, height, ok); all but ok are null for what isn't known or is cut short."""
    b = bytes(b or b"")
    size, kind = None, None
    if b[:8] == b"\x89PNG\r\n\x1a\n":
        kind, size = "png", struct.unpack_from(">II", b, 16) if len(b) >= 24 else None
    elif b[:6] in (b"GIF87a", b"GIF89a"):
        kind, size = "gif", struct.unpack_from("<HH", b, 6) if len(b) >= 10 else None
    elif b[:2] == b"\xff\xd8":
        kind, size = "jpeg", _jpeg(b)
    elif b[:4] == b"RIFF" and b[8:12] == b"WEBP":
        kind, size = "webp", _webp(b)
    elif b[4:12] in (b"ftypavif", b"ftypavis"):
        at = b.find(b"ispe")
        kind, size = "avif", struct.unpack_from(">II", b, at + 8) if 0 <= at <= len(b) - 16 else None
    width, height = size or (None, None)
    ok = bool(size) and LEAST_BYTES <= len(b) <= MOST_BYTES and 0 < width <= MOST_WIDTH and 0 < height <= MOST_HEIGHT and width * height <= MOST_PIXELS
    return kind, width, height, ok


@F.pandas_udf(T.StructType([T.StructField("format", T.StringType()), T.StructField("width", T.LongType()), T.StructField("height", T.LongType()), T.StructField("ok", T.BooleanType())]))
def inspect_image(images: pd.Series) -> pd.DataFrame:
    """header() of binary columns."""
    rows = [header(b) for b in images]
    return pd.DataFrame({"format": [r[0] for r in rows], "width": pd.array([r[1] for r in rows], "Int64"), "height": pd.array([r[2] for r in rows], "Int64"), "ok": [r[3] for r in rows]})
