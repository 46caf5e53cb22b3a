"""Camera metadata out of file bytes: an Arrow function over the content column, for JPEG, WebP, PNG and bare TIFF."""

from __future__ import annotations

import struct
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions.geo import gps_decimal
from lumenframe.functions.text import col

# Tags by directory, as numbered by the standard, and the names of the eight orientations.
IMAGE = {0x010F: "camera_make", 0x0110: "camera_model", 0x0112: "orientation"}
PHOTO = {0x9003: "date", 0xA434: "lens", 0x8827: "iso", 0x829D: "f_number", 0x829A: "exposure", 0x920A: "focal_length", 0xA002: "width", 0xA003: "height"}
GPS = {1: "lat_ref", 2: "lat", 3: "lon_ref", 4: "lon"}
PHOTO_AT, GPS_AT = 0x8769, 0x8825
WIDTHS = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8}
LETTERS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
ORIENTATIONS = (
    "Horizontal (normal)", "Mirrored horizontal", "Rotated 180", "Mirrored vertical", "Mirrored horizontal then rotated 90 CCW",
    "Rotated 90 CW", "Mirrored horizontal then rotated 90 CW", "Rotated 90 CCW",
)
TEXTS = [*PHOTO.values(), *IMAGE.values()]
COLUMNS = [*TEXTS, "lat_ref", "lon_ref", "lat", "lon"]
SCHEMA = T.StructType([T.StructField(n, T.ArrayType(T.DoubleType()) if n in ("lat", "lon") else T.StringType()) for n in COLUMNS])


def tiff_block(data: bytes) -> bytes | None:
    """The TIFF structure that holds the tags, found by walking the container's segments."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                return data[at + 10 : at + 2 + size]
            at += 2 + max(size, 2)
        return None
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        at, order, name, pad = 12, "little", b"EXIF", 0
    elif data[:8] == b"\x89PNG\r\n\x1a\n":
        at, order, name, pad = 8, "big", b"eXIf", 4
    else:
        return None
    while at + 8 <= len(data):
        head, tail = data[at : at + 4], data[at + 4 : at + 8]
        kind, size = (head, int.from_bytes(tail, order)) if order == "little" else (tail, int.from_bytes(head, order))
        if kind == name:
            body = data[at + 8 : at + 8 + size]
            return body[6:] if body[:6] == b"Exif\0\0" else body
        at += 8 + size + (size % 2 if order == "little" else pad)
    return None


def directory(block: bytes, at: int) -> dict[int, tuple]:
    """tag -> values of one directory; entries that point outside are left out."""
    e = "<" if block[:2] == b"II" else ">"
    found = {}
    for k in range(struct.unpack_from(e + "H", block, at)[0]):
        tag, kind, n = struct.unpack_from(e + "HHI", block, at + 2 + 12 * k)
        width = WIDTHS.get(kind, 0) * n
        place = at + 10 + 12 * k
        if width > 4:
            place = struct.unpack_from(e + "I", block, place)[0]
        if not width or place + width > len(block):
            continue
        if kind in (5, 10):
            pairs = struct.unpack_from(f"{e}{2 * n}{'I' if kind == 5 else 'i'}", block, place)
            found[tag] = tuple(zip(pairs[::2], pairs[1::2], strict=True))
        elif kind in LETTERS:
            found[tag] = struct.unpack_from(f"{e}{n}{LETTERS[kind]}", block, place)
        else:
            found[tag] = (block[place : place + width].split(b"\0")[0].decode("utf-8", "replace").strip(),)
    return found


def _number(x) -> float:
    return x if not isinstance(x, tuple) else x[0] / x[1] if x[1] else 0.0


def _text(values: tuple) -> str | None:
    shown = [str(v) if not isinstance(v, tuple) else str(Fraction(*v)) if v[1] else f"{v[0]}/0" for v in values]
    return (shown[0] if len(shown) == 1 else f"[{', '.join(shown)}]") or None


def tags(data: bytes | None) -> dict:
    """The tags of one file; broken or foreign files have none."""
    try:
        block = tiff_block(data or b"")
        if block is None:
            return {}
        main = directory(block, struct.unpack_from(("<" if block[:2] == b"II" else ">") + "I", block, 4)[0])
        out = {name: _text(main[t]) for t, name in IMAGE.items() if t in main}
        turn = main.get(0x0112, (0,))[0]
        if turn in range(1, 9):
            out["orientation"] = ORIENTATIONS[turn - 1]
        if PHOTO_AT in main:
            photo = directory(block, main[PHOTO_AT][0])
            out |= {name: _text(photo[t]) for t, name in PHOTO.items() if t in photo}
        if GPS_AT in main:
            place = directory(block, main[GPS_AT][0])
            out |= {GPS[t]: [float(_number(x)) for x in v] if t in (2, 4) else str(v[0]) for t, v in place.items() if t in GPS}
        return out
    except (struct.error, IndexError, TypeError, ValueError):
        return {}


@F.pandas_udf(SCHEMA)
def _tags(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([dict.fromkeys(COLUMNS) | tags(x) for x in content], columns=COLUMNS, dtype=object)


def exif(content) -> Column:
    """struct of the raw tags; `fields` turns it into a media row's."""
    return _tags(col(content))


def fields(raw) -> Column:
    """struct of the tags as text, and gps_lat, gps_lon: both or neither."""
    raw = col(raw)
    degrees = lambda c, ref, default: F.when(F.size(raw[c]) >= 3, gps_decimal(F.get(raw[c], F.lit(0)), F.get(raw[c], F.lit(1)), F.get(raw[c], F.lit(2)), F.coalesce(raw[ref], F.lit(default))))
    lat, lon = degrees("lat", "lat_ref", "N"), degrees("lon", "lon_ref", "E")
    both = lat.isNotNull() & lon.isNotNull()
    return F.struct(*[raw[n].alias(n) for n in TEXTS], F.when(both, lat).alias("gps_lat"), F.when(both, lon).alias("gps_lon"))
