"""EXIF facts from raw JPEG or PNG bytes; a TIFF directory walk in plain Python."""

from __future__ import annotations

import struct
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# EXIF tag numbers, and bytes per value of each TIFF type.
ORIENTATION, MAKE, MODEL, EXIF_DIRECTORY = 274, 271, 272, 34665
TAKEN, FRACTION, SERIAL = 36867, 37521, 42033
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def exif_block(data: bytes) -> bytes | None:
    """The TIFF block of a file, if it has one."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(data):
            size = int.from_bytes(data[at : at + 4], "big")
            if data[at + 4 : at + 8] == b"eXIf":
                return data[at + 8 : at + 8 + size]
            at += 12 + size
        return None
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\x00\x00":
            return data[at + 10 : at + 2 + size]
        at += 2 + size
    return None


def _directory(tiff: bytes, at: int, order: str) -> dict[int, object]:
    out: dict[int, object] = {}
    if at + 2 > len(tiff):
        return out
    (n,) = struct.unpack_from(order + "H", tiff, at)
    for k in range(min(n, 512)):
        entry = at + 2 + 12 * k
        if entry + 12 > len(tiff):
            break
        tag, kind, count = struct.unpack_from(order + "HHI", tiff, entry)
        size = _SIZES.get(kind, 0) * count
        where = entry + 8 if size <= 4 else struct.unpack_from(order + "I", tiff, entry + 8)[0]
        raw = tiff[where : where + size]
        if not size or len(raw) < size:
            continue
        if kind == 2:
            out[tag] = raw.decode("utf-8", "replace")
        elif kind in (3, 4):
            out[tag] = struct.unpack_from(order + ("H" if kind == 3 else "I"), raw)[0]
    return out


def read_exif(data: bytes) -> dict:
    """``orientation`` (1 if not told), ``camera`` and ``taken_us`` (null unless the file has both)."""
    out = {"orientation": 1, "camera": None, "taken_us": None}
    tiff = exif_block(data)
    if not tiff or len(tiff) < 8 or tiff[:2] not in (b"II", b"MM"):
        return out
    order = "<" if tiff[:2] == b"II" else ">"
    top = _directory(tiff, struct.unpack_from(order + "I", tiff, 4)[0], order)
    out["orientation"] = top.get(ORIENTATION, 1)
    inner = _directory(tiff, top[EXIF_DIRECTORY], order) if isinstance(top.get(EXIF_DIRECTORY), int) else {}
    clean = lambda v: str(v).strip("\x00 ") if v is not None else ""
    camera = " ".join(t for t in (clean(top.get(MAKE)), clean(top.get(MODEL)), clean(inner.get(SERIAL))) if t)
    try:
        taken = datetime.strptime(clean(inner.get(TAKEN)), "%Y:%m:%d %H:%M:%S").replace(tzinfo=timezone.utc)
    except ValueError:
        return out
    if camera:
        fraction = clean(inner.get(FRACTION))
        out["camera"] = camera
        out["taken_us"] = int(taken.timestamp()) * 1_000_000 + (int((fraction + "000000")[:6]) if fraction.isdigit() else 0)
    return out


_FACTS = T.StructType([T.StructField("orientation", T.IntegerType()), T.StructField("camera", T.StringType()), T.StructField("taken_us", T.LongType())])


@F.pandas_udf(_FACTS)
def exif_facts(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_exif(bytes(c)) if c is not None else {"orientation": 1, "camera": None, "taken_us": None} for c in content], columns=["orientation", "camera", "taken_us"])


def with_exif(files: DataFrame) -> DataFrame:
    return files.withColumn("exif", exif_facts("content")).select("*", "exif.*").drop("exif")
