"""Boxes as structs ``x1, y1, x2, y2`` of fractions, and shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, AuditConfig


def area(b: Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def iou(a: Column, b: Column) -> Column:
    """Shared area over joint area; 0 without overlap."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.when((w <= 0) | (h <= 0), F.lit(0.0)).otherwise(w * h / (area(a) + area(b) - w * h))


def _side(p: Column, q: Column, least: float) -> tuple[Column, Column]:
    inside = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    lo, hi = F.least(inside(p), inside(q)), F.greatest(inside(p), inside(q))
    moved = F.least(F.greatest((lo + hi - least) / 2, F.lit(0.0)), F.lit(1.0 - least))
    wide = hi - lo >= least
    return F.when(wide, lo).otherwise(moved), F.when(wide, hi).otherwise(moved + least)


def clamped(b: Column, config: AuditConfig = DEFAULT) -> Column:
    """The box inside the photo, in order, and no narrower than the least side."""
    (x1, x2), (y1, y2) = _side(b["x1"], b["x2"], config.least_box), _side(b["y1"], b["y2"], config.least_box)
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def shape_key(width: Column, height: Column, config: AuditConfig = DEFAULT) -> Column:
    """Photos of about one aspect ratio share a key (rounded half to even)."""
    return F.rint(F.log(width / height) / config.aspect_step).cast("int")


def work_size(key: Column, config: AuditConfig = DEFAULT) -> Column:
    """The (width, height) at which photos of a key are compared."""
    aspect, side = F.exp(key * config.aspect_step), config.overlay_side
    short = lambda v: F.greatest(F.lit(8), F.rint(v).cast("int"))
    width = F.when(aspect >= 1, F.lit(side)).otherwise(short(side * aspect))
    height = F.when(aspect >= 1, short(side / aspect)).otherwise(F.lit(side))
    return F.struct(width.alias("width"), height.alias("height"))


def risky_orientation(tag: Column) -> Column:
    return tag != 1


def swaps_dimensions(tag: Column) -> Column:
    return tag.isin(5, 6, 7, 8)


def size_problem(dw: Column, dh: Column, aw: Column, ah: Column, tag: Column) -> Column:
    """What differs between the size that labels declare and the stored one; null if nothing."""
    rotated = F.format_string(
        "the labels are for the rotated photo (%dx%d) but the file stores it as %dx%d with an EXIF rotation tag (%d); any tool that ignores the tag puts every box in the wrong place", dw, dh, aw, ah, tag
    )
    swapped = F.format_string("the labels say %dx%d but the photo is %dx%d: width and height look swapped", dw, dh, aw, ah)
    resized = F.format_string("the labels say %dx%d but the photo is %dx%d: was it resized after labeling?", dw, dh, aw, ah)
    crossed = (dw == ah) & (dh == aw)
    return F.when((dw == aw) & (dh == ah), F.lit(None)).when(crossed & swaps_dimensions(tag), rotated).when(crossed, swapped).otherwise(resized)
